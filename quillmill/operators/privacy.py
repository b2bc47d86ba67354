"""Detection and reversible masking of personal data."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.patterns import alternation, groups
from quillmill.functions.rows import unroll, unroll_fields

# Given names that begin a full name without a title.
GIVEN = ("Anna|Anne|Carlos|Charles|Claire|Clara|Daniel|David|Elena|Emily|Emma|Eva|Hans|Isabel|Jack|James|Jan|Jean|John|Jose|Juan|Julia|Karl|"
         "Klaus|Laura|Linda|Lisa|Lucas|Luis|Maria|Marie|Mark|Martin|Mary|Michael|Michel|Nina|Paul|Peter|Pierre|Robert|Sarah|Sofia|Sophie|"
         "Stefan|Susan|Thomas|Tom|William")
# Detection patterns in order of precedence.  They use no look-around, so other
# engines can run them too.
PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "IBAN": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "IP": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "ID": r"\b[A-Z]{2,10}-[0-9]{4,}\b",
    "PHONE": r"\+?[0-9][0-9 ()/.-]{6,}[0-9]",
    "NAME": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?\b|\b(?:" + GIVEN + r") [A-Z][a-z]+\b",
}
# Found first and left as they are: dates are no telephone numbers.
UNTOUCHED = {"_DATE": r"\b(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]\b"}
#: What all matches of a kind begin with, so that no pattern is tried at other characters.
BEGINS = {k: "[A-Z0-9+]" for k in PATTERNS if k != "EMAIL"}
LITERAL = "PLACEHOLDER"
# Noncharacters that mark matches and their groups, and the one that replaces them in texts.
MARKS = "\ufdd0\ufdd1\ufdd2\ufdd3"
SEPARATOR = "|||"


def custom_lines(text: str) -> list[tuple[str, str]]:
    """(label, pattern) of each ``regex|||LABEL`` line that has both parts."""
    found = []
    for line in text.splitlines():
        pattern, sep, label = line.partition(SEPARATOR)
        label = label.strip().strip("[]").upper()
        if sep and pattern.strip() and label:
            found.append((label, pattern.strip()))
    return found


def custom_patterns(text: str) -> dict[str, str]:
    """Patterns by label; lines without both parts and patterns the engine rejects are skipped."""
    found: dict[str, str] = {}
    for label, pattern in custom_lines(text):
        if groups(pattern) is not None:
            found[label] = f"{found[label]}|{pattern}" if label in found else pattern
    return found


def rejected_patterns(text: str) -> list[tuple[str, str]]:
    """The (label, pattern) lines that ``custom_patterns`` skips because the engine rejects them."""
    return [line for line in custom_lines(text) if groups(line[1]) is None]


def active_patterns(switches: dict[str, bool] | None = None, custom: str = "") -> dict[str, str]:
    """Built-in patterns that are switched on, preceded by custom ones; what ``UNTOUCHED`` names is never masked."""
    builtin = {k: p for k, p in PATTERNS.items() if (switches or {}).get(k, True)}
    return {**custom_patterns(custom), **builtin}


def _unions(patterns: dict[str, str]) -> tuple[str, str, list[int]]:
    """One alternation of all kinds, the same without e-mail addresses, and the groups' numbers, which are those of both."""
    begins = {k: c for k, c in BEGINS.items() if patterns.get(k) == PATTERNS[k]}
    union, places = alternation(patterns, begins)
    plain = {k: "(?!)" if p == PATTERNS["EMAIL"] else p for k, p in patterns.items()}
    return union, alternation(plain, begins)[0], places


def _by_union(c: Column, patterns: dict[str, str], step) -> Column:
    """``step`` with the alternation that the text needs: the pattern of addresses, which tries every word, only where there is an @."""
    union, plain, _ = _unions(patterns)
    return F.when(c.contains("@"), step(union)).otherwise(step(plain))


def entities(c: Column, patterns: dict[str, str]) -> Column:
    """Matches in order of appearance as (type, value), those of ``UNTOUCHED`` kinds included.

    One alternation finds them; the type is the alternative that matched.  A
    replacement that names all groups shows which, and the value with it: the
    text is marked once, with noncharacters.  Only texts that have these
    themselves are searched twice, as they are taken out before.
    """
    _, _, places = _unions(patterns)
    marks = MARKS[1].join(f"${p}" for p in places)
    odd = c.contains(MARKS[0]) | c.contains(MARKS[1]) | c.contains(MARKS[2])
    free = F.when(odd, F.translate(c, MARKS, MARKS[3] * 3)).otherwise(c)
    marked = _by_union(free, patterns, lambda union: F.regexp_replace(free, union, f"{MARKS[0]}{marks}{MARKS[2]}"))
    found = F.regexp_extract_all(marked, F.lit(f"{MARKS[0]}([^{MARKS[2]}]*){MARKS[2]}"), F.lit(1))
    kinds = F.array(*[F.lit(k) for k in patterns])

    def entity(m: Column, value: Column) -> Column:
        place = F.array_position(F.transform(F.split(m, MARKS[1], -1), lambda x: x != ""), True)
        return F.struct(F.get(kinds, (place - 1).cast("int")).alias("entity_type"), value.alias("value"))

    given = _by_union(c, patterns, lambda union: F.regexp_extract_all(c, F.lit(union), F.lit(0)))
    return F.when(odd, F.zip_with(given, found, lambda v, m: entity(m, v))).otherwise(
        F.transform(found, lambda m: entity(m, F.replace(m, F.lit(MARKS[1]), F.lit("")))))


def detect(df: DataFrame, key: str = "doc_id", text: str = "text", switches=None, custom: str = "") -> DataFrame:
    """One row per match: key, entity_type, value, pos (ordinal in the document)."""
    patterns = active_patterns(switches, custom)
    found = F.filter(entities(F.col(text), {**UNTOUCHED, **patterns}), lambda e: e["entity_type"].isin(list(patterns)))
    return (unroll(df, [key], found, "e", "pos")
            .select(key, F.col("e.entity_type").alias("entity_type"), F.col("e.value").alias("value"), "pos"))


def _numbered(kinds: list[str]):
    """Of a document's matches: what stands for each, and the mapping, numbered per type in order of appearance."""
    order = {k: i for i, k in enumerate(kinds)}

    @F.pandas_udf("struct<stand:array<string>,mapping:array<struct<placeholder:string,original_value:string,entity_type:string>>>")
    def number(found: pd.Series) -> pd.DataFrame:
        rows = []
        for matches in found:
            names: dict[tuple[str, str], str] = {}
            count: dict[str, int] = {}
            stand = []
            for m in matches if matches is not None else ():
                kind, value = m["entity_type"], m["value"]
                if kind not in order:
                    stand.append(value)
                    continue
                if (kind, value) not in names:
                    count[kind] = count.get(kind, 0) + 1
                    names[kind, value] = f"[{kind}_{count[kind]}]"
                stand.append(names[kind, value])
            listed = sorted(names.items(), key=lambda n: order[n[0][0]])  # stable, so appearance decides inside a type
            rows.append((stand, [{"placeholder": p, "original_value": v, "entity_type": k} for (k, v), p in listed]))
        return pd.DataFrame(rows, columns=["stand", "mapping"])

    return number


def mask(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "clean_content", switches=None,
         custom: str = "") -> DataFrame:
    """Adds the masked text and its mapping, all inside the row and in one pass from left to right.

    Text that looks like a placeholder is masked itself, so what ``reinject``
    gives back is the input.  Null texts stay null with an empty mapping.
    """
    patterns = active_patterns(switches, custom)
    own = "|".join(re.escape(k) for k in [*patterns, LITERAL])
    every = {LITERAL: rf"\[(?:{own})_[0-9]+\]", **UNTOUCHED, **patterns}
    number = _numbered([*patterns, LITERAL])
    found = df.withColumn("_said", number(entities(F.col(text), every)))
    gaps = _by_union(F.col(text), every, lambda union: F.split(F.col(text), union, -1))
    woven = F.array_join(F.zip_with(gaps, F.col("_said.stand"), lambda g, p: F.concat(g, F.coalesce(p, F.lit("")))), "")
    return (found.withColumn("mapping", F.col("_said.mapping"))
            .withColumn(out, F.when(F.size("_said.stand") > 0, woven).otherwise(F.col(text))).drop("_said"))


def key_mapping(masked: DataFrame, key: str = "doc_id") -> DataFrame:
    """Placeholder table: key, placeholder, original_value, entity_type."""
    return unroll_fields(masked, [key], "mapping")


def mapping_counts(masked: DataFrame, key: str = "doc_id", shown: int = 5) -> DataFrame:
    """Entities per document: count, the first five placeholders and how many more."""
    n = F.size("mapping")
    head = F.transform(F.slice("mapping", 1, shown), lambda m: m["placeholder"])
    return masked.filter(n > 0).select(
        key, n.alias("entities"), F.array_join(head, " ").alias("shown"), F.greatest(F.lit(0), n - shown).alias("more"))


def type_counts(masked: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct values and documents per entity type."""
    per_doc = key_mapping(masked, key).groupBy("entity_type", key).agg(F.count("*").alias("n"))
    return per_doc.groupBy("entity_type").agg(F.sum("n").alias("entities"), F.count("*").alias("documents"))


def _restored(texts: pd.Series, mappings: pd.Series) -> pd.Series:
    """One pass over what looks like a placeholder; what the mapping does not know stays."""
    shape, out = re.compile(r"\[[^\[\]]+_[0-9]+\]"), []
    for text, mapping in zip(texts, mappings):
        known = {m["placeholder"]: m["original_value"] for m in mapping} if mapping is not None else {}
        out.append(text if text is None or not known else shape.sub(lambda m: known.get(m.group(), m.group()), text))
    return pd.Series(out, dtype=object)


def reinject(df: DataFrame, text: str = "clean_content", out: str = "restored") -> DataFrame:
    """Placeholders back to originals."""
    return df.withColumn(out, F.pandas_udf(_restored, "string")(F.col(text), F.col("mapping")))


def reinject_with(responses: DataFrame, mapping: DataFrame, key: str = "doc_id", text: str = "text",
                  out: str = "restored") -> DataFrame:
    """The same for responses kept apart from the mapping table."""
    packed = mapping.groupBy(key).agg(F.collect_list(F.struct("placeholder", "original_value")).alias("mapping"))
    none = F.array().cast(packed.schema["mapping"].dataType)
    joined = responses.join(packed, key, "left").withColumn("mapping", F.coalesce("mapping", none))
    return reinject(joined, text, out).drop("mapping")


def leaks(masked: DataFrame, key: str = "doc_id", text: str = "clean_content") -> DataFrame:
    """Originals still present in the masked text; expected to be empty."""
    return unroll_fields(masked, [key, text], "mapping").filter(F.col(text).contains(F.col("original_value"))).select(
        key, "placeholder", "original_value")
