"""Rule engine: ordered pattern rewrites folded into one chain of column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.patterns import groups, needed
from quillmill.functions import vocab
from quillmill.functions.rows import unroll
from quillmill.functions.text import let, strip, unicode

# A rule table is configuration; a larger one is refused, not truncated.
MAX_RULES = 5000
# Rules of a longer chain are not guarded by the letters they need, since each guard makes the plan deeper.
MOST_GUARDED = 100


@dataclass(frozen=True)
class Rule:
    seq: int
    pattern: str
    replacement: str
    rule_set: str

    @property
    def label(self) -> str:
        return f"{self.rule_set}:{self.seq:03d}"


def rule_set(name: str, pairs, flags: str = "(?i)", bounded: bool = False) -> list[Rule]:
    """Rules of one set, in order.  ``bounded`` wraps each pattern in word boundaries."""
    wrap = r"\b{}\b".format if bounded else "{}".format
    return [Rule(i + 1, flags + wrap(p), r, name) for i, (p, r) in enumerate(pairs)]


def literal(replacement: str) -> str:
    """Escape a replacement that must not refer to groups."""
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


TIDY = [(r"  +", " "), (r"[,;]\s*[,;]", ","), (r"\.\s*\.", ".")]
FILLER = rule_set("filler", [(vocab.FILLER_SENTENCES, "")], flags="")
HEDGE = rule_set("hedge", [(r"\b(" + "|".join(vocab.HEDGES) + r")\b", "")])
TIDY_RULES = rule_set("tidy", TIDY, flags="")
DOMAIN = rule_set("vocabulary", [(p, literal(r)) for group in vocab.VOCABULARY.values() for p, r in group],
                  bounded=True)
POLITE = rule_set("polite", [(p, " ") for p in vocab.POLITE_PHRASES])
SHORT = rule_set("shorthand", vocab.SHORTHAND, bounded=True)
OUTPUT = rule_set("output", vocab.OUTPUT_CLEANUP)
PARAPHRASE = rule_set("paraphrase", [(vocab.PARAPHRASE_MARKERS, "")])
RULE_SETS = {
    "hedge": FILLER + HEDGE, "vocabulary": DOMAIN, "polite": POLITE, "shorthand": SHORT,
    "output": OUTPUT, "paraphrase": PARAPHRASE,
}


def needs(rules: list[Rule]) -> list[list[str] | None]:
    """For each rule the letters of which a text must hold some before all rules, or None: those that an earlier rule could bring about."""
    found, brought, joins = [], "", False
    for r in rules:
        words = needed(r.pattern)
        found.append(None if words is None or joins or any(w in brought for w in words) else words)
        # A whole word that goes or is replaced leaves its neighbours, which are no letters, where they are.
        whole = re.fullmatch(r"(\(\?[a-zA-Z]+\))*\\b(?:[^|()]*|\((?!\?)[^()]*\))\\b", r.pattern)
        apart = r.replacement != "" and not r.replacement[0].isalpha() and not r.replacement[-1].isalpha()
        joins = joins or not (whole or apart) or bool(re.search(r"(?<!\\)\$", r.replacement))
        brought += "|" + r.replacement.lower()
    return found


def rewrite(c: Column, rules: list[Rule]) -> Column:
    """The rules in order; one whose matches all hold certain letters runs only over texts with these."""
    words = needs(rules) if len(rules) <= MOST_GUARDED else []
    if not any(words):
        return reduce(lambda t, r: F.regexp_replace(t, unicode(r.pattern), r.replacement), rules, c)

    def low(t: Column) -> Column:
        for other, letter in (("ſ", "s"), ("ı", "i"), ("İ", "i"), ("\u212a", "k")):  # the engine takes these for each other
            t = F.replace(t, F.lit(other), F.lit(letter))
        return F.lower(t)

    def run(t: Column, r: Rule, asked: list[str] | None, seen: Column) -> Column:
        if asked is None:
            return F.regexp_replace(t, unicode(r.pattern), r.replacement)
        may = reduce(lambda a, b: a | b, [seen.contains(w) for w in asked])
        return let(t, lambda x: F.when(may, F.regexp_replace(x, unicode(r.pattern), r.replacement)).otherwise(x))

    def chain(b: Column) -> Column:
        t = b["t"]
        for r, asked in zip(rules, words):
            t = run(t, r, asked, b["low"])
        return t

    return let(c, lambda t: let(F.struct(t.alias("t"), low(t).alias("low")), chain))


def apply_rules(df: DataFrame, rules: list[Rule], text: str = "text", out: str = "text_out",
                with_hits: bool = False) -> DataFrame:
    """Rewrite ``text`` by the rules in order.

    Counting doubles the regex work, so hits are optional.  With hits the
    chain is cut into staged columns: each stage is computed once and read by
    both its counter and the next stage.
    """
    if not with_hits:
        return df.withColumn(out, rewrite(F.col(text), rules))
    current, hits = df.withColumn(out, F.col(text)), F.array().cast("array<struct<rule:string,hits:int>>")
    current = current.withColumn("hits", hits)
    for rule in rules:
        found = F.regexp_count(F.col(out), F.lit(unicode(rule.pattern)))
        entry = F.struct(F.lit(rule.label).alias("rule"), found.alias("hits"))
        current = current.withColumns({
            "hits": F.array_append("hits", entry),
            out: F.regexp_replace(F.col(out), unicode(rule.pattern), rule.replacement),
        })
    return current


def hit_totals(df: DataFrame) -> DataFrame:
    """Corpus-wide hits and documents per rule, from a table with ``hits``."""
    return (unroll(df, [], "hits", "h").filter("h.hits > 0")
            .groupBy(F.col("h.rule").alias("rule"))
            .agg(F.sum("h.hits").alias("hits"), F.count("*").alias("documents")))


def remove_hedges(c: Column) -> Column:
    """Filler sentences and hedges, then tidied blanks and punctuation."""
    cleaned = rewrite(c, FILLER + HEDGE + TIDY_RULES[:1])
    return rewrite(strip(cleaned), TIDY_RULES[1:])


def clean_output(c: Column) -> Column:
    return rewrite(c, OUTPUT)


def rules_from_table(df: DataFrame, organization_id=None, most: int = MAX_RULES) -> list[Rule]:
    """Custom rules visible to an organization: active, its own or system ones.

    Rules run one after another inside the plan, so each adds a step to it: more
    than ``most`` are refused rather than cut.  Patterns that the regex engine
    rejects are skipped.
    """
    from quillmill.sources.readers import visible_to_org

    visible = visible_to_org(df.filter("is_active"), organization_id)
    group = group_key()
    rows = visible.select("rule_id", group.alias("grp"), "pattern", "replacement").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules; split the rule table")
    ordered = sorted((r for r in rows if groups("(?i)" + r["pattern"]) is not None), key=lambda r: r["rule_id"])
    return [Rule(r["rule_id"], "(?i)" + r["pattern"], literal(r["replacement"] or ""), r["grp"]) for r in ordered]


def group_key() -> Column:
    """Group of a custom rule: language, programming language, or custom."""
    return (F.when(F.col("rule_type") == "language",
                   F.concat(F.lit("language:"), F.coalesce(F.nullif("language", F.lit("")), F.lit("en"))))
            .when(F.col("rule_type") == "programming",
                  F.concat(F.lit("programming:"),
                           F.coalesce(F.nullif("programming_language", F.lit("")), F.lit("generic"))))
            .otherwise("custom"))


def grouped_rules(df: DataFrame, organization_id=None) -> DataFrame:
    """Visible rules counted per group."""
    from quillmill.sources.readers import visible_to_org

    return (visible_to_org(df, organization_id).withColumn("rule_group", group_key())
            .groupBy("rule_group").agg(F.count("*").alias("rules"),
                                       F.count_if("is_active").alias("active_rules")))
