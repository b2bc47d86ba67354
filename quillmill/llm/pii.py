"""Personal data: labelers vote on candidate spans, EM weighs the labelers, a span classifier decides."""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import give_back, sha256_hex, span_text
from quillmill.session import fresh_path

KINDS = ("email", "ip", "card", "phone", "number", "account", "name")
BASE = 4

# The base patterns.  Local parts are found from the @ sign, so long words cost no more than others.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")



def letter_class(kinds: tuple[str, ...]) -> str:
    """The code points of Unicode categories as the inside of a regex class; capitals and small letters end below U+1F000."""
    spans: list[list[int]] = []
    for c in range(0x1F000):
        if unicodedata.category(chr(c)) in kinds:
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


# Parts of names: capital and small letters of every script that has them, also with combining marks.
UPPER, LOWER = letter_class(("Lu", "Lt")), letter_class(("Ll", "Mn"))
INITIAL = rf"(?:[{UPPER}]\.(?:-?[{UPPER}]\.)*+)"
PARTICLE = r"(?:von|van|der|den|zu|zum|zur|de|del|della|di|da|dos|das|du|des|la|las|le|los|y|al|el|bin|ibn|ten|ter)"
PART = rf"[{UPPER}](?:['’][{UPPER}])?+[{LOWER}]++(?:['’-]?[{UPPER}][{LOWER}]++)*+"
SHORT_PART = rf"[{UPPER}](?:['’][{UPPER}])?[{LOWER}]{{1,14}}(?:['’-]?[{UPPER}][{LOWER}]{{1,14}})*"
NOT_NAMES = r"(?:Dear|Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora|Contact|Hello|Hi|Name)"


def name_pattern(part: str) -> str:
    """Two to four parts or initials, the last a part, with particles between."""
    return rf"(?:{part}|{INITIAL})(?:\x20(?:{INITIAL}|{PARTICLE}(?=\x20))){{0,3}}\x20{part}(?:\x20{part}){{0,2}}"


#: Candidates of the kinds that the votes decide.
CANDIDATES = {
    "number": re.compile(r"(?<![\w.+(-])\(?[0-9]{2,5}\)?(?:[\x20.-][0-9]{2,5}){1,4}(?![\w-]|\.[0-9])"),
    "account": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "name": re.compile(rf"(?<![^\s(\"'«“„‘¿¡])(?!{NOT_NAMES}\b){name_pattern(PART)}(?![^\s.,;:!?)\"'»”’…])"),
}

# Shapes, gazetteer and context words of the labelers.
SHAPES = {
    "number": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|0[0-9]{1,4}(?:[\x20.-][0-9]{2,4}){2,4}"),
    "account": re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){3,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z]{2}[0-9]{13,30}"),
    "name": re.compile(name_pattern(SHORT_PART)),
}
GIVEN_NAMES = frozenset((
    "james mary john anna maria peter paul thomas michael sarah laura david daniel emma julia lena lukas hans klaus "
    "jean pierre marie claire sophie luc jose juan carlos ana lucia pablo elena robert linda susan karen mark").split())
AREA_CODES = frozenset("201 202 206 212 213 214 215 303 305 312 313 404 408 415 503 512 555 602 617 702 713 718 800 888".split())
BANK_LANDS = frozenset("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
CONTEXT = {
    "number": re.compile(r"(?ai:\b(?:phone|tel|telefon|mobile|call|fax|ssn|social security|teléfono|téléphone|contact)\b)[^\n]{0,20}$"),
    "account": re.compile(r"(?ai:\b(?:iban|account|konto|compte|cuenta|bank)\b)[^\n]{0,20}$"),
    "name": re.compile(r"(?ai:\b(?:mr|mrs|ms|dr|herr|frau|monsieur|madame|señor|señora|name|named|contact|dear)\b)\.?[\s:]{0,3}$"),
}
NOT_DATA = re.compile(r"(?:19|20)[0-9]{2}[-. ][01]?[0-9][-. ][0-3]?[0-9]|[0-3]?[0-9][-. ][01]?[0-9][-. ](?:19|20)[0-9]{2}")
CONTEXT_WIDTH = 48


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost matches of local part, @ and domain, found from each @ backwards."""
    found, last = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            last = m.end()
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of the fixed patterns as (start, index of kind, end)."""
    spans = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return spans
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGIT.findall(m.group())) <= 15:
                spans.append((m.start(), 3, m.end()))
    return spans


def bare(name: str) -> str:
    """In small letters and without accents, as the list has its names."""
    return "".join(c for c in unicodedata.normalize("NFD", name.lower()) if unicodedata.category(c) != "Mn")


def gazetteer(kind: str, value: str) -> int:
    """1 if a list knows the value, 0 if it contradicts, -1 without an opinion."""
    if kind == "name":
        return 1 if bare(re.split(r"[\x20-]", value, maxsplit=1)[0]) in GIVEN_NAMES else 0
    if kind == "account":
        return int(value[:2] in BANK_LANDS)
    return 1 if DIGIT.search(value) and "".join(DIGIT.findall(value))[:3] in AREA_CODES else -1


def votes(kind: str, value: str, before: str) -> tuple[int, int, int]:
    """The votes of the shape, list and context labelers: 1 for, 0 against, -1 none."""
    shape = 0 if NOT_DATA.fullmatch(value) else int(bool(SHAPES[kind].fullmatch(value)))
    return shape, gazetteer(kind, value), 1 if CONTEXT[kind].search(before) else -1


def features(kind: str, value: str, text: str, start: int, end: int) -> int:
    """What the classifier sees, as a number of six bits: separators, length, and what stands around the span."""
    seps = {c for c in value if not c.isalnum()}
    return (("-" in seps) | (bool(seps - {"-", " "})) << 1 | (len(value) >= 10) << 2 | (len(value) >= 15) << 3
            | (start == 0 or text[start - 1] in "\n.!?:") << 4 | (end == len(text) or text[end] in ".,;\n") << 5)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(start, index of kind, end, votes, features) of spans beside the base spans; votes are three digits 0, 1, 2 = none."""
    if not text:
        return []
    found, taken = [], sorted((s, e) for s, _, e in base)
    digits = bool(DIGIT.search(text))
    for kind, pattern in CANDIDATES.items():
        if not digits and kind != "name":
            continue
        i = 0
        for m in pattern.finditer(text):
            s, e = m.span()
            while i < len(taken) and taken[i][1] <= s:
                i += 1
            if i < len(taken) and taken[i][0] < e:
                continue
            v = votes(kind, m.group(), text[max(0, s - CONTEXT_WIDTH): s])
            code = sum((x % 3) * 3 ** k for k, x in enumerate(v))
            found.append((s, KINDS.index(kind), e, code, features(kind, m.group(), text, s, e)))
    return found


def reliabilities(counts: dict[int, int], rounds: int = 50) -> tuple[float, np.ndarray, dict[int, float]]:
    """EM over vote patterns: share of true spans, each labeler's hit and false rates, and each pattern's posterior.

    Pseudo-counts start labelers as better than chance and spans as seldom true,
    which also settles what labelers mean by a vote.  A missing vote says nothing.
    """
    patterns = list(counts)
    table = np.array([[(p // 3 ** k) % 3 for k in range(3)] for p in patterns])
    weight = np.array([counts[p] for p in patterns], float)
    share, rates = 0.1, np.array([[0.8, 0.1]] * 3)  # chance of a vote for, given true and given false
    for _ in range(rounds):
        logs = np.tile(np.log([share, 1 - share]), (len(patterns), 1))
        for k in range(3):
            for side in range(2):
                logs[:, side] += np.where(table[:, k] == 1, np.log(rates[k, side]), np.where(
                    table[:, k] == 0, np.log(1 - rates[k, side]), 0.0))
        true = 1 / (1 + np.exp(np.clip(logs[:, 1] - logs[:, 0], -700, 700)))
        share = (1 + (weight * true).sum()) / (10 + weight.sum())
        for k in range(3):
            yes, no = table[:, k] == 1, table[:, k] == 0
            for side, post in enumerate((true, 1 - true)):
                w = weight * post
                prior = (8, 10) if side == 0 else (1, 10)
                rates[k, side] = (prior[0] + w[yes].sum()) / (prior[1] + w[yes].sum() + w[no].sum())
    return share, rates, dict(zip(patterns, true.tolist()))


def train(tally: pd.DataFrame) -> dict[tuple[int, int, int], bool]:
    """The classifier as a table: kind, votes and features to a decision.

    ``tally`` counts candidates by kind, votes and features, at most 27 x 64 rows a
    kind.  EM gives each vote pattern a posterior; a naive Bayes classifier over
    features and votes is trained on the posteriors as soft labels.  Its odds decide; a
    span needs a vote for it, so unvoted prose stays, and two if a vote is against it.
    """
    decided = {}
    for kind, rows in tally.groupby("kind"):
        _, _, post = reliabilities(rows.groupby("votes")["n"].sum().to_dict())
        soft = rows["votes"].map(post)
        yes, no = (rows["n"] * soft).sum(), (rows["n"] * (1 - soft)).sum()
        logodds = {}
        for bit in range(6):
            on = rows["features"].to_numpy() >> bit & 1
            for value in (0, 1):
                n = rows["n"].to_numpy() * (on == value)
                logodds[bit, value] = math.log(((n * soft).sum() + 5) / (yes + 10)) - math.log(((n * (1 - soft)).sum() + 5) / (no + 10))
        for v, f in zip(rows["votes"], rows["features"]):
            p = min(max(post[v], 1e-9), 1 - 1e-9)
            odds = math.log(p / (1 - p)) + 0.5 * sum(logodds[b, f >> b & 1] for b in range(6))
            seen = [(v // 3 ** k) % 3 for k in range(3)]
            decided[int(kind), int(v), int(f)] = odds > 0 and seen.count(1) > min(1, seen.count(0))
    return decided


def marked(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds base (an array of start, kind, end) and more (start, kind, end, votes, features); both empty for null."""
    kinds = "struct<base:array<array<int>>,more:array<array<int>>>"

    target = pa.struct([("base", pa.list_(pa.list_(pa.int32()))), ("more", pa.list_(pa.list_(pa.int32())))])

    @F.arrow_udf(kinds)
    def mark(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            body = t.as_py() or ""
            base = base_spans(body)
            rows.append({"base": base, "more": candidates(body, base)})
        give_back()
        return pa.array(rows, target)

    return docs.withColumn("_found", mark(text))


def decisions(found: DataFrame) -> dict[tuple[int, int, int], bool]:
    """The classifier trained on all candidates of a table with ``more``; the driver gets the bounded tally."""
    more = found.select(F.explode("_found.more").alias("m")).select(
        F.col("m")[1].alias("kind"), F.col("m")[3].alias("votes"), F.col("m")[4].alias("features"))
    return train(more.groupBy("kind", "votes", "features").agg(F.count("*").alias("n")).toPandas())


def chosen(base, more, decided) -> list[tuple[int, int, int]]:
    """The base spans and those candidates that the classifier takes."""
    spans = [tuple(map(int, b)) for b in base]
    return spans + [(int(s), int(k), int(e)) for s, k, e, v, f in more if decided.get((int(k), int(v), int(f)))]


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: counts of the base kinds, the digest of the base spans and all spans.

    Null texts count as empty and give no spans; a null key is kept; repeated rows
    are judged alike.  Places are code points.  Texts are read once: the candidates
    with their votes are written to the shared folder, where the tally and the
    decisions read them.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "pii")
    marked(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text").select("doc_id", "_found").write.parquet(path)
    found = spark.read.parquet(path)
    decided = decisions(found)
    kinds = "struct<n_email:long,n_ip:long,n_card:long,n_phone:long,n_more:long,base_sha256:string,spans:string>"

    @F.pandas_udf(kinds)
    def told(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for base, more in zip(rows["base"], rows["more"]):
            spans = chosen(base, more, decided)
            first = [s for s in spans if s[1] < BASE]
            count = [sum(k == i for _, k, _ in first) for i in range(BASE)]
            out.append((*count, len(spans) - len(first), sha256_hex(span_text(first, KINDS)), span_text(spans, KINDS)))
        return pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "n_more", "base_sha256", "spans"])

    return found.withColumn("_told", told("_found")).select("doc_id", "_told.*")


def masked(docs: DataFrame, text: str = "text", count: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with each found span replaced by its kind in brackets, and ``count`` the new length.

    Overlapping spans are joined and named after the first.  Null texts stay null.
    """
    decided = decisions(marked(docs.select(text), text))

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        out = pa.array([replaced(t.as_py(), decided) if t.is_valid else None for t in texts], pa.string())
        give_back()
        return out

    out = docs.withColumn(text, mask(text))
    return out.withColumn(count, F.length(text).cast(docs.schema[count].dataType)) if count in docs.columns else out


def replaced(text: str, decided: dict[tuple[int, int, int], bool]) -> str:
    base = base_spans(text)
    spans = sorted(chosen(base, candidates(text, base), decided))
    if not spans:
        return text
    parts, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][2])
        parts += [text[at:start], f"[{KINDS[kind]}]"]
        at, i = end, i + 1
    return "".join([*parts, text[at:]])
