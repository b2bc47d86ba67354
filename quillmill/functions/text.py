"""Segmentation and string helpers.  All run inside the row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\x0b"
# One word character.  Explicit, since bare \w is ASCII in some engines.
WORD = r"[\p{L}\p{N}_]"
SENTENCE_END = r"(?<=[.!?])\s+"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable.

    The optimizer may inline a column that is read once into the place that
    reads it; inside a lambda that place runs per element.  A bound variable
    cannot be inlined.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    """Whitespace separated words; none for blank text."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def sentences(c: Column) -> Column:
    """Trimmed, non-empty sentences in order."""
    parts = F.transform(F.split(strip(c), SENTENCE_END), strip)
    return F.filter(parts, lambda s: s != "")


def plain_sentences(c: Column) -> Column:
    """The same cut without trimming each part; blank text gives one empty part."""
    return F.split(strip(c), SENTENCE_END)


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def terms(c: Column, least: int = 1) -> Column:
    """Lower-cased words of at least ``least`` word characters, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD}{{{least},}})"), F.lit(1))


def pairs(tokens: Column) -> Column:
    """Adjacent pairs, joined by a blank that no word contains."""
    n = F.size(tokens)
    heads = F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0)))
    tails = F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.when(n >= 2, F.zip_with(heads, tails, lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(
        F.array().cast("array<string>"))


def unicode(pattern: str) -> str:
    """Java flag that makes \\w, \\b, \\s and \\d cover all scripts."""
    return "(?U)" + pattern


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def has(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def weave(c: Column, pattern: str, change) -> Column:
    """Rewrite each match with a column function, keeping what lies between.

    ``split`` and ``regexp_extract_all`` walk the text the same way, so the
    parts between matches and the matches interleave exactly.
    """
    gaps = F.split(c, pattern, -1)
    found = F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))
    changed = F.transform(found, change)
    woven = F.zip_with(gaps, changed, lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    return F.when(c.rlike(pattern), F.array_join(woven, "")).otherwise(c)
