"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import BLANK_CLASS, let, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"

# Function words of the languages the rules know.
STOP_WORDS = (
    "the be to of and that have with in is it for on as by at from this are was or an a not but "
    "der die das und ist von zu mit sich auf für im ein eine nicht den als auch es an "
    "le la les de des et un une est que qui dans pour sur pas par au avec du en "
    "el los las del y que se por con para una su al lo como más no").split()


class Rule(NamedTuple):
    """A text passes while ``low <= measure <= high``; a missing bound is open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The measures are those of ``measures``.  Bounds are loose, so that plain prose in
#: English, German, French and Spanish stays; the stop-word and word-length rules are
#: made for these four, and tables of other languages need rules of their own.
RULES = (
    Rule("mean word length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols per word", "symbol_ratio", None, 0.10),
    Rule("words with a letter", "letter_ratio", 0.60, None),
    Rule("stop words", "stop_ratio", 0.02, None),
    Rule("repeated lines", "dup_line_ratio", None, 0.50),
    Rule("bullet lines", "bullet_ratio", None, 0.90),
    Rule("lines cut by an ellipsis", "ellipsis_ratio", None, 0.30),
)


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in a window of ``width`` words that the text holds twice or more.

    Window hashes decide for texts without repeats, which is exact, since equal
    windows have equal hashes.  Other texts compare the windows themselves: sorted
    with their places, a window is repeated if a neighbour is equal.
    """
    starts = F.sequence(F.lit(0), F.size(words) - width)

    def at(array, i, k):
        return F.get(array, i + k if k else i)

    def covered(places):
        step = F.transform(places, lambda p, k: F.least(
            F.lit(width), F.coalesce(F.get(places, k + 1) - p, F.lit(width))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(rows):
        same = F.filter(rows, lambda r, k: (r["w"] == F.get(rows, k + 1)["w"]) | (
            (k > 0) & (r["w"] == F.get(rows, F.greatest(k - 1, F.lit(0)))["w"])))
        return let(F.array_sort(F.transform(same, lambda r: r["i"])), covered)

    windows = F.transform(starts, lambda i: F.struct(
        F.concat_ws(" ", *[at(words, i, k) for k in range(width)]).alias("w"), i.alias("i")))
    hashes = let(F.transform(words, lambda w: F.xxhash64(w)),
                 lambda hs: F.transform(starts, lambda i: F.xxhash64(*[at(hs, i, k) for k in range(width)])))
    unique = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    none = F.lit(0).cast("long")
    return F.when(F.size(words) <= width, none).when(unique, none).otherwise(let(F.sort_array(windows), repeated))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios of ``RULES``.

    A null text counts as empty: no words, all counts zero, all ratios zero.
    Columns of the same names in the input are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    df = docs.withColumn("_text", whole).withColumn("_words", words_of(F.col("_text"))).withColumn("_lines", lines)
    words, lines, body = F.col("_words"), F.col("_lines"), F.col("_text")

    def share(part, total):
        return F.when(total > 0, part / total).otherwise(F.lit(0.0))

    n, n_lines = F.size(words).cast("long"), F.size(lines).cast("long")
    counted = df.withColumns({
        "n_words": n,
        "word_chars": F.length(F.regexp_replace(body, BLANK_CLASS + "+", "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (n_lines - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(words),
        "_letters": F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))),
        "_stops": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
        "_bullets": F.size(F.filter(lines, lambda x: F.ltrim(x).substr(1, 1).isin("-", "*", "•", "‣"))),
        "_ellipses": F.size(F.filter(lines, lambda x: F.rtrim(x).rlike(r"(?:\.\.\.|…)$"))),
        "_n_lines": n_lines,
    })
    return counted.withColumns({
        "mean_word_chars": share(F.col("word_chars"), F.col("n_words")),
        "symbol_ratio": share(F.col("n_symbols"), F.col("n_words")),
        "letter_ratio": share(F.col("_letters"), F.col("n_words")),
        "stop_ratio": share(F.col("_stops"), F.col("n_words")),
        "dup_line_ratio": share(F.col("n_dup_lines"), F.col("_n_lines")),
        "bullet_ratio": share(F.col("_bullets"), F.col("_n_lines")),
        "ellipsis_ratio": share(F.col("_ellipses"), F.col("_n_lines")),
    }).drop("_text", "_words", "_lines", "_letters", "_stops", "_bullets", "_ellipses", "_n_lines")


def verdict(rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The table as two columns: passes all rules, and the names of the failed ones."""
    ok, failed = F.lit(True), []
    for r in rules:
        fine = F.lit(True)
        if r.low is not None:
            fine = fine & (F.col(r.measure) >= r.low)
        if r.high is not None:
            fine = fine & (F.col(r.measure) <= r.high)
        ok = ok & fine
        failed.append(F.when(~fine, F.lit(r.name)))
    return ok, F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")


def quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the measures, ``base_failed``, ``failed_rules`` and ``kept``, row by row and without a shuffle.

    ``base_failed``: under 20 words, or over 30 % of the words in repeated windows.
    Null and empty texts fail it.  Repeated rows are judged alike; an empty table
    gives an empty one.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    ok, failed = verdict(rules)
    df = measures(docs, text).withColumn("base_failed", base)
    return df.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & ok)
