"""Word-level filters and entity aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import vocab
from quillmill.functions.rows import unroll_fields
from quillmill.functions.text import let, sentences, strip, unicode, words


def _bare(word: Column, marks: str) -> Column:
    return F.rtrim(F.lower(word), F.lit(marks))


def drop_stop_words(c: Column, stop=vocab.STOP_WORDS, keep=vocab.KEEP_WORDS) -> Column:
    """Sentence-aware: short sentences and each first and last word stay; keep beats stop."""
    droppable = sorted(set(stop) - set(keep))

    def prune(sentence: Column) -> Column:
        def of(ws: Column) -> Column:
            kept = F.filter(ws, lambda w, i: (i == 0) | (i == F.size(ws) - 1) | ~_bare(w, ".,!?;:").isin(droppable))
            return F.when(F.size(ws) <= 2, sentence).otherwise(F.array_join(kept, " "))

        return let(words(sentence), of)

    return F.array_join(F.transform(sentences(c), prune), " ")


def drop_stop_words_flat(c: Column, stop=vocab.FLAT_STOP_WORDS) -> Column:
    """Every word counts the same; sentence borders are ignored."""
    return F.array_join(F.filter(words(c), lambda w: ~_bare(w, ".,!?").isin(list(stop))), " ")


def drop_light_words(c: Column, stop=vocab.WEIGHT_STOP_WORDS) -> Column:
    """Longer sentences lose stop words that carry no capital and no digit."""

    def prune(sentence: Column) -> Column:
        def of(ws: Column) -> Column:
            # One regex per sentence: blanks stay, so bare words line up with the words.
            bare = F.split(F.regexp_replace(F.lower(F.array_join(ws, " ")), r"[^\p{L}\p{N}_ ]", ""), " ")
            both = F.zip_with(ws, bare, lambda w, b: F.struct(w.alias("w"), b.alias("b")))

            def heavy(x: Column, i: Column) -> Column:
                return ((i == 0) | (i == F.size(ws) - 1) | ~x["b"].isin(list(stop))
                        | x["w"].rlike(r"^\p{Lu}") | x["w"].rlike(r"\p{N}"))

            kept = F.transform(F.filter(both, heavy), lambda x: x["w"])
            return F.when(F.size(ws) <= 5, sentence).otherwise(F.array_join(kept, " "))

        return let(words(sentence), of)

    parts = F.split(c, r"(?<=[.!?])\s+")
    return F.array_join(F.transform(parts, prune), " ")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def _alias(phrase: Column) -> Column:
    parts = F.split(phrase, r"\s+")
    initials = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda w: F.substring(w, 1, 1))
    return F.concat(F.upper(F.array_join(initials, "")), F.lit("-"),
                    F.upper(F.substring(F.element_at(parts, -1), 1, 1)))


def with_aliases(df: DataFrame, text: str = "text", pattern: str = vocab.ALIAS_PHRASE) -> DataFrame:
    """Adds aliases: title-case phrases seen twice or more, first seen first, with their short form.

    Repeats are neighbours in the sorted matches, so counting is linear and
    stays inside the row.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(unicode(pattern)), F.lit(1))
    def repeated(phrases: Column) -> Column:
        return let(F.sort_array(phrases), lambda s: F.array_distinct(F.filter(s, lambda p, i: p == F.get(s, i + 1))))

    first_seen = let(found, lambda m: let(repeated(m), lambda r: F.filter(
        F.array_distinct(m), lambda p: F.array_contains(r, p))))
    return df.withColumn("aliases", F.transform(
        first_seen, lambda p: F.struct(p.alias("phrase"), _alias(p).alias("alias"))))


def alias_table(df: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = vocab.ALIAS_PHRASE) -> DataFrame:
    """One row per alias: key, phrase, alias."""
    return unroll_fields(with_aliases(df, text, pattern), [key], "aliases")


def alias_entities(df: DataFrame, text: str = "text", out: str = "text_out",
                   pattern: str = vocab.ALIAS_PHRASE) -> DataFrame:
    """Replace repeated phrases by their short form, first seen first."""
    replaced = F.aggregate("aliases", F.col(text), lambda t, a: F.replace(t, a["phrase"], a["alias"]))
    return with_aliases(df, text, pattern).withColumn(
        out, F.when(F.size("aliases") > 0, replaced).otherwise(F.col(text))).drop("aliases")
