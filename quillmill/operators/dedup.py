"""Redundant sentences in a document, repeated sentences and near copies in a corpus."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.rows import unroll
from quillmill.functions.skew import spread_join
from quillmill.functions.text import WORD, pairs, plain_sentences, sentences, terms
from quillmill.operators import nearcopies
from quillmill.operators.rules import PARAPHRASE, rewrite
from quillmill.operators.segment import by_document
from quillmill.session import stored

# Similarity above which a sentence is redundant.
REDUNDANT = 0.55
REDUNDANT_PLAIN = 0.7


def _jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / F.greatest(F.lit(1), F.size(a) + F.size(b) - common)


class _Kept:
    """Feature sets kept so far, by feature; tells whether a new set is similar to one of them.

    Overlaps with all kept sets are counted from the lists of the new set's
    features, so sets without a common feature cost nothing.
    """

    def __init__(self):
        self.holders: dict[int, array] = {}
        self.sizes = array("q")

    def near(self, features: np.ndarray, threshold: float) -> bool:
        lists = [np.frombuffer(h, np.int64) for f in features.tolist() if (h := self.holders.get(f)) is not None]
        if not lists:
            return False
        found = np.concatenate(lists)
        if 4 * len(found) < len(self.sizes):
            which, common = np.unique(found, return_counts=True)
        else:
            common = np.bincount(found)
            which = np.flatnonzero(common)
            common = common[which]
        union = len(features) + np.frombuffer(self.sizes, np.int64)[which] - common
        return bool((common / np.maximum(1, union) > threshold).any())

    def add(self, features: np.ndarray) -> None:
        for f in features.tolist():
            self.holders.setdefault(f, array("q")).append(len(self.sizes))
        self.sizes.append(len(features))


def _accepted(threshold: float):
    """Greedy pass over a document's sentences: one falls when similar, by words or by pairs, to a kept earlier one.

    The column function has the positions that stay.  Sentences without words take no part.
    """
    def passed(words, pairs) -> list[int]:
        by_word, by_pair, seen, kept = _Kept(), _Kept(), set(), []
        for pos, (w, b) in enumerate(zip(words, pairs)):
            if not len(w):
                continue
            same = w.tobytes()
            if (same, b.tobytes()) in seen or by_word.near(w, threshold) or (len(b) and by_pair.near(b, threshold)):
                continue
            seen.add((same, b.tobytes()))
            kept.append(pos)
            by_word.add(w)
            if len(b):
                by_pair.add(b)
        return kept

    def run(words: pa.Array, pairs: pa.Array) -> pa.Array:
        # A document at a time: sentences are views of the batch, never objects of all its documents.
        return pa.array([passed(w, b) for w, b in zip(_rows(words), _rows(pairs))], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")


def _rows(sets: pa.Array):
    """Of each document the hashes of its sentences, from arrays of arrays without nulls."""
    ends, cuts, hashes = sets.offsets.to_numpy(), sets.values.offsets.to_numpy(), sets.values.values.to_numpy()
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        own = cuts[a:b + 1].tolist()
        yield (hashes[i:j] for i, j in zip(own, own[1:]))


def _features(tokens: Column) -> Column:
    """The distinct words of each sentence as hashes, in one order."""
    return F.transform(tokens, lambda t: F.sort_array(F.array_distinct(F.transform(t, lambda w: F.xxhash64(w)))))


def _picked(kept: Column) -> Column:
    return F.array_join(F.transform(kept, lambda i: F.get("_ss", i)), " ")


def drop_redundant(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "text_out",
                   threshold: float = REDUNDANT, spread: bool = True) -> DataFrame:
    """Drop sentences too similar, by words or by word pairs, to a kept earlier one.

    Paraphrase markers go first; up to two sentences stay untouched; sentences
    without a word of three characters are dropped.  Column functions make the
    features; the pass, whose every step rests on the ones before, runs over
    their hashes in the row.  Texts are spread by key, nothing else moves.
    """
    staged = df.withColumn("_s", rewrite(F.col(text), PARAPHRASE))
    base = (by_document(staged, key) if spread else staged).withColumn("_ss", sentences(F.col("_s")))
    # Short documents take part without features.
    tokens = F.when(F.size("_ss") > 2, F.transform("_ss", lambda s: terms(s, 3))).otherwise(F.array().cast("array<array<string>>"))
    marked = base.withColumn("_t", tokens).withColumns(
        {"_w": _features(F.col("_t")), "_b": _features(F.transform("_t", lambda t: pairs(t)))})
    done = marked.withColumn("_k", _accepted(threshold)("_w", "_b"))
    return done.withColumn(out, F.when(F.size("_ss") <= 2, F.col("_s")).otherwise(_picked(F.col("_k")))).drop(
        "_s", "_ss", "_t", "_w", "_b", "_k")


def drop_redundant_plain(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "text_out",
                         threshold: float = REDUNDANT_PLAIN) -> DataFrame:
    """Variant: words of any length only; sentences without words are kept."""
    base = by_document(df, key).withColumn("_ss", plain_sentences(F.col(text)))
    marked = base.withColumn("_w", _features(F.transform("_ss", lambda s: terms(s))))
    none = F.transform("_w", lambda w: F.array().cast("array<bigint>"))
    done = marked.withColumn("_k", _accepted(threshold)(F.col("_w"), none))
    wordless = F.filter(F.transform("_w", lambda w, i: F.when(F.size(w) == 0, i)), lambda i: i.isNotNull())
    return done.withColumn(out, _picked(F.array_sort(F.concat("_k", wordless)))).drop("_ss", "_w", "_k")


def first_sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each distinct sentence of the corpus with its first place and number of uses.

    Grouping by the sentence pre-aggregates, so a sentence found everywhere
    reaches the reducer as one row per map task.
    """
    rows = unroll(df, [key], sentences(F.col(text)), "sentence", "pos")
    return (rows.groupBy("sentence").agg(F.min(F.struct(key, "pos")).alias("f"), F.count("*").alias("uses"))
            .select("sentence", F.col(f"f.{key}").alias(key), F.col("f.pos").alias("pos"), "uses"))


def dedup_sentences(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "text_out") -> DataFrame:
    """Keep every sentence only where the corpus shows it first."""
    kept = first_sentences(df, key, text).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("own"))
    return (df.join(kept, key, "left")
            .withColumn(out, F.coalesce(F.array_join(F.transform("own", lambda s: s["sentence"]), " "), F.lit("")))
            .drop("own"))


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Documents whose words nearly equal those of a smaller-keyed document; no such pair is overlooked.

    1. Documents with one word set collapse to the first of them.
    2. Each set is put in one order for all, rare words first.  Two sets can
       only reach the threshold if they share one of their first
       |x| - ceil(t|x|) + 1 words, so the sets meet on those alone.
    3. Sets that meet are compared by sketches inside the tasks; the best
       candidates of each are verified by their hashed words (``nearcopies``).

    Texts do not move, only 64-bit hashes of words.  Returns key, original,
    similarity: the best original per document, of equals the smallest.
    """
    # A cheap test for "has a word", so that the filter does not cut the words twice.
    sets = df.filter(F.col(text).rlike(WORD + "{3}")).select(key, F.sort_array(F.transform(
        F.array_distinct(terms(F.col(text), 3)), lambda w: F.xxhash64(w))).alias("hs"))
    digest = F.sha2(F.array_join(F.transform("hs", lambda h: h.cast("string")), " "), 256)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = stored(sets.select(key, "hs", digest.alias("digest")), "nearcopies-sets")
    reps = stored(marked.repartition(parts, "digest").groupBy("digest").agg(F.min(key).alias("original"), F.first("hs").alias("hs"), F.count("*").alias("n")), "nearcopies-reps")
    firsts = reps.filter("n > 1").select("digest", "original")
    copies = (spread_join(marked.select(key, "digest"), firsts, ["digest"], key)
              .filter(F.col(key) != F.col("original")).select(key, "original", F.lit(1.0).alias("similarity")))
    own = reps.filter(F.col("original").isNotNull()).select(F.col("original").cast("long").alias("key"), "hs")
    best = nearcopies.best_earlier(own, threshold, _jaccard, lambda df: stored(df, "nearcopies"))
    kind = df.schema[key].dataType
    near = best.select(F.col("a").cast(kind).alias(key), F.col("b").cast(kind).alias("original"), "similarity")
    return copies.unionByName(near)
