"""Redundant sentences of documents of any length, with a document's sentences spread over tasks.

The greedy rule (a sentence falls when it is similar to a kept earlier one) is the
first maximal independent set, in sentence order, of the graph of similar
sentences.  It is found in rounds, without ever gathering a document or listing
the pairs of a group of similar sentences:

1. Sentences of one document with equal features collapse to the first of them.
2. Features are ordered rarest first.  Similar sentences share one of their first
   |x| - floor(t|x|) features (prefix filter), so only those rows are kept.  Sentences
   move once, in blocks of ``BLOCK`` of a document, before they grow into features:
   where a document is one block, both steps end in that task.
3. In each round every open sentence is compared with the first ``heads`` open
   holders of each of its prefix features, filtered by length and position.
4. A sentence is complete when it is itself among the first holders of all its
   features: then every earlier open sentence similar to it is known.  Complete
   sentences without an open or kept blocker are kept, what is similar to a kept one
   falls, and this is repeated until nothing changes.
5. The next round looks further ahead.

A kept sentence is among the heads of all its features, so every open sentence that
could be similar has met it; kept ones need not be looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.functions.rows import unroll, unroll_fields
from quillmill.functions.skew import SALTS
from quillmill.functions.text import pairs, plain_sentences, sentences, terms
from quillmill.operators import dedup
from quillmill.operators.rules import PARAPHRASE, rewrite
from quillmill.session import fresh_path

#: Documents of more sentences than this are spread; shorter ones pass in their row, with the same result.
SPREAD_FROM = 4096
#: Holders of a feature looked at in the first round, and the growth of this number per round.
HEADS, GROWTH = 64, 8
#: Copies of the heads of one feature, all tasks together; later rounds have more heads and less to spread.
SPREAD_HEADS = 1024
#: Sentences of a document that move together.
BLOCK = 4096
#: Slots by which sentences are picked before they move; the slots of any number of sentences are few enough to broadcast.
SLOTS = 1 << 20
SLACK = 1e-6
SENTENCE = ["key", "pos"]


class _Tables:
    """Tables of one run below the shared folder; writing one cuts its lineage."""

    def __init__(self, spark):
        self.spark, self.root, self.n = spark, fresh_path(spark, "redundancy"), 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def _meet(big: DataFrame, small: DataFrame, on: list[str], by: str, salts: int = SALTS) -> DataFrame:
    """Join of a table with hot keys and one of few rows per key, which goes only to the sub-keys that the other has."""
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return dealt.join(dealt.select(*on, "_salt").distinct().join(small, on), [*on, "_salt"]).drop("_salt")


def _first_of_equals(sets: DataFrame, within: list[str]) -> DataFrame:
    """(``within``, pos, w, b): sentences of equal features collapse to the first of them."""
    digest = F.sha2(F.concat_ws(" ", F.array_join(F.transform("w", lambda h: h.cast("string")), ","),
                                F.array_join(F.transform("b", lambda h: h.cast("string")), ",")), 256)
    return sets.groupBy(*within, digest.alias("digest")).agg(F.min(F.struct("pos", "w", "b")).alias("s")).select(*within, "s.*")


def _features(own: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each feature of a sentence: kind (word, pair) and hash."""
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("w").alias("hs")), F.struct(F.lit(1).alias("kind"), F.col("b").alias("hs")))
    return unroll(unroll_fields(own, keep, both), [*keep, "kind"], "hs", "h")


def _with_prefixes(rows: DataFrame, sentence: list[str], threshold: float) -> DataFrame:
    """(key, pos, w, b, fs): sentences from their features and the number ``df`` of the document's sentences with each.

    ``fs`` has the features (kind, size, at, h) on which similar sentences meet, with their place in the sentence.
    Features of a single sentence come first in every order and can join nothing: only their number counts.
    """
    def hashes(kind: int) -> Column:
        return F.array_sort(F.transform(F.filter("all", lambda f: f["kind"] == kind), lambda f: f["h"]))

    def prefix(kind: int, size: Column) -> Column:
        shared = F.array_sort(F.transform(F.filter("all", lambda f: (f["kind"] == kind) & (f["df"] > 1)),
                                          lambda f: F.struct(f["df"].alias("df"), f["h"].alias("h"))))
        single = size - F.size(F.filter("all", lambda f: (f["kind"] == kind) & (f["df"] > 1)))
        first = size - F.floor(size * F.lit(threshold) - SLACK) - single
        return F.transform(F.slice(shared, F.lit(1), F.greatest(first, F.lit(0)).cast("int")), lambda f, i: F.struct(
            F.lit(kind).alias("kind"), size.alias("size"), (single + i).alias("at"), f["h"].alias("h")))

    whole = rows.groupBy(*sentence).agg(F.collect_list(F.struct("kind", "h", "df")).alias("all"))
    sized = whole.select(*SENTENCE, "all", hashes(0).alias("w"), hashes(1).alias("b"))
    return sized.select(*SENTENCE, "w", "b", F.concat(prefix(0, F.size("w")), prefix(1, F.size("b"))).alias("fs"))


def _prepared(sets: DataFrame, threshold: float) -> DataFrame:
    """(key, pos, w, b, fs) of the first of equal sentences, from (key, block, n, pos, w, b), of which each block is in one task.

    A document of one block, as ``n`` tells, has all its features there.  For others they are counted over tasks.
    """
    worded = sets.filter(F.size("w") > 0)
    here = ["key", "block"]
    rows = _features(_first_of_equals(worded.filter(F.col("n") <= BLOCK), here), [*here, "pos"])
    counted = rows.withColumn("df", F.count("*").over(W.partitionBy(*here, "kind", "h")))
    spread = _features(_first_of_equals(worded.filter(F.col("n") > BLOCK), ["key"]), SENTENCE)
    holders = spread.groupBy("key", "kind", "h").agg(F.count("*").alias("df"))
    return _with_prefixes(counted, [*here, "pos"], threshold).unionByName(
        _with_prefixes(_meet(spread, holders, ["key", "kind", "h"], "pos"), SENTENCE, threshold))


def _named(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sentences that the pairs (key, pos, by) name, and few others: they are picked before any of them moves."""
    def slot(pos: str) -> Column:
        return F.pmod(F.xxhash64("key", F.col(pos).cast("long")), F.lit(SLOTS)).alias("_slot")

    slots = pairs.select(F.explode(F.array(slot("pos"), slot("by"))).alias("_slot")).distinct()
    return own.withColumn("_slot", slot("pos")).join(F.broadcast(slots), "_slot", "left_semi").drop("_slot")


def _similar(open_rows: DataFrame, heads: DataFrame, own: DataFrame, threshold: float, salts: int, put=lambda df: df) -> DataFrame:
    """Pairs (key, pos, by): an open sentence and an earlier head that is similar to it.

    Heads are repeated up to ``salts`` times, so that a feature held by most sentences is joined in many tasks.
    """
    meet = ["key", "kind", "h"]
    early = heads.select(*meet, F.col("pos").alias("by"), F.col("size").alias("bsize"), F.col("at").alias("bat"))
    # The first common feature of a similar pair leaves room for the overlap that the threshold asks for.
    room = F.least(F.col("size") - F.col("at"), F.col("bsize") - F.col("bat"))
    asked = F.lit(threshold / (1 + threshold)) * (F.col("size") + F.col("bsize")) - SLACK
    fits = ((F.col("by") < F.col("pos")) & (F.col("bsize") >= F.col("size") * F.lit(threshold) - SLACK)
            & (F.col("size") >= F.col("bsize") * F.lit(threshold) - SLACK) & (room >= asked))
    candidates = put(_meet(open_rows, early, meet, "pos", salts).filter(fits).select("key", "pos", "by").distinct())
    some = put(_named(own, candidates).select(*SENTENCE, "w", "b"))
    other = some.select("key", F.col("pos").alias("by"), F.col("w").alias("bw"), F.col("b").alias("bb"))
    sides = _meet(candidates, other, ["key", "by"], "pos").join(some, SENTENCE)
    near = F.greatest(dedup._jaccard(F.col("w"), F.col("bw")), dedup._jaccard(F.col("b"), F.col("bb")))
    return sides.filter(near > threshold).select("key", "pos", "by")


def _settle(tables: _Tables, complete: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept and fallen sentences, as far as the known edges decide them."""
    blocker = [F.col("key"), F.col("by").alias("pos")]
    kept = tables.put(complete.join(edges, SENTENCE, "left_anti"))
    fallen = None
    fresh = kept
    while True:
        hit = edges.join(fresh.select("key", F.col("pos").alias("by")), ["key", "by"], "left_semi").select(*SENTENCE).distinct()
        hit = tables.put(hit if fallen is None else hit.join(fallen, SENTENCE, "left_anti"))
        if hit.isEmpty():
            return kept, hit if fallen is None else fallen
        fallen = hit if fallen is None else tables.put(fallen.unionByName(hit))
        # What fell blocks nothing; only edges between sentences still open are looked at again.
        edges = tables.put(edges.join(fallen, SENTENCE, "left_anti")
                           .join(fallen.select("key", F.col("pos").alias("by")), ["key", "by"], "left_anti")
                           .select("key", "pos", "by"))
        fresh = tables.put(complete.join(fallen, SENTENCE, "left_anti").join(kept, SENTENCE, "left_anti")
                           .join(edges, SENTENCE, "left_anti"))
        if fresh.isEmpty():
            return kept, fallen
        kept = tables.put(kept.unionByName(fresh))


def greedy_kept(features: DataFrame, threshold: float, heads: int = HEADS) -> DataFrame:
    """Sentences that the greedy pass keeps: (key, pos), from a table (key, pos, w, b).

    ``w`` and ``b`` are distinct hashed words and word pairs.  Sentences without words are not in the result.
    """
    if "n" not in features.columns:
        long = features.groupBy("key").agg((F.max("pos") + 1).alias("n"))
        features = features.join(long, "key", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    return _kept(_in_blocks(features), threshold, heads)


def _in_blocks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col("pos") / BLOCK)).repartition("key", "block")


def _kept(sets: DataFrame, threshold: float, heads: int = HEADS) -> DataFrame:
    """``greedy_kept`` of sentences whose blocks are in one task each: (key, block, n, pos, w, b)."""
    tables = _Tables(sets.sparkSession)
    own = tables.put(_prepared(sets, threshold))
    rows = tables.put(unroll_fields(own, SENTENCE, "fs"))
    done = [own.filter(F.size("fs") == 0).select(*SENTENCE)]
    while not rows.isEmpty():
        rank = F.row_number().over(W.partitionBy("key", "kind", "h").orderBy("pos"))
        first = tables.put(rows.withColumn("rank", rank).filter(F.col("rank") <= heads).drop("rank"))
        whole = rows.groupBy(*SENTENCE).agg(F.count("*").alias("n"))
        complete = tables.put(first.groupBy(*SENTENCE).agg(F.count("*").alias("n")).join(whole, [*SENTENCE, "n"], "left_semi")
                              .select(*SENTENCE))
        edges = tables.put(_similar(rows, first, own, threshold, max(1, SPREAD_HEADS // heads), tables.put))
        kept, fallen = _settle(tables, complete, edges)
        done.append(kept)
        rows = tables.put(rows.join(kept.unionByName(fallen), SENTENCE, "left_anti"))
        heads *= GROWTH
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _spread(df: DataFrame, cut: Column, least: int, threshold: float, wordless: bool, with_pairs: bool) -> DataFrame:
    """``df`` with the kept text of each document as ``_kept``; null where no sentence stays.

    The row's own number stands for the document, so rows with a repeated or null key stay apart.
    """
    none = F.array().cast("array<bigint>")

    def sets(rows: DataFrame) -> DataFrame:
        words = rows.withColumn("t", terms(F.col("sentence"), least))
        return words.select("key", "block", "n", "pos", _hashes(F.col("t")).alias("w"), (_hashes(pairs(F.col("t"))) if with_pairs else none).alias("b"))

    # Sentences move before they grow into features; a long document lies in one row until here, and again at the end.
    whole = df.select(F.col("_row").alias("key"), cut.alias("_ss")).withColumn("n", F.size("_ss"))
    rows = unroll(whole, ["key", "n"], "_ss", "sentence", "pos")
    kept = _kept(sets(_in_blocks(rows)), threshold)
    if wordless:
        bare = sets(rows.withColumn("block", F.lit(0))).filter(F.size("w") == 0)
        kept = kept.unionByName(bare.select(*SENTENCE))
    chosen = kept.groupBy(F.col("key").alias("_row")).agg(F.array_sort(F.collect_list("pos")).alias("_at"))
    # The array of one element keeps the cut from being done once per sentence.
    picked = F.transform(F.array(cut), lambda ss: F.array_join(F.transform("_at", lambda i: F.get(ss, i)), " "))
    return df.join(chosen, "_row", "left").withColumn("_kept", F.element_at(picked, 1)).drop("_at")


def _hashes(tokens: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda w: F.xxhash64(w))))


def drop_redundant_any(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "text_out",
                       threshold: float = dedup.REDUNDANT, plain: bool = False, spread_from: int = SPREAD_FROM) -> DataFrame:
    """``dedup.drop_redundant`` (``plain``: ``drop_redundant_plain``) for documents of any number of sentences.

    Documents of more than ``spread_from`` sentences have their sentences spread over tasks, the others take the pass
    in their row; both give the same text.  Null texts give null, empty ones an empty text; rows with one key
    are documents of their own.  Only the resulting text of a document is gathered in one row.
    """
    cut = plain_sentences(F.col("_s")) if plain else sentences(F.col("_s"))
    # The caller's columns travel as one, so that none can clash with those made here.
    staged = df.select(F.struct("*").alias("row"), (F.col(text) if plain else rewrite(F.col(text), PARAPHRASE)).alias("_s"))
    is_long = F.coalesce(F.size(cut) > max(spread_from, 2), F.lit(False))
    run = dedup.drop_redundant_plain if plain else dedup.drop_redundant
    short = run(staged.filter(~is_long).select("row", F.col(f"row.`{key}`").alias("key"), F.col(f"row.`{text}`").alias("text")),
                "key", "text", "_out", threshold)
    tables = _Tables(df.sparkSession)
    long = tables.put(staged.filter(is_long).withColumn("_row", F.monotonically_increasing_id()))
    done = short.select("row", "_out")
    if not long.isEmpty():
        kept = _spread(long, cut, 1 if plain else 3, threshold, plain, not plain)
        done = done.unionByName(kept.select("row", F.coalesce("_kept", F.lit("")).alias("_out")))
    rest = [F.col(f"row.`{c}`").alias(c) for c in df.columns if c != out]
    return done.select(*rest, F.col("_out").alias(out))
