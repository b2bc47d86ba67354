"""Sentence and chunk ranking: score, pick, regroup."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.functions import vocab
from quillmill.functions.rows import unroll
from quillmill.functions.text import let, plain_sentences, sentences, strip, terms, unicode, words
from quillmill.operators.segment import by_document

# Scores are rounded before ranking, so summation order cannot change a rank.
DIGITS = 9


def word_weights(weigh):
    """Column function: from each sentence's hashed words, the summed weight of its words.

    ``weigh(n, df, f, tf)`` gives the weight of each occurrence: n sentences, of which df hold the word, f uses in the
    document and tf in the sentence.  A document is counted at a time, on numbers that column functions have made, so
    no word becomes a row.
    """
    def of(n: int, found: np.ndarray, at: np.ndarray) -> np.ndarray:
        _, word, f = np.unique(found, return_inverse=True, return_counts=True)
        places, place, tf = np.unique(word * n + at, return_inverse=True, return_counts=True)
        df = np.bincount(places // n)
        return np.bincount(at, weights=weigh(n, df[word], f[word], tf[place]), minlength=n)

    def run(found: pa.Array) -> pa.Array:
        if not len(found):
            return pa.array([], pa.list_(pa.float64()))
        ends, cuts = found.offsets.to_numpy(), found.values.offsets.to_numpy()
        hashes, out = found.values.values.to_numpy(), []
        for a, b in zip(ends[:-1], ends[1:]):
            own = cuts[a:b + 1]
            at = np.repeat(np.arange(b - a), np.diff(own))
            out.append(of(int(b - a), hashes[own[0]:own[-1]], at) if len(at) else np.zeros(b - a))
        flat = np.concatenate(out) if out else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(flat, pa.float64()))

    return F.arrow_udf(run, "array<double>")


def hashed(ss: Column, tokens) -> Column:
    """The words of each sentence as 64-bit hashes; none for a null text."""
    return F.coalesce(F.transform(ss, lambda s: F.transform(tokens(s), lambda w: F.xxhash64(w))),
                      F.array().cast("array<array<bigint>>"))


def picked(order: Column, keep: Column) -> Column:
    """The sentences of ``ss`` whose entries in ``order`` (structs that end with ``pos``) are among the first ``keep``, in their own order."""
    best = F.sort_array(F.transform(F.slice(F.sort_array(order), F.lit(1), keep.cast("int")), lambda x: x["pos"]))
    return F.array_join(F.transform(best, lambda i: F.get("_ss", i)), " ")


def rank_tfidf(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "text_out",
               keep: float = 0.35, spread: bool = True) -> DataFrame:
    """Keep the best share of sentences; the first and last always stay.

    Summing idf over occurrences is the sum of tf * idf over words.  A document is
    ranked in its row: texts are spread by key, and nothing else moves.
    """
    raw = word_weights(lambda n, df, f, tf: np.log((n + 1) / (df + 1)))
    n = F.size("_ss")

    def entry(s: Column, i: Column) -> Column:
        edge = (i == 0) | (i == n - 1)
        boost = (F.when(edge, 1.8).otherwise(1.0) * F.when(s.endswith("?"), 1.5).otherwise(1.0)
                 * F.when(s.rlike(unicode(r"\b\d+\b")), 1.2).otherwise(1.0))
        score = F.round(F.get("_raw", i) / F.greatest(F.lit(1), F.size(words(s))) * boost, DIGITS)
        return F.struct(F.when(edge, 0).otherwise(1).alias("free"), (-score).alias("neg"), (-i).alias("late"), i.alias("pos"))

    base = (by_document(df, key) if spread else df).withColumn("_ss", sentences(F.col(text)))
    scored = base.withColumn("_raw", raw(hashed(F.col("_ss"), lambda s: terms(s, 4))))
    quota = F.greatest(F.lit(2), F.floor(n * F.lit(keep)))
    return scored.withColumn(out, F.when(n > 2, picked(F.transform("_ss", entry), quota)).otherwise(F.col(text))).drop("_ss", "_raw")


def rank_tfidf_plain(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "text_out",
                     keep: float = 0.4, stop=vocab.RANK_STOP_WORDS) -> DataFrame:
    """Variant: every word but stop words, each occurrence weighted by its count, nothing forced."""
    raw = word_weights(lambda n, df, f, tf: tf * np.log(n / (df + 1)))
    n = F.size("_ss")

    def entry(x: Column, i: Column) -> Column:
        score = F.round(x / F.greatest(F.lit(1), F.size(F.get("_h", i))), DIGITS)
        return F.struct((-score).alias("neg"), (-i).alias("late"), i.alias("pos"))

    tokens = hashed(F.col("_ss"), lambda s: F.filter(terms(s), lambda w: ~w.isin(list(stop))))
    scored = (by_document(df, key).withColumn("_ss", plain_sentences(F.col(text))).withColumn("_h", tokens)
              .withColumn("_raw", raw(F.col("_h"))))
    quota = F.greatest(F.lit(1), F.floor(n * F.lit(keep)))
    return scored.withColumn(out, F.when(n > 2, picked(F.transform("_raw", entry), quota)).otherwise(F.col(text))).drop(
        "_ss", "_h", "_raw")


def corpus_idf(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 4) -> DataFrame:
    """Inverse document frequency of every word over the whole corpus."""
    total = df.agg(F.count("*")).scalar()
    per_doc = unroll(df, [], F.array_distinct(terms(F.col(text), least)), "word")
    return (per_doc.groupBy("word").agg(F.count("*").alias("docs"))
            .select("word", "docs", F.log((total + 1) / (F.col("docs") + 1)).alias("idf")))


def rank_by_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", top: int = 1) -> DataFrame:
    """Best sentences of each document by corpus-wide weights.

    Words meet the word table one by one, without their document's other words:
    summing idf over occurrences is the sum of tf * idf over words, so only
    sentences are grouped.  The engine broadcasts the word table while it is
    small and splits the rows of hot words over tasks beyond that.
    """
    idf = corpus_idf(df, key, text).select("word", "idf")
    base = unroll(by_document(df.select(key, text), key), [key], sentences(F.col(text)), "s", "pos")
    # Counted before the words become rows, or it would be for each of them.
    counted = base.withColumn("wc", F.greatest(F.lit(1), F.size(words(F.col("s")))))
    uses = unroll(counted, [key, "pos", "wc"], terms(F.col("s"), 4), "word")
    scored = (uses.join(idf, "word").groupBy(key, "pos", "wc").agg(F.sum("idf").alias("raw"))
              .select(key, "pos", F.round(F.col("raw") / F.col("wc"), 6).alias("score")))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "pos"))
    return scored.withColumn("rk", rank).filter(F.col("rk") <= top)


def signal_scores(ss: Column, keywords) -> Column:
    """Distinct keyword hits per sentence; only words made of a to z count."""
    def score(s: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(unicode(r"\b([a-z]+)\b")), F.lit(1)))
        return F.size(F.filter(found, lambda w: w.isin(list(keywords))))

    return F.transform(ss, score)


def keep_signal(df: DataFrame, text: str = "text", out: str = "text_out", clusters=None) -> DataFrame:
    """Keep sentences at or above the upper median of keyword hits, plus the first and last."""
    keywords = sorted({w for ws in (clusters or vocab.SIGNAL_CLUSTERS).values() for w in ws})
    n = F.size("ss")
    scored = F.zip_with("ss", "sc", lambda s, c: F.struct(s.alias("s"), c.alias("c")))
    chosen = let(F.struct("cutoff", (n - 1).alias("last")), lambda b: F.transform(
        F.filter(scored, lambda x, i: (x["c"] >= b["cutoff"]) | (i == 0) | (i == b["last"])), lambda x: x["s"]))
    return (df.withColumn("ss", sentences(F.col(text)))
            .withColumn("sc", signal_scores(F.col("ss"), keywords))
            .withColumn("cutoff", F.greatest(F.lit(1), F.get(F.sort_array("sc"), F.floor(n / 2).cast("int"))))
            .withColumn(out, F.when(n <= 2, F.col(text)).otherwise(F.array_join(F.array_distinct(chosen), " ")))
            .drop("ss", "sc", "cutoff"))


def keep_signal_substring(df: DataFrame, text: str = "text", out: str = "text_out",
                          signals=vocab.SIGNAL_SUBSTRINGS) -> DataFrame:
    """Sentences of more than five words holding a signal; else the first half."""
    def hit(s: Column) -> Column:
        low = F.lower(s)
        found = low.contains(signals[0])
        for w in signals[1:]:
            found = found | low.contains(w)
        return (F.size(words(s)) > 5) & found

    half = F.greatest(F.lit(1), F.floor(F.size("ss") / 2).cast("int"))
    return (df.withColumn("ss", plain_sentences(F.col(text)))
            .withColumn("high", F.filter("ss", hit))
            .withColumn(out, F.array_join(F.when(F.size("high") > 0, F.col("high"))
                                          .otherwise(F.slice("ss", F.lit(1), half)), " "))
            .drop("ss", "high"))


def cluster_profile(df: DataFrame, group: str, text: str = "text", clusters=None) -> DataFrame:
    """Keyword hits per cluster and group.

    The keyword table is a fixed list, so it is broadcast, and words outside it
    are gone before anything is grouped.
    """
    clusters = clusters or vocab.SIGNAL_CLUSTERS
    rows = [(w, c) for c, ws in clusters.items() for w in ws]
    lookup = df.sparkSession.createDataFrame(rows, "word string, cluster string")
    hits = unroll(df, [group], terms(F.col(text)), "word").join(F.broadcast(lookup), "word")
    return hits.groupBy(group).pivot("cluster", sorted(clusters)).agg(F.count("word")).na.fill(0)


BULLET = r"(?m)^\s*[-*•]\s+"
NUMBERED = r"(?m)^\s*\d+[.)\s]\s+"


def condense(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "text_out",
             least_words: int = 60, words_each: int = 50, spread: bool = True) -> DataFrame:
    """About one sentence per fifty words, by word frequency in the document."""
    flat = F.regexp_replace(F.regexp_replace(F.col(text), BULLET, "\n"), NUMBERED, "\n")
    raw = word_weights(lambda n, df, f, tf: f / n * np.log(n / f))
    n = F.size("_ss")

    def entry(x: Column, i: Column) -> Column:
        score = F.round(x / F.greatest(F.lit(1), F.size(F.get("_h", i))), DIGITS)
        return F.struct(F.when(i == 0, 0).otherwise(1).alias("free"), (-score).alias("neg"), i.alias("pos"))

    staged = (by_document(df, key) if spread else df).withColumn("_flat", flat)
    scored = (staged.withColumn("_wc", F.size(words(F.col("_flat")))).withColumn("_ss", sentences(F.col("_flat")))
              .withColumn("_h", hashed(F.col("_ss"), lambda s: terms(s, 4))).withColumn("_raw", raw(F.col("_h"))))
    target = F.least(F.greatest(F.lit(2), F.floor(F.col("_wc") / words_each)), n - 1)
    applies = (F.col("_wc") >= least_words) & (n > 2)
    return scored.withColumn(out, F.when(applies, picked(F.transform("_raw", entry), target)).otherwise(F.col(text))).drop(
        "_flat", "_wc", "_ss", "_h", "_raw")


def condense_blocks(df: DataFrame, text: str = "text", out: str = "text_out", block: int = 100,
                    per_block: int = 2) -> DataFrame:
    """First sentences of each block of a hundred words."""
    def heads(ws: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(ws), F.lit(1)), F.lit(block))

        def head(start: Column) -> Column:
            part = F.array_join(F.slice(ws, start, F.lit(block)), " ")
            return F.array_join(F.slice(F.split(part, r"(?<=[.!?])\s+"), 1, per_block), " ")

        return F.array_join(F.transform(starts, head), " ")

    return df.withColumn(out, let(words(F.col(text)), heads))


def keep_anchored(df: DataFrame, text: str = "text", out: str = "text_out", anchors=None) -> DataFrame:
    """Sentences with an entity anchor; too few, and the first half stays instead."""
    patterns = list((anchors or vocab.ENTITY_ANCHORS).values())

    def anchored(s: Column) -> Column:
        found = s.rlike(unicode(patterns[0]))
        for p in patterns[1:]:
            found = found | s.rlike(unicode(p))
        return found

    n = F.size("ss")
    least = F.greatest(F.lit(2), F.floor(n / 2).cast("int"))
    return (df.withColumn("ss", sentences(F.col(text)))
            .withColumn("kept", F.filter("ss", anchored))
            .withColumn(out, F.when(n <= 2, F.col(text))
                        .when(F.size("kept") < least, F.array_join(F.slice("ss", F.lit(1), least), " "))
                        .otherwise(F.array_join("kept", " ")))
            .drop("ss", "kept"))


def anchor_inventory(df: DataFrame, key: str = "doc_id", text: str = "text", anchors=None) -> DataFrame:
    """Hits of each anchor type per document, in long form."""
    anchors = anchors or vocab.ENTITY_ANCHORS
    counted = df.select(key, *[F.regexp_count(F.col(text), F.lit(unicode(p))).alias(k) for k, p in anchors.items()])
    return counted.unpivot([key], list(anchors), "anchor", "hits").filter("hits > 0")


def chunks(c: Column) -> Column:
    """Paragraphs packed greedily until a chunk reaches its target size."""
    target = F.greatest(F.lit(200), F.floor(F.length(c) / 15).cast("int"))
    return let(F.struct(c.alias("text"), target.alias("size")), lambda b: _pack(b["text"], b["size"]))


def _pack(c: Column, target: Column) -> Column:
    parts = F.filter(F.transform(F.split(c, r"\n\s*\n|\n(?=#{1,6}\s)"), strip), lambda p: p != "")
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), empty.alias("open"), F.lit(0).alias("size"))

    def pack(state: Column, part: Column) -> Column:
        opened = F.array_append(state["open"], part)
        size = state["size"] + F.length(part)
        closed = F.struct(F.array_append(state["done"], F.array_join(opened, "\n")).alias("done"),
                          empty.alias("open"), F.lit(0).alias("size"))
        return F.when(size >= target, closed).otherwise(
            F.struct(state["done"].alias("done"), opened.alias("open"), size.alias("size")))

    def finish(state: Column) -> Column:
        rest = F.array_append(state["done"], F.array_join(state["open"], "\n"))
        return F.when(F.size(state["open"]) > 0, rest).otherwise(state["done"])

    return F.aggregate(parts, start, pack, finish)


def chunk_score(chunk: Column, position: Column, total: Column) -> Column:
    return let(F.struct(chunk.alias("chunk"), position.alias("pos"), total.alias("total"), words(chunk).alias("ws")),
               lambda b: _score(b["chunk"], b["pos"], b["total"], b["ws"]))


def _score(chunk: Column, position: Column, total: Column, ws: Column) -> Column:
    n = F.size(ws)
    unique = F.size(F.array_distinct(F.transform(ws, F.lower)))
    numbers = F.regexp_count(chunk, F.lit(unicode(r"\b\d+(?:\.\d+)?%?\b")))
    titles = F.regexp_count(chunk, F.lit(unicode(vocab.TITLE_PHRASE)))
    actions = F.regexp_count(chunk, F.lit(unicode("(?i)" + vocab.ACTION_WORDS)))
    raw = (unique / n * 3.0 + F.least(numbers * 0.5, F.lit(3.0)) + F.least(titles * 0.3, F.lit(2.0))
           + F.when(position == 0, 2.0).when(position == total - 1, 1.5).otherwise(0.0)
           + F.least(actions * 0.4, F.lit(2.0)))
    scaled = raw * F.when(n < 20, 0.5).when(n > 500, 0.8).otherwise(1.0)
    return F.when(n == 0, 0.0).otherwise(F.round(scaled, DIGITS))


def chunk_table(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = 2000) -> DataFrame:
    """Scored chunks of long documents: key, pos, chunk, total, score."""
    cut = df.filter(F.length(text) >= threshold).select(key, chunks(F.col(text)).alias("cs"))
    return (unroll(cut, [key, F.size("cs").alias("total")], "cs", "chunk", "pos")
            .withColumn("score", chunk_score(F.col("chunk"), F.col("pos"), F.col("total"))))


def keep_chunks(df: DataFrame, text: str = "text", out: str = "text_out", threshold: int = 2000,
                most: int = 8) -> DataFrame:
    """Best chunks of a long text in their own order, each marked with its index."""
    total = F.size("cs")
    scored = let(F.col("cs"), lambda cs: F.transform(cs, lambda c, i: F.struct(
        (-chunk_score(c, i, F.size(cs))).alias("neg"), i.alias("pos"), c.alias("chunk"))))
    best = F.slice(F.array_sort("scored"), 1, most)
    ordered = F.array_sort(F.transform("best", lambda b: F.struct(b["pos"].alias("pos"), b["chunk"].alias("chunk"))))
    marked = F.transform(ordered, lambda b: F.concat(F.lit("[§"), b["pos"].cast("string"), F.lit("] "), b["chunk"]))
    none = F.array().cast("array<string>")
    return (df.withColumn("cs", F.when(F.length(text) >= threshold, chunks(F.col(text))).otherwise(none))
            .withColumn("scored", F.when(total > 2, scored))
            .withColumn("best", best)
            .withColumn(out, F.when(F.col("best").isNull(), F.col(text))
                        .otherwise(F.array_join(marked, "\n---\n")))
            .drop("cs", "scored", "best"))
