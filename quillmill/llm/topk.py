"""Exact top-k search: tiled integer products, partial selection, merged lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a candidate tile and of a query tile; a product holds one of each.
TILE = 2048
QUERY_TILE = 1024
SCALE = 256
#: Lists of one query that a step of the merge tree makes into one.
MERGED = 8


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null and holds finite components only."""
    fine = F.forall(vector, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return df.where(F.col(vector).isNotNull() & fine)


def tiles(df: DataFrame, key: str, vector: str, size: int, name: str) -> DataFrame:
    """Packs rows into tiles: number of the tile, ids and the vectors scaled to whole numbers.

    Rows stream through, so a task holds one tile; a task's last tile may be short.
    """

    def run(batches):
        kinds = pa.schema([("ids", pa.list_(pa.int64())), ("body", pa.binary()), ("width", pa.int32())])

        def packed(ids, rows):
            width = max(map(len, rows), default=0)
            flat = np.zeros((len(rows), width))
            for i, r in enumerate(rows):
                flat[i, : len(r)] = np.floor(SCALE * np.asarray(r, np.float64))
            return pa.RecordBatch.from_arrays([pa.array([ids], kinds.field(0).type), pa.array([flat.tobytes()], pa.binary()),
                                               pa.array([width], pa.int32())], schema=kinds)

        ids, rows = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            rows += batch.column(1).to_pylist()
            while len(ids) >= size:
                yield packed(ids[:size], rows[:size])
                ids, rows = ids[size:], rows[size:]
        if ids:
            yield packed(ids, rows)

    packed = df.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(
        run, "ids array<long>, body binary, width int")
    return packed.select(F.struct("ids", "body", "width").alias(name))


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows; the shorter rows are read as if filled with zeros."""
    width = min(q.shape[1], c.shape[1])
    q, c = q[:, :width], c[:, :width]
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(width, 1)
    if bound < 2.0 ** 53:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in q], object).reshape(q.shape) @ np.array(
        [[int(x) for x in r] for r in c], object).reshape(c.shape).T
    return np.array([[min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in r] for r in exact], np.int64).reshape(exact.shape)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of a row, ties to the smaller id."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(ids) - k)[len(ids) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding",
          shards: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products.

    Components count as floor(256 * x).  A query's own id is no candidate of it;
    ties go to the smaller id; a query with fewer candidates gets all of them.
    Null vectors and vectors with null or non-finite components take no part, and
    neither do null ids.  Vectors of another length are compared as if filled with
    zeros.  Repeated candidate rows are candidates each; a repeated query row asks
    once.  Scores beyond a long are cut to its range.  Very long vectors are
    multiplied whole.  Empty tables give no rows; other columns take no part.

    Both sides are packed into tiles, so what is shuffled are a few thousand rows'
    blocks.  Every query tile meets every candidate tile once: query tiles are
    repeated per shard, candidate tiles go to one shard each.  A task selects k per
    query and tile, then lists are merged by a tree over the shards, ``MERGED`` lists
    a step, so no task gets more than that many of a query.
    """
    spark = queries.sparkSession
    shards = shards or 2 * spark.sparkContext.defaultParallelism

    def ready(df: DataFrame) -> DataFrame:
        return usable(df.where(F.col(key).isNotNull()), vector).select(key, vector)

    q = tiles(ready(queries).dropDuplicates(), key, vector, QUERY_TILE, "q").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    c = tiles(ready(candidates), key, vector, TILE, "c").withColumn("shard", F.pmod(F.xxhash64("c.body"), F.lit(shards)).cast("int"))
    met = q.join(c.hint("shuffle_hash"), "shard").select("shard", "q", "c")
    kinds = pa.schema([("query_id", pa.int64()), ("shard", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        for batch in batches:
            for shard, qt, ct in zip(*[batch.column(i) for i in range(3)]):
                shard, qt, ct = shard.as_py(), qt.as_py(), ct.as_py()
                qi, ci = np.array(qt["ids"], np.int64), np.array(ct["ids"], np.int64)
                qv = np.frombuffer(qt["body"]).reshape(len(qi), qt["width"])
                cv = np.frombuffer(ct["body"]).reshape(len(ci), ct["width"])
                scores = product(qv, cv)
                out = ([], [], [])
                for i, row in zip(qi.tolist(), scores):
                    own = ci != i
                    ids, row = (ci, row) if own.all() else (ci[own], row[own])
                    best = best_of(row, ids, k)
                    out[0].append(np.full(len(best), i))
                    out[1].append(ids[best])
                    out[2].append(row[best])
                a, b, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(np.full(len(a), shard, np.int32)),
                                                  pa.array(b, pa.int64()), pa.array(s, pa.int64())], schema=kinds)

    found = met.mapInArrow(run, "query_id long, shard int, vec_id long, score long")
    while shards > MERGED:
        shards = -(-shards // MERGED)
        found = merged(found.withColumn("shard", F.floor(F.col("shard") / MERGED)), k, "query_id", "shard").drop("rank")
    return merged(found, k, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def merged(lists: DataFrame, k: int, *by: str | Column) -> DataFrame:
    """The best k of each group; a window limit keeps k per group and task before rows move."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("vec_id"))
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
