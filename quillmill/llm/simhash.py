"""SimHash near-duplicates: fingerprints, multi-index hashing, connected groups."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.components import components
from quillmill.llm.common import map_rows
from quillmill.session import fresh_path

BITS = 64
#: Bits of each byte value, and how many: fixed by what a byte is.
BIT_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Fingerprints of one bucket that a task compares at once; larger buckets are cut and their cuts compared pair by pair.
TILE = 20_000
#: What a comparison costs beside a probe.
CANDIDATE_COST = 0.02


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The majority bits of the shingles' XXH64, unsigned; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z fold, only ASCII blanks split
    if not words:
        return 0
    body = b" ".join(words)
    if len(words) <= width:
        h = np.array([xxhash.xxh64_intdigest(body, seed)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        first, last = (ends - sizes)[: len(words) - width + 1].tolist(), ends[width - 1:].tolist()
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(body[a:b], seed) for a, b in zip(first, last)), np.uint64, len(first))
    planes = h.view(np.uint8).reshape(-1, 8)  # little-endian machines: byte 0 is the lowest
    over = 0
    for k in range(8):
        ones = np.bincount(planes[:, k], minlength=256) @ BIT_OF
        over |= sum(1 << (8 * k + b) for b in range(8) if 2 * ones[b] > len(h))
    return over


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and mark (a hash of the text); null and blank texts have fingerprint zero."""

    def make(keys, texts, marks):
        yield {"doc_id": keys, "fp": [signed(fingerprint(t, width)) for t in texts], "mark": marks}

    return map_rows(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark")),
                    ["doc_id", "text", "mark"], "doc_id long, fp long, mark long", make)


def segments(count: int, radius: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius inside) of the segments to look up for ``count`` fingerprints.

    If ``radius`` bits differ over m segments, one of the first ``radius % m + 1``
    segments differs in at most ``radius // m`` bits or one of the others in one
    bit less.  The number of segments is the one with the least probes and
    expected candidates (a probe moves a row, a candidate is one comparison); every
    choice finds the same links.
    """
    best = None
    for m in range(1, max(2, radius + 1)):
        inner = [radius // m] * (radius % m + 1) + [radius // m - 1] * (m - radius % m - 1)
        sizes = [BITS // m + (i < BITS % m) for i in range(m)]
        balls = [sum(math.comb(b, i) for i in range(r + 1)) if r >= 0 else 0 for b, r in zip(sizes, inner)]
        cost = sum(ball * (1 + CANDIDATE_COST * count / 2.0 ** b) for b, ball in zip(sizes, balls))
        if best is None or cost < best[0]:
            starts = np.cumsum([0, *sizes]).tolist()
            best = cost, [(s, b, r) for s, b, r in zip(starts, sizes, inner) if r >= 0]
    return best[1]


def masks(start: int, bits: int, radius: int) -> list[int]:
    """The changes of at most ``radius`` bits inside a segment, no change first."""
    found, last = [0], [(0, -1)]
    for _ in range(radius):
        last = [(x | 1 << b, b) for x, top in last for b in range(top + 1, bits)]
        found += [x for x, _ in last]
    return found


def probes(nodes: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """A row for each fingerprint, segment and value near its own: bucket, home (its own value), fp."""
    def near(i: int, start: int, bits: int, radius: int):
        own = F.shiftrightunsigned("fp", start).bitwiseAND((1 << bits) - 1)
        changes = F.array(*[F.lit(m).cast("long") for m in masks(start, bits, radius)])
        return F.transform(changes, lambda m: F.struct(
            own.bitwiseXOR(m).bitwiseOR(F.lit(i << 56).cast("long")).alias("bucket"), (m == 0).alias("home")))

    parts = [near(i, *segment) for i, segment in enumerate(plan)]
    return nodes.select("fp", F.explode(F.concat(*parts)).alias("p")).select("p.bucket", "p.home", "fp")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def star(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that join exactly the connected fingerprints of one group, at most two for each member.

    A walk compares each member it reaches with those not yet reached, so a dense
    group costs little more than one comparison for each member.
    """
    if len(fps) <= 256:
        i, j = np.nonzero(np.triu(distance(fps[:, None], fps[None, :]) <= radius, 1))
        if len(i) <= 2 * len(fps):
            return list(zip(fps[i].tolist(), fps[j].tolist()))
    edges, rest = [], fps
    while len(rest) > 1:
        root, front, rest = rest[0], [rest[0]], rest[1:]
        while front and len(rest):
            near = distance(rest, front.pop()) <= radius
            if near.any():
                got = rest[near].tolist()
                edges += [(int(root), g) for g in got]
                front += [np.uint64(g) for g in got]
                rest = rest[~near]
    return edges


def links_of_buckets(batches, radius: int):
    """Edges of the groups in rows sorted by bucket and tile; a group may run over several batches."""

    def edges(keys, fps, homes):
        """All groups at once: groups of one fingerprint have no edges, others with a home member are walked."""
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
        sizes = ends - starts
        settled = np.add.reduceat(homes.astype(np.int64), starts) > 0
        pair = settled & (sizes == 2)
        a, b = fps[starts[pair]], fps[starts[pair] + 1]
        near = (distance(a, b) <= radius) & (a != b)
        out = [np.stack([a[near], b[near]], 1)]
        for s, e in zip(starts[settled & (sizes > 2)].tolist(), ends[settled & (sizes > 2)].tolist()):
            got = star(np.unique(fps[s:e]), radius)
            if got:
                out.append(np.array(got, np.uint64))
        return np.concatenate(out)

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[np.ndarray] = []

    def packed(rows: list[np.ndarray]):
        keys, fps, homes = (np.concatenate([r[i] for r in rows]) for i in range(3))
        found = edges(keys, fps, homes).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=schema)

    for batch in batches:
        group = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(group):
            continue
        fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        homes = batch.column(2).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(group, group[-1], "left"))
        if held and group[0] == held[-1][0][-1] and last == 0:
            held.append((group, fps, homes))  # one group goes on through the whole batch
            continue
        yield packed([*held, (group[:last], fps[:last], homes[:last])]) if held or last else pa.RecordBatch.from_arrays(
            [pa.array([], pa.int64())] * 2, schema=schema)
        held = [(group[last:], fps[last:], homes[last:])]
    if held:
        yield packed(held)


def near_links(nodes: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Edges a, b between distinct fingerprints that join exactly those with at most ``radius`` differing bits.

    ``nodes`` has distinct values ``fp``.  Not every link is returned, but every
    link joins two fingerprints that the edges connect.  Buckets of over ``tile``
    probes are cut by a hash of the fingerprint, and each pair of cuts is a group.
    """
    found = probes(nodes, segments(nodes.count(), radius))
    heavy = found.groupBy("bucket").count().where(F.col("count") > tile).select(
        "bucket", F.ceil(F.col("count") / (tile // 2)).cast("int").alias("cuts"))
    cut = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    pair = F.when(F.col("cuts").isNull(), F.array(F.lit(0))).otherwise(F.transform(
        F.sequence(F.lit(0), F.col("cuts") - 1), lambda o: F.least(o, F.col("cut")) * F.col("cuts") + F.greatest(o, F.col("cut"))))
    dealt = found.join(heavy, "bucket", "left").withColumn("cut", cut).withColumn("pair", F.explode(pair)).select(
        F.xxhash64("bucket", "pair").alias("grp"), "fp", "home")
    parts = found.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = dealt.repartition(int(parts), "grp").sortWithinPartitions("grp")

    def run(batches):
        yield from links_of_buckets(batches, radius)

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, the smallest id reachable.

    Texts without words share fingerprint zero and so one group.  A group of null
    ids only has a null component.  Repeated rows come back repeated.  The
    fingerprints (16 bytes a row) are written once to the shared folder, since
    they are read for the index and again for the result.
    """
    marked = stored_fingerprints(docs, key, text)
    return marked.join(labelled(marked, radius), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stored_fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    path = fresh_path(spark, "simhash")
    fingerprints(docs, key, text).write.parquet(path)
    return spark.read.parquet(path)


def labelled(marked: DataFrame, radius: int = 4) -> DataFrame:
    """fp, root (one fingerprint of its group), component_id for each distinct fingerprint of doc_id, fp."""
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = components(near_links(nodes.select("fp"), radius))  # node, root: linked fingerprints only
    grouped = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return grouped.join(least, "root").select("fp", "root", "component_id")


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """The rows of ``docs`` without those that copy another: of a group the row with the smallest id stays.

    Of rows that share this id the first by a hash of the text stays, and of equal
    rows one; a group of null ids keeps a row too.  Only ids and hashes move until
    the rows that stay are known; then each is joined to its row.
    """
    marked = stored_fingerprints(docs, key, text)
    return rows_that_stay(docs, marked.join(labelled(marked, radius), "fp"), key, text)


def rows_that_stay(docs: DataFrame, marked: DataFrame, key: str, text: str) -> DataFrame:
    """One row of ``docs`` for each ``root`` of ``marked`` (doc_id, mark, root), as ``one_of_each_group`` says."""
    rows = marked.groupBy("root", "doc_id", "mark").agg(F.count("*").alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "n")).alias("k"))
    keepers = first.select(F.col("k.doc_id").alias("_id"), F.col("k.mark").alias("_hash"), F.col("k.n").alias("_rows"))
    whole = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_mark"), F.struct("*").alias("row"))
    kept = whole.join(keepers, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_hash")))
    equal = kept.where("_rows > 1").groupBy("_id", "_hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.where("_rows = 1").select("row").union(equal.select("row")).select("row.*")
