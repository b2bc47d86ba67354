"""Merkle manifest of a table: trees whose parents keep the hash state before each child slot, folded from there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm import midstate
from quillmill.llm.common import give_back
from quillmill.session import fresh_path

#: Children of a node, levels that one task builds above a block of nodes, and nodes of such a block.
FANOUT = 3
LEVELS = 6
BLOCK = FANOUT ** LEVELS
#: Nodes that a task holds, beyond one block.
HELD = 16384
#: One level of a path: the parent's state before the child's slot, the other children in order, the slot, their number.
STEP = np.dtype([("state", "<u4", 8), ("others", "<u4", (FANOUT - 1, 8)), ("slot", "u1"), ("run", "u1")])


def leaf_digest(columns: dict[str, Column]) -> Column:
    """SHA-256 of the columns one after the other: ``-`` for null, else the number of bytes, ``:`` and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
             for c in columns.values()]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def placed(rows: DataFrame, order: list[str], path: str) -> DataFrame:
    """``rows`` with their place and the number of rows in their group ``grp``, null being a group of its own.

    Rows are sorted over all tasks, whatever the size of a group; each sorted part
    counts its groups, and running sums over these counts, one per part and group,
    give the place at which each part goes on.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["grp", *order, "given"]  # rows alike in all else lie in the order of the input, so many of them are cut too
    rows.withColumn("given", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop(
        "given").withColumn("mark", F.monotonically_increasing_id()).write.parquet(f"{path}/sorted")
    ordered = spark.read.parquet(f"{path}/sorted").select(
        "*", F.shiftright("mark", 33).alias("part"), F.col("mark").bitwiseAND((1 << 33) - 1).alias("seq")).drop("mark")
    every = Window.partitionBy("grp")
    ordered.groupBy("grp", "part").agg(F.min("seq").alias("first"), F.count("*").alias("n")).select(
        F.col("grp").alias("run_grp"), F.col("part").alias("run_part"), F.sum("n").over(every).alias("size"),
        (F.sum("n").over(every.orderBy("part")) - F.col("n") - F.col("first")).alias("shift")).write.parquet(f"{path}/runs")
    runs = spark.read.parquet(f"{path}/runs")
    return ordered.join(runs, (F.col("part") == F.col("run_part")) & F.col("grp").eqNullSafe(F.col("run_grp"))).withColumn(
        "pos", F.col("seq") + F.col("shift")).drop("run_grp", "run_part", "part", "seq", "shift")


class Level:
    """One level of the trees over the held nodes, seen from the nodes at the bottom."""

    def __init__(self, live: np.ndarray, state: np.ndarray, others: list[np.ndarray], slot: np.ndarray, run: np.ndarray):
        self.live, self.state, self.others, self.slot, self.run = live, state, others, slot, run


def climb(pos: np.ndarray, size: np.ndarray, digest: np.ndarray) -> Iterator[Level | np.ndarray]:
    """The levels above whole blocks of nodes, then the digests of the blocks' tops.

    A block of a larger group rises ``LEVELS`` levels, whatever it holds; the only
    block of a group rises until one node remains.  Parents read their children
    left to right and keep a copy of their state before each.
    """
    block = np.cumsum(pos % BLOCK == 0) - 1
    rises = (size > BLOCK)[pos % BLOCK == 0]
    at = pos % BLOCK
    under = np.arange(len(pos))  # of each bottom node, its node on this level
    for _ in range(LEVELS):
        goes = (rises | (np.bincount(block) > 1))[block]
        if not goes.any():
            break
        parent = np.where(goes, at // FANOUT, at)
        opens = np.concatenate([[True], (block[1:] != block[:-1]) | (parent[1:] != parent[:-1])])
        first = np.flatnonzero(opens)
        up = np.cumsum(opens) - 1
        run = np.diff(np.append(first, len(at)))
        slot = np.arange(len(at)) - first[up]
        words = midstate.hex_block(digest)
        state = midstate.start(len(first))
        kept = np.empty_like(digest)
        for k in range(FANOUT):
            has = np.flatnonzero(run > k)
            child = first[has] + k
            kept[:, child] = state[:, has]
            state[:, has] = midstate.advance(state[:, has], words[:, child])
        grown = digest[:, first].copy()
        hashed = goes[first]
        grown[:, hashed] = midstate.finish(state[:, hashed], run[hashed])
        node, f = under, first[up[under]]
        others = [digest[:, np.minimum(f + k + (k >= slot[node]), len(at) - 1)] for k in range(FANOUT - 1)]
        yield Level(goes[node], kept[:, node], others, slot[node], run[up[node]])
        under, block, at, digest = up[under], block[first], parent[first], grown
    yield digest


class Fold:
    """Digests folded upwards: the kept state goes on with the replacement and the children to its right.

    Beside them runs the digest of all other children met, level by level, left to right.
    """

    def __init__(self, digest: np.ndarray, proof: np.ndarray | None = None, met: np.ndarray | None = None):
        self.digest = digest
        self.proof = midstate.start(digest.shape[1]) if proof is None else proof
        self.met = np.zeros(digest.shape[1], np.int64) if met is None else met

    def rise(self, level: Level) -> None:
        state = midstate.advance(level.state, midstate.hex_block(self.digest))
        for k, other in enumerate(level.others):
            there = level.live & (k < level.run - 1)
            words = midstate.hex_block(other)
            for which, what in ((there & (k >= level.slot), state), (there, self.proof)):
                if which.any():
                    what[:, which] = midstate.advance(what[:, which], words[:, which])
        self.met = self.met + np.where(level.live, level.run - 1, 0)
        self.digest = np.where(level.live, midstate.finish(state, level.run), self.digest)


def whole_blocks(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.Table]:
    """Tables of whole blocks from batches sorted by block and place."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < HELD:
            continue
        table = pa.Table.from_batches(held)
        end = int(np.flatnonzero(table.column(place).to_numpy() % BLOCK == 0)[-1])
        if end:
            yield table.slice(0, end).combine_chunks()
        held = table.slice(end).to_batches()
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def in_blocks(nodes: DataFrame) -> DataFrame:
    """Each block of nodes in one task, in order; a block is at most ``BLOCK`` rows."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).repartition(parts, "grp", "block").sortWithinPartitions(
        "grp", "block", "pos")


def tops_of(table: pa.Table, pos: np.ndarray, digest: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """grp, number and group size in blocks, digest of each block's top."""
    first = pa.array(np.flatnonzero(pos % BLOCK == 0))
    grp, block, size = (table.column(c).combine_chunks().take(first) for c in ("grp", "block", "size"))
    return grp, block, pa.array(-(-size.to_numpy() // BLOCK)), pa.array(midstate.to_bytes(digest), pa.binary())


def folded_leaves(leaves: DataFrame) -> DataFrame:
    """Rows of two kinds: leaves folded to the top of their block, and those tops (without a leaf).

    ``leaves`` has grp, pos, size, doc_id, leaf and the digest presented in its place.
    """
    fields = {"grp": pa.string(), "block": pa.int64(), "doc_id": pa.int64(), "leaf": pa.binary(), "folded": pa.binary(),
              "proof": pa.binary(), "met": pa.int64(), "size": pa.int64(), "digest": pa.binary()}
    kinds = pa.schema(list(fields.items()))

    def run(batches):
        for table in whole_blocks(batches, 1):
            pos, size = table.column("pos").to_numpy(), table.column("size").to_numpy()
            fold = Fold(midstate.from_bytes(table.column("presented").to_pylist()))
            for level in climb(pos, size, midstate.from_bytes(table.column("leaf").to_pylist())):
                if isinstance(level, Level):
                    fold.rise(level)
            grp, block, blocks, digest = tops_of(table, pos, level)
            n, m = table.num_rows, len(grp)
            got = {"grp": pa.concat_arrays([table.column("grp").combine_chunks(), grp]),
                   "block": pa.concat_arrays([table.column("block").combine_chunks(), block]),
                   "doc_id": pa.concat_arrays([table.column("doc_id").combine_chunks(), pa.nulls(m, pa.int64())]),
                   "leaf": pa.concat_arrays([table.column("leaf").combine_chunks(), pa.nulls(m, pa.binary())]),
                   "folded": pa.array(midstate.to_bytes(fold.digest) + [None] * m, pa.binary()),
                   "proof": pa.array(midstate.to_bytes(fold.proof) + [None] * m, pa.binary()),
                   "met": pa.array(fold.met.tolist() + [None] * m, pa.int64()),
                   "size": pa.concat_arrays([pa.nulls(n, pa.int64()), blocks]),
                   "digest": pa.concat_arrays([pa.nulls(n, pa.binary()), digest])}
            yield pa.RecordBatch.from_arrays([got[f] for f in fields], schema=kinds)
        give_back()

    return in_blocks(leaves).select("grp", "pos", "block", "size", "doc_id", "leaf", "presented").mapInArrow(
        run, "grp string, block long, doc_id long, leaf binary, folded binary, proof binary, met long, size long, digest binary")


def stepped_nodes(nodes: DataFrame) -> DataFrame:
    """Rows of two kinds: nodes (grp, pos, block) with their steps to the top of their block, and those tops (without pos)."""
    fields = {"grp": pa.string(), "block": pa.int64(), "pos": pa.int64(), "steps": pa.binary(), "size": pa.int64(), "digest": pa.binary()}
    kinds = pa.schema(list(fields.items()))

    def run(batches):
        for table in whole_blocks(batches, 1):
            pos, size = table.column("pos").to_numpy(), table.column("size").to_numpy()
            n = len(pos)
            steps, used = np.zeros((n, LEVELS), STEP), np.zeros(n, np.int64)
            for i, level in enumerate(climb(pos, size, midstate.from_bytes(table.column("digest").to_pylist()))):
                if isinstance(level, Level):
                    steps[:, i] = list(zip(level.state.T, np.stack([o.T for o in level.others], axis=1), level.slot, level.run))
                    used += level.live
            grp, block, blocks, digest = tops_of(table, pos, level)
            m = len(grp)
            got = {"grp": pa.concat_arrays([table.column("grp").combine_chunks(), grp]),
                   "block": pa.concat_arrays([table.column("block").combine_chunks(), block]),
                   "pos": pa.concat_arrays([table.column("pos").combine_chunks(), pa.nulls(m, pa.int64())]),
                   "steps": pa.array([s[:k].tobytes() for s, k in zip(steps, used.tolist())] + [None] * m, pa.binary()),
                   "size": pa.concat_arrays([pa.nulls(n, pa.int64()), blocks]),
                   "digest": pa.concat_arrays([pa.nulls(n, pa.binary()), digest])}
            yield pa.RecordBatch.from_arrays([got[f] for f in fields], schema=kinds)
        give_back()

    return in_blocks(nodes).select("grp", "pos", "block", "size", "digest").mapInArrow(
        run, "grp string, block long, pos long, steps binary, size long, digest binary")


def paths(nodes: DataFrame, path: str) -> DataFrame:
    """grp, pos, root, steps: of each node the root of its group and all steps up to it.

    ``nodes`` has grp, pos, size, digest.  Each pass leaves one node per block, so
    the passes grow with the logarithm of the largest group to the base ``BLOCK``.
    """
    spark = nodes.sparkSession
    largest = nodes.agg(F.max("size")).first()[0] or 0
    stepped_nodes(nodes).write.parquet(f"{path}/level")
    level = spark.read.parquet(f"{path}/level")
    tops = level.where("pos is null").select("grp", F.col("block").alias("pos"), "size", "digest")
    if largest <= BLOCK:
        above = tops.select("grp", "pos", F.col("digest").alias("root"), F.lit(b"").alias("steps"))
    else:
        above = paths(tops, f"{path}/above")
    above = above.select(F.col("grp").alias("top_grp"), F.col("pos").alias("top"), "root", F.col("steps").alias("rest"))
    return level.where("pos is not null").join(above, (F.col("block") == F.col("top")) & F.col("grp").eqNullSafe(
        F.col("top_grp"))).select("grp", "pos", "root", F.concat("steps", "rest").alias("steps"))


def folded_to_root(rows: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof, folded after the steps of each row, all as hex text."""
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            known: dict[bytes, int] = {}
            which = np.array([known.setdefault(s, len(known)) for s in batch.column(6).to_pylist()], np.int64)
            lengths = np.array([len(s) // STEP.itemsize for s in known], np.int64)
            steps = np.zeros((len(known), max(1, lengths.max())), STEP)
            for i, s in enumerate(known):
                steps[i, : lengths[i]] = np.frombuffer(s, STEP)
            fold = Fold(midstate.from_bytes(batch.column(2).to_pylist()), midstate.from_bytes(batch.column(3).to_pylist()),
                        batch.column(4).to_numpy())
            for i in range(lengths.max()):
                s = steps[which, i]
                fold.rise(Level(lengths[which] > i, s["state"].T.copy(), [s["others"][:, k].T.copy() for k in range(FANOUT - 1)],
                                s["slot"].astype(np.int64), s["run"].astype(np.int64)))
            proof = midstate.finish(fold.proof, fold.met)

            def hexed(values):
                return pa.array([v.hex() for v in values], pa.string())

            yield pa.RecordBatch.from_arrays(
                [batch.column(0), hexed(batch.column(1).to_pylist()), hexed(batch.column(5).to_pylist()),
                 hexed(batch.column(7).to_pylist()), hexed(midstate.to_bytes(proof)), hexed(midstate.to_bytes(fold.digest))],
                names=names)
        give_back()

    return rows.select("doc_id", "leaf", "folded", "proof", "met", "subroot", "steps", "root").mapInArrow(
        run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def proofs(docs: DataFrame, presented: dict[str, Column] | None = None, key: str = "doc_id", group: str = "source",
           columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), path: str | None = None) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves are the digests of ``columns``; each group's leaves, by ``key`` and
    then by digest, make a tree, and the groups' roots, null first and then by
    bytes, make the tree of the table.  ``proof_sha256`` is the digest of all
    siblings on a row's way up.  ``presented`` gives other values for some
    columns: the row with these is hashed, put in the leaf's place and folded;
    ``verified`` says whether that gives the root.

    Nulls in any column are values of their own, a null ``key`` comes first.
    Rows alike in all columns have equal leaves side by side; each is a leaf.
    Empty texts and very long ones are hashed whole.  A table of one row is its
    own root; an empty table gives no rows.  Other columns take no part.

    A leaf meets the steps above its block in a join of one row per ``BLOCK``
    leaves.  All tables of the manifest stay below ``path``.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "merkle")
    own = {c: F.col(c) for c in columns}
    leaf = leaf_digest(own)
    other = leaf_digest({**own, **presented}) if presented else leaf
    rows = docs.select(F.col(group).cast("string").alias("grp"), F.col(key).cast("long").alias("doc_id"), leaf.alias("leaf"),
                       other.alias("presented"))
    folded_leaves(placed(rows, ["doc_id", "leaf"], f"{path}/leaves")).write.parquet(f"{path}/folded")
    folded = spark.read.parquet(f"{path}/folded")
    tops = folded.where("leaf is null").select("grp", F.col("block").alias("pos"), "size", "digest")
    paths(tops, f"{path}/groups").write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    groups = blocks.where("pos = 0").select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("digest"))
    ranked = placed(groups, ["name"], f"{path}/subroots")
    ranked.write.parquet(f"{path}/ranked")
    ranked = spark.read.parquet(f"{path}/ranked")
    last = paths(ranked.select("grp", "pos", "size", "digest"), f"{path}/table").select(
        F.col("pos").alias("rank"), F.col("root").alias("all"), F.col("steps").alias("rest"))
    ways = ranked.select("name", F.col("pos").alias("rank"), F.col("digest").alias("subroot")).join(last, "rank")
    above = blocks.join(ways, F.col("grp").eqNullSafe(F.col("name"))).select(
        F.col("grp").alias("top_grp"), F.col("pos").alias("top"), "subroot", F.concat("steps", "rest").alias("steps"), F.col("all").alias("root"))
    above.write.parquet(f"{path}/ways")
    above = spark.read.parquet(f"{path}/ways")
    rows = folded.where("leaf is not null").join(above, (F.col("block") == F.col("top")) & F.col("grp").eqNullSafe(F.col("top_grp")))
    return folded_to_root(rows).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_text(key: str = "doc_id", text: str = "text") -> Column:
    """The text without line breaks in rows whose id has an even CRC-32; others as they are."""
    even = F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(2)) == 0, F.lit(False))
    return F.when(even, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))
