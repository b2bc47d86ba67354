"""Removal of repeated byte strings: minimizers deal equal strings to one shard, suffix arrays find them there."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import give_back, slices
from quillmill.llm.suffixes import repeated
from quillmill.session import fresh_path

#: Length of the strings, of the substring whose least hash deals them out, and what follows from both.
WIDTH = 200
GRAM = 48
REACH = WIDTH - GRAM + 1
#: Bytes that one suffix array covers, pieces of one key that a shard takes, code units looked at together.
CHUNK = 1 << 20
SHARD = 4096
SLICE = 1 << 20


def minimizers(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string of ``WIDTH`` bytes the place of its least substring hash (the leftmost of equals), and all hashes.

    Equal strings have it at the same distance from their start.  Hashes are built
    by doubling, and so are the minima, which pack 40 bits of the hash with the place.
    """
    h = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    part, size, factor = {}, 1, 0xBF58476D1CE4E5B9
    while size <= GRAM:
        part[size] = h
        h = h[:-size] * np.uint64(factor) + h[size:] if len(h) > size else h[:0]
        factor = (factor * factor + 2) % (1 << 64)
        size *= 2
    whole, have = None, 0
    for size in sorted(part, reverse=True):
        if GRAM & size:
            n = len(raw) - GRAM + 1
            piece = part[size][have: have + n]
            whole = piece.copy() if whole is None else whole * np.uint64(0x94D049BB133111EB) + piece
            have += size
    whole ^= whole >> np.uint64(32)
    whole *= np.uint64(0xD6E8FEB86659FD93)
    whole ^= whole >> np.uint64(29)
    least = (whole & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(whole), dtype=np.uint64)
    size = 1
    while 2 * size <= REACH:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < REACH:
        least = np.minimum(least[: size - REACH], least[REACH - size:])
    return (least & np.uint64(0xFFFFFF)).astype(np.int64), whole


def pieces(body: bytes) -> tuple[np.ndarray, ...]:
    """Runs of string starts with one minimizer: first start, number of starts, key, and the halves of a 128-bit hash of all their bytes.

    A run has at most ``REACH`` starts and holds no string twice.
    """
    out = [[], [], []]
    for at in range(0, max(1, len(body) - WIDTH + 1), SLICE):
        raw = np.frombuffer(body, np.uint8)[at: at + SLICE + WIDTH - 1]
        if len(raw) < WIDTH:
            continue
        place, whole = minimizers(raw)
        cut = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        out[0].append(cut + at)
        out[1].append(np.diff(np.append(cut, len(place))))
        out[2].append(whole[place[cut]])
    if not out[0]:
        return (np.zeros(0, np.int64),) * 5
    start, count, key = map(np.concatenate, out)
    digest = xxhash.xxh3_128_digest
    fold = np.frombuffer(b"".join([digest(body[a:b]) for a, b in zip(start.tolist(), (start + count + WIDTH - 1).tolist())]),
                         np.int64).reshape(-1, 2)
    return start, count, key.view(np.int64), fold[:, 0], fold[:, 1]


def scan(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: a document's (uid, doc_id, n, sha) and its pieces' (uid, span, key, fold, more).

    uid numbers the rows of a written table; span is 256 * first start + number of starts.
    """
    kinds = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sha", pa.string()),
                       ("span", pa.int64()), ("key", pa.int64()), ("fold", pa.int64()), ("more", pa.int64())])

    def run(batches):
        uid = TaskContext.get().partitionId() << 33
        for part in slices(batches):
            rows, cols = [], []
            for key, text in zip(part.column(0).to_pylist(), part.column(1)):
                body = (text.as_py() or "").encode("utf-8", "surrogatepass")
                rows.append((uid, key, len(body), hashlib.sha256(body).hexdigest()))
                start, count, *hashes = pieces(body)
                cols.append((np.full(len(start), uid), start * 256 + count, *hashes))
                uid += 1
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], kinds.field(i).type) for i in range(4)],
                                              *[none] * 4], schema=kinds)
            ids, *hashes = map(np.concatenate, zip(*cols))
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids), none, none, pa.nulls(len(ids), pa.string()),
                                              *map(pa.array, hashes)], schema=kinds)
        give_back()

    return docs.select("doc_id", "text").mapInArrow(
        run, "uid long, doc_id long, n long, sha string, span long, key long, fold long, more long")


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, sha and the compressed bytes, which is what moves to meet the pieces."""

    def run(batches):
        for part in slices(batches):
            bodies = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([hashlib.sha256(b).hexdigest() for b in bodies]),
                                              pa.array([zlib.compress(b, 2) for b in bodies], pa.binary())],
                                             names=["doc_id", "sha", "body"])
        give_back()

    return docs.select("doc_id", "text").where(F.octet_length("text") >= WIDTH).mapInArrow(
        run, "doc_id long, sha string, body binary")


def found_in_shards(opened: DataFrame) -> DataFrame:
    """uid, first, last, print: runs of starts that repeat, or with a print one start of a key that has several shards.

    ``opened`` has key, cut, cuts, uid, start, count, body, many, and comes sorted by
    key and cut.  Whole shards are gathered up to ``CHUNK`` bytes for one suffix
    array; a shard has at most about ``SHARD`` pieces.
    """
    kinds = pa.schema([("uid", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("print", pa.binary())])

    def solved(held):
        out = ([], [], [], [])
        if not held:
            return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in kinds], schema=kinds)
        hits = repeated([h["body"] for h in held], [h["count"] for h in held], WIDTH)
        for h, hit in zip(held, hits):
            if not h["many"]:  # the others are known to repeat
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    for col, x in zip(out, (h["uid"], h["start"] + a, h["start"] + b, None)):
                        col.append(x)
            if h["cuts"] > 1:
                for i in range(h["count"]):
                    mark = xxhash.xxh3_128_digest(h["body"][i: i + WIDTH])
                    for _ in range(1 + h["many"]):
                        for col, x in zip(out, (h["uid"], h["start"] + i, h["start"] + i + 1, mark)):
                            col.append(x)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kinds)], schema=kinds)

    def run(batches):
        held, size, last = [], 0, None
        for part in slices(batches):
            for row in part.to_pylist():
                shard = (row["key"], row["cut"])
                if shard != last and size >= CHUNK:
                    yield solved(held)
                    held, size = [], 0
                last = shard
                held.append(row)
                size += len(row["body"])
        yield solved(held)
        give_back()

    return opened.mapInArrow(run, "uid long, first long, last long, print binary")


def across_shards(prints: DataFrame) -> DataFrame:
    """uid, first, last of starts whose print another start has too; rows come sorted by print, and each is looked up among them."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            marks = np.array([m.as_buffer().to_pybytes() for m in rows.column(3)], "V16").view(">u8").reshape(-1, 2)
            order = marks[:, 0].astype(np.uint64)
            left, right = np.searchsorted(order, order, "left"), np.searchsorted(order, order, "right")
            keep = right - left > 1
            for i in np.flatnonzero(right - left > 1):  # the first halves are equal, so the second halves decide
                keep[i] = (marks[left[i]: right[i], 1] == marks[i, 1]).sum() > 1
            yield rows.select(["uid", "first", "last"]).filter(pa.array(keep))
            held = rows.slice(rows.num_rows - 1)
        give_back()

    return prints.mapInArrow(run, "uid long, first long, last long")


def trimmed(joined: DataFrame) -> DataFrame:
    """uid, n_removed, n_spans, kept_sha256 from the compressed bytes and the runs of repeated starts."""
    kinds = pa.schema([("uid", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for part in slices(batches):
            out = ([], [], [], [])
            for uid, body, first, last in zip(*[part.column(i).to_pylist() for i in range(4)]):
                parts, at, spans = [], 0, 0
                raw = zlib.decompress(body)
                for a, b in sorted(zip(first, last)):
                    b += WIDTH - 1
                    if a > at or not spans:
                        parts.append(raw[at:a])
                        spans += 1
                    at = max(at, b)
                parts.append(raw[at:])
                kept = b"".join(parts)
                for col, x in zip(out, (uid, len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kinds)], schema=kinds)
        give_back()

    return joined.select("uid", "body", "first", "last").mapInArrow(
        run, "uid long, n_removed long, n_spans long, kept_sha256 string")


def dedup_report(docs: DataFrame, key: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Each byte in a string of ``WIDTH`` bytes that starts anywhere else too is removed.
    Null texts count as empty; shorter texts lose nothing; repeated rows remove
    each other, being texts of their own.

    1. Each text is cut into pieces by minimizers: equal strings lie in pieces of one key.
    2. Keys of one piece are through.  Keys whose pieces are all alike repeat wholly.
       Of the others one piece of each content goes on with its bytes.
    3. Shards of such pieces, by key, get suffix arrays.  A key of over ``shard``
       pieces has several shards; prints of its strings are merged across them.
    4. Texts with repeats are trimmed.

    Intermediate tables are in the shared folder.  Hashes of 128 bits under a 64-bit
    key, and prints of 128 bits, stand for equal bytes; within a shard bytes are
    compared.  Tasks take texts and pieces in slices of some MB, very long texts
    a megabyte at a time.  Other columns take no part, whatever their names; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "suffix_dedup")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    scanned = stored(scan(given), "scan")
    rows = scanned.where("key is null").select("uid", "doc_id", "n", "sha")
    copies = rows.groupBy("sha").agg(F.count("*").alias("copies"))
    rows = stored(rows.join(copies, "sha"), "rows")
    owned = scanned.where("key is not null").select("uid", "span", "key", "fold", "more")
    keys = owned.groupBy("key").agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in (
        "fold", "more")]).where("n > 1").select("key", F.expr("min_fold <> max_fold or min_more <> max_more").alias("mixed"))
    shared = stored(owned.join(keys, "key"), "shared")

    contents = shared.where("mixed").groupBy("key", "fold", "more").agg(
        F.min(F.struct("uid", "span")).alias("one"), (F.count("*") > 1).alias("many"))
    cuts = contents.groupBy("key").agg(F.ceil(F.count("*") / shard).cast("int").alias("cuts"))
    wanted = contents.join(cuts, "key").select("one.uid", F.struct(
        "key", F.pmod(F.xxhash64("one.uid", "one.span"), F.col("cuts")).cast("int").alias("cut"), "cuts", "one.span", "many").alias("want"))
    alike = shared.where("not mixed").select("uid", "span").union(
        shared.where("mixed").join(contents.where("many").select("key", "fold", "more"), ["key", "fold", "more"]).select("uid", "span"))
    single = rows.where("copies = 1").select("uid")
    sure = alike.join(single, "uid", "left_semi").groupBy("uid").agg(F.collect_list("span").alias("sure"))
    asked = wanted.groupBy("uid").agg(F.collect_list("want").alias("wants"))
    tasks = sure.join(asked, "uid", "full").join(rows.select("uid", "doc_id", "sha"), "uid")
    met = packed_texts(given).alias("t").join(tasks.alias("k"), (F.col("t.sha") == F.col("k.sha")) & F.col(
        "t.doc_id").eqNullSafe(F.col("k.doc_id"))).select("k.uid", "t.body", "k.sure", "k.wants")
    texts = stored(met, "texts")

    opened = cut_out(texts.where("wants is not null").select("uid", "body", "wants"))
    shards = opened.repartition(parts, "key", "cut").sortWithinPartitions("key", "cut")
    found = stored(found_in_shards(shards), "found")
    prints = found.where("print is not null").repartitionByRange(parts, "print").sortWithinPartitions("print")
    runs = found.where("print is null").select("uid", "first", "last").union(across_shards(prints))
    runs = runs.groupBy("uid").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))
    joined = texts.join(runs, "uid", "left").join(single, "uid", "left_semi")
    span = F.coalesce("sure", F.array().cast("array<bigint>"))
    none = F.array().cast("array<bigint>")
    joined = joined.select(
        "uid", "body",
        F.concat(F.transform(span, lambda s: F.shiftright(s, 8)), F.coalesce("first", none)).alias("first"),
        F.concat(F.transform(span, lambda s: F.shiftright(s, 8) + s.bitwiseAND(255)), F.coalesce("last", none)).alias("last"))
    done = trimmed(joined.where(F.size("first") > 0))
    gone = (F.col("copies") > 1) & (F.col("n") >= WIDTH)
    zero = F.lit(0).cast("long")
    return rows.join(done, "uid", "left").select(
        "doc_id", F.col("n").alias("n_bytes"),
        F.when(gone, F.col("n")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))


def cut_out(texts: DataFrame) -> DataFrame:
    """The wanted pieces with their bytes."""
    kinds = pa.schema([("key", pa.int64()), ("cut", pa.int32()), ("cuts", pa.int32()), ("uid", pa.int64()), ("start", pa.int64()),
                       ("count", pa.int32()), ("body", pa.binary()), ("many", pa.int32())])

    def run(batches):
        for part in slices(batches):
            out = tuple([] for _ in kinds)
            for uid, body, wants in zip(*[part.column(i).to_pylist() for i in range(3)]):
                raw = zlib.decompress(body)
                for w in wants:
                    start, count = w["span"] >> 8, w["span"] & 255
                    row = (w["key"], w["cut"], w["cuts"], uid, start, count, raw[start: start + count + WIDTH - 1], int(w["many"]))
                    for col, x in zip(out, row):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kinds)], schema=kinds)
        give_back()

    return texts.mapInArrow(run, "key long, cut int, cuts int, uid long, start long, count int, body binary, many int")
