"""Near copies by the Jaccard similarity of their five-word strings: SimHash links first, then an exact prefix filter in rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import SLICE_ROWS, give_back, meet
from quillmill.llm.components import components
from quillmill.llm.simhash import fingerprint, near_links, rows_that_stay, signed
from quillmill.session import fresh_path

WIDTH = 5
#: Least similarity of near copies as a fraction, so that comparisons are exact.
OVER, UNDER = 4, 5
#: About how many rows tell which strings are common, and how many of these are remembered; both change cost only.
SAMPLE = 20_000
COMMON = 300_000
#: Slots by which texts are picked before they move; the slots of any number of ids are few enough to broadcast.
SLOTS = 1 << 20
#: Differing bits of fingerprints whose texts are compared first.
RADIUS = 4
#: Rounds in which each string's texts are compared with one of them; two join a group but for its outermost texts.
ROUNDS = 2
#: Texts of one string that a task compares at once; longer lists are cut and their cuts compared pair by pair.
TILE = 2048
#: Most bits of a text's parity sketch, as a power of two, and least.
MOST, LEAST = 15, 8


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct XXH64 of each ``width`` words in a row, ascending; of fewer words one for all, also of none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z fold, only ASCII blanks split
    body = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(body)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[: len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(body[a:b]) for a, b in zip(first, last)), np.uint64, len(first)))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of strings have the least similarity."""
    if min(len(a), len(b)) * UNDER < max(len(a), len(b)) * OVER:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * (OVER + UNDER) >= OVER * (len(a) + len(b))


def rarest_first(grams: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A text's strings in the order that all texts share: by how often the sample has them, then by value."""
    if not len(common):
        return grams
    at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
    return grams[np.lexsort((grams, np.where(common[at] == grams, counts[at], 0)))]


def common_grams(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Strings that several texts of a sample have, ascending, with their counts; at most ``COMMON`` reach the driver."""
    share = min(1.0, SAMPLE / max(1, texts.count()))
    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))

    def run(batches):
        for ids, grams in sets_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64))], names=["gram"])
        give_back()

    found = some.select("id", "text").mapInArrow(run, "gram long").groupBy("gram").agg(F.count("*").alias("n")).where(
        "n > 1").orderBy(F.desc("n"), "gram").limit(COMMON).toArrow()
    grams = found["gram"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], found["n"].to_numpy().astype(np.int64)[order]


def sets_of(batches):
    """(ids, their strings) of slices of id, text; a text that a task has seen is left out."""
    seen: set[int] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS).to_pydict()
            new = {i: t for i, t in zip(part["id"], part["text"]) if i not in seen}
            if len(seen) > 1_000_000:
                seen.clear()
            seen.update(new)
            if new:
                yield list(new), [shingles(t) for t in new.values()]


def prefixes(texts: DataFrame) -> DataFrame:
    """gram, id, n, pos of the strings by which near copies meet: the rarest fifth of each text and one more.

    Two texts of the least similarity share a string among these, whatever the
    order is, as long as all texts have the same.  ``n`` counts the strings of a
    text and ``pos`` those before this one.
    """
    shared = texts.sparkSession.sparkContext.broadcast(common_grams(texts))

    def run(batches):
        common, counts = shared.value
        for ids, sets in sets_of(batches):
            sizes = np.array([len(s) for s in sets], np.int64)
            kept = sizes - (sizes * OVER + UNDER - 1) // UNDER + 1
            grams = np.concatenate([rarest_first(s, common, counts)[:k] for s, k in zip(sets, kept.tolist())])
            pos = np.arange(len(grams)) - np.repeat(np.cumsum(kept) - kept, kept)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), kept)),
                                              pa.array(np.repeat(sizes, kept).astype(np.int32)), pa.array(pos.astype(np.int32))],
                                             names=["gram", "id", "n", "pos"])
        give_back()

    return texts.select("id", "text").mapInArrow(run, "gram long, id long, n int, pos int")


def met(rows: DataFrame) -> DataFrame:
    """The rows whose string at least two texts have, once each; batches stream, whatever a string's number of rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        held = None  # the last row so far, and whether it has gone out
        for batch in batches:
            gram, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            if not len(gram):
                continue
            before = np.concatenate([[False], gram[1:] == gram[:-1]])
            again = before & np.concatenate([[False], ids[1:] == ids[:-1]])
            after = np.concatenate([before[1:], [False]])
            twin = np.concatenate([again[1:], [False]])  # the next row is the same one
            if held is not None:
                row, out = held
                last, at = row.column(0)[0].as_py(), row.column(1)[0].as_py()
                if last == gram[0]:
                    before[0] = True
                    again[0] = at == ids[0]
                    if not out:
                        yield row
            yield batch.filter(pa.array((before | after) & ~again))
            end = len(gram) - 1
            held = batch.slice(end, 1), bool(before[end] or after[end] or twin[end])

    return rows.repartition(parts, "gram").sortWithinPartitions("gram", "id").mapInArrow(run, rows.schema)


def may_match(n1, pos1, n2, pos2):
    """Whether two texts whose first common string is at these places can have the least similarity."""
    rest = F.least(n1 - pos1, n2 - pos2)
    return (rest * (OVER + UNDER) >= (n1 + n2) * OVER) & (F.least(n1, n2) * UNDER >= F.greatest(n1, n2) * OVER)


def set_rows(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """id and its strings (sorted, eight bytes each) of the ids named.  Only their texts move, and each is hashed once per task."""
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS))
    near = texts.withColumn("slot", slot).join(F.broadcast(ids.select(slot.alias("slot")).distinct()), "slot", "left_semi")

    def run(batches):
        for names, sets in sets_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                             names=["id", "strings"])
        give_back()

    found = near.join(ids, "id", "left_semi").select("id", "text").mapInArrow(run, "id long, strings binary")
    return found.groupBy("id").agg(F.first("strings").alias("strings"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a, b of the least similarity.

    The sets of all b go to the tasks of their a, spread over as many tasks as
    their hash tells, and a's own set goes to each of these once: however many
    texts are compared with one, its set is not repeated for each.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.withColumn("cut", F.pmod(F.xxhash64("b"), F.lit(parts)).cast("int"))
    path = fresh_path(pairs.sparkSession, "neardup-sets")
    set_rows(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), texts).write.parquet(path)
    sets = pairs.sparkSession.read.parquet(path)
    heads = dealt.select("a", "cut").distinct().join(sets.withColumnRenamed("id", "a"), "a").select(
        "a", "cut", F.lit(None).cast("long").alias("b"), "strings")
    members = dealt.join(sets.withColumnRenamed("id", "b"), "b").select("a", "cut", "b", "strings")

    def run(batches):
        head, own = None, None
        for batch in batches:
            out = [], []
            for a, b, strings in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                here = np.frombuffer(strings.as_buffer(), np.uint64)
                if b is None:
                    head, own = a, here
                elif head == a and alike(own, here):
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])
        give_back()

    met_sets = heads.union(members).repartition(parts, "a", "cut").sortWithinPartitions("a", "cut", F.asc_nulls_first("b"))
    return met_sets.select("a", "b", "strings").mapInArrow(run, "a long, b long")


def sketch(grams: np.ndarray) -> bytes:
    """Bits that say of each slot whether an odd number of the strings falls in it; about two slots to a string.

    Two sketches differ in no more bits than the sets differ in strings.
    """
    bits = min(MOST, max(LEAST, int(2 * len(grams) - 1).bit_length()))
    odd = np.bincount((grams & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(sketches: np.ndarray, bits: int) -> np.ndarray:
    """Sketches (a row of bytes each) of half the slots, again and again, until they have ``bits``: slots are low bits of the strings."""
    while sketches.shape[1] * 8 > 1 << bits:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def close_pairs(ids: np.ndarray, n: np.ndarray, grp: np.ndarray, sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of other groups whose sizes and sketches allow the least similarity.

    Sets of that similarity differ in at most a ninth of their strings together.
    """
    order = np.argsort(n, kind="stable")
    size = np.array([len(s) for s in sketches])
    out = [], []
    for s in np.unique(size):
        bits = int(s * 8).bit_length() - 1
        rows = order[size[order] == s]
        # A similar set has at most a quarter more strings, so its sketch has at most twice the slots.
        other = order[(size[order] == s) | (size[order] == 2 * s)]
        body = np.stack([folded(np.frombuffer(sketches[i], np.uint8)[None, :], bits)[0] for i in other]).view(np.uint64)
        place = {int(i): k for k, i in enumerate(other)}
        for i in rows:
            k = place[int(i)]
            far = int(np.searchsorted(n[other], n[i] * UNDER // OVER, "right"))
            near = other[k + 1: far]
            if not len(near):
                continue
            gap = np.bitwise_count(body[k + 1: far] ^ body[k]).sum(axis=1)
            good = near[(gap * (OVER + UNDER) <= n[near] + n[i]) & (grp[near] != grp[i])]
            out[0].append(np.full(len(good), i))
            out[1].append(good)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def compared(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs a, b of texts of one string and of different groups that their sketches do not tell apart.

    Strings of the same texts count once.  Lists of over ``TILE`` texts are cut by
    a hash of the text, and each pair of cuts is compared in a task of its own;
    what does not match goes no further, so no list is ever paired with itself.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = rows.groupBy("gram").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(
        F.xxhash64(F.lit(1), "id")).alias("y"))
    once = lists.groupBy("size", "x", "y").agg(F.min("gram").alias("gram")).select(
        "gram", F.when(F.col("size") > TILE, F.ceil(F.col("size") / (TILE // 2))).otherwise(1).cast("int").alias("cuts"), "size")
    total = rows.count()
    dealt = meet(rows.select("gram", "id", "n", "grp"), once, "gram", "size", total)
    cut = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda o: F.least(o, cut) * F.col("cuts") + F.greatest(o, cut))

    spread = dealt.withColumn("pair", F.explode(pair)).join(sketches.select("id", "sketch"), "id").select(
        F.xxhash64("gram", "pair").alias("list"), "id", "n", "grp", "sketch")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def found(table: pa.Table):
            list_, ids, n, grp = (table.column(i).to_numpy() for i in range(4))
            body = table.column(4).to_pylist()
            cuts = np.concatenate([[0], np.flatnonzero(list_[1:] != list_[:-1]) + 1, [len(list_)]])
            out = [], []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if e - s < 2 or (grp[s:e] == grp[s]).all():
                    continue
                i, j = close_pairs(ids[s:e], n[s:e].astype(np.int64), grp[s:e], body[s:e])
                out[0].append(np.minimum(ids[s + i], ids[s + j]))
                out[1].append(np.maximum(ids[s + i], ids[s + j]))
            both = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
            edges = np.unique(np.stack(both, 1), axis=0) if len(both[0]) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            first, last = held[0].column(0)[0].as_py(), batch.column(0)[-1].as_py()
            if first == last:
                continue
            table = pa.Table.from_batches(held)
            end = int(np.searchsorted(table.column(0).to_numpy(), last))
            yield found(table.slice(0, end))
            held = table.slice(end).to_batches()
        if held:
            yield found(pa.Table.from_batches(held))
        give_back()

    return spread.repartition(parts, "list").sortWithinPartitions("list", "id").mapInArrow(run, "a long, b long").distinct()


def sketched(texts: DataFrame) -> DataFrame:
    """id, n, sketch and the five-word SimHash fingerprint of each text, once per task."""

    def run(batches):
        for batch in batches:
            seen: set[int] = set()
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS).to_pydict()
                new = {i: t for i, t in zip(part["id"], part["text"]) if i not in seen}
                seen.update(new)
                sets = [shingles(t) for t in new.values()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(new), pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([sketch(s) for s in sets], pa.binary()),
                     pa.array([signed(fingerprint(t, WIDTH)) for t in new.values()], pa.int64())], names=["id", "n", "sketch", "fp"])
        give_back()

    found = texts.select("id", "text").mapInArrow(run, "id long, n int, sketch binary, fp long")
    return found.groupBy("id").agg(*[F.first(c).alias(c) for c in ("n", "sketch", "fp")])


def fingerprint_pairs(sketches: DataFrame) -> DataFrame:
    """Pairs a, b of texts whose fingerprints are close, found by multi-index hashing; one text stands for a fingerprint."""
    marked = sketches.select("id", "fp")
    heads = marked.groupBy("fp").agg(F.min("id").alias("head"), F.max("id").alias("last"))
    links = near_links(heads.select("fp"), RADIUS)
    same = marked.join(heads.where("head <> last").select("fp", "head"), "fp").where("id <> head").select(
        F.col("head").alias("a"), F.col("id").alias("b"))
    one, two = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}")) for c in "ab")
    across = links.join(one, "a").join(two, "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    return same.union(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def not_told_apart(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs a, b whose sizes and sketches allow the least similarity: all similar ones and few others."""
    one, two = (sketches.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
    both = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") * UNDER >= F.greatest("na", "nb") * OVER)

    def run(batches):
        for batch in batches:
            good = []
            for na, x, nb, y in zip(*[batch.column(i).to_pylist() for i in range(2, 6)]):
                bits = (min(len(x), len(y)) * 8).bit_length() - 1
                x, y = (folded(np.frombuffer(z, np.uint8)[None, :], bits) for z in (x, y))
                good.append(int(np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).sum()) * (OVER + UNDER) <= na + nb)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
        give_back()

    return both.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """node, root of the texts' hashes that have a near copy: the groups that all pairs of the least similarity make.

    Candidates come in three ways; sketches tell most unlike ones apart, and the
    others are verified on the sets of strings.
    First texts with close SimHash fingerprints are compared.  Then, in rounds,
    the texts that share a string of their rarest fifth are compared with one of
    them, the least by a hash of the text alone: copies share nearly all their
    strings, so most of these name the same text, and a group joins in about as
    many pairs as it has texts.  Strings whose texts are one group drop out.
    What is then still apart is compared by sketches inside the tasks.  No
    candidate is left out, so the groups are those of all pairs.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "neardup")

    def stored(df: DataFrame, step: str) -> DataFrame:
        df.write.parquet(f"{path}/{step}")
        return spark.read.parquet(f"{path}/{step}")

    texts = docs.select(F.xxhash64(text).alias("id"), F.col(text).alias("text"))
    sketches = stored(sketched(texts), "sketches")
    rows = stored(met(prefixes(texts)), "met")
    tried = stored(fingerprint_pairs(sketches), "tried-0")
    linked = stored(verified(stored(not_told_apart(tried, sketches), "close-0"), texts), "linked-0")
    groups = components(linked)
    for step in range(1, ROUNDS + 2):
        named = rows.drop("grp").join(groups.select(F.col("node").alias("id"), F.col("root").alias("grp")), "id", "left")
        named = stored(named.withColumn("grp", F.coalesce("grp", "id")), f"named-{step}")
        lists = named.groupBy("gram").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count("*").alias("size"), F.min(
            F.struct(F.xxhash64(F.lit(step), "id").alias("h"), "id", "n", "pos", "grp")).alias("r"))
        lists = stored(lists.where("lo <> hi").select("gram", "size", "r"), f"lists-{step}")
        rows = stored(meet(named, lists, "gram", "size", named.count()), f"apart-{step}")
        if step <= ROUNDS:
            pairs = rows.where((F.col("grp") != F.col("r.grp")) & may_match(F.col("n"), F.col("pos"), F.col("r.n"), F.col("r.pos"))).select(
                F.least("id", "r.id").alias("a"), F.greatest("id", "r.id").alias("b")).distinct()
            pairs = stored(pairs.join(tried, ["a", "b"], "left_anti"), f"pairs-{step}")
            close = stored(not_told_apart(pairs, sketches), f"close-{step}")
            tried = tried.union(pairs)
        else:
            close = stored(compared(rows.select("gram", "id", "n", "grp"), sketches).join(tried, ["a", "b"], "left_anti"), f"close-{step}")
        rows = rows.drop("size", "r")
        more = stored(verified(close, texts), f"linked-{step}")
        if not more.isEmpty():
            linked = linked.union(more)
            groups = components(linked)
    return groups


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that copy another, as ``simhash.rows_that_stay`` chooses them.

    Copies are all texts with a Jaccard similarity of 0.8 or more of their
    five-word strings, and what these pairs connect; texts without words are one
    group, null among them.  Very long texts are compared whole.  Repeated rows
    are copies too, so one stays; an empty table stays empty.  All columns come
    back as they were, whatever their names.
    """
    marked = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("mark"))
    groups = near_copies(docs, text).withColumnRenamed("node", "mark")
    return rows_that_stay(docs, marked.join(groups, "mark", "left").withColumn("root", F.coalesce("root", "mark")), key, text)
