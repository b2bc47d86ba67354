"""Mixing sources to target weights: quotas split over output shards by a hypergeometric tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import let, words_of

#: Weights of the sources in their order, repeating; their share of all words; most copies of a document.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
#: Blocks of a source (by hash of the id, so each holds its share of any source) and output shards (a power of two).
BLOCK_HEX = 3
SHARDS = 64


def digest(*parts: Column | str) -> Column:
    """A permutation key that SQL engines agree on."""
    return F.md5(F.concat_ws(":", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts]).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Adds place, weight and target to a table of source, source_size.

    Sources in code point order, null last, share ``share`` of all words by
    weight; a target stops at ``EPOCHS`` times its source's size and the excess goes
    to the others by weight.  Sorted by size per weight, a source stops if the
    share of those from it on would exceed its stop, so one pass decides.  The
    table has a row for each source, so one task may order it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    placed = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    whole = Window.partitionBy()
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    rest = placed.withColumns({
        "_total": F.sum("source_size").over(whole).cast("double") * share,
        "_before": F.coalesce(F.sum("source_size").over(filling), F.lit(0)),
        "_weight": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(filling), F.lit(0)),
    }).withColumn("_stops", (F.col("_total") - EPOCHS * F.col("_before")) * F.col("weight") > EPOCHS * F.col("source_size") * F.col("_weight"))
    open_words = F.col("_total") - EPOCHS * F.coalesce(F.sum(F.when(F.col("_stops"), F.col("source_size"))).over(whole), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_stops"), F.col("weight"))).over(whole)
    return rest.withColumns({"_words": open_words, "_open": open_weight}).withColumn("target", F.when(
        F.col("_stops"), (EPOCHS * F.col("source_size")).cast("double")).otherwise(
        F.col("weight") * F.col("_words") / F.col("_open"))).select("source", "source_size", "place", "weight", "target")


def log_factorial(n: Column) -> Column:
    """ln n!: exact products up to 20, a series beyond."""
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + F.lit(0.9189385332046727) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")))).otherwise(series)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``marked`` among ``total`` are in ``drawn`` draws, by inversion of ``u`` in [0, 1).

    The sum of probabilities runs over ten standard deviations around the mean.
    """
    zero = F.lit(0).cast("long")

    def bounded(s: Column) -> Column:
        spread = 10 * F.sqrt(s["n"] * (s["k"] / s["t"]) * (1 - s["k"] / s["t"]) * (s["t"] - s["n"]) / F.greatest(s["t"] - 1, F.lit(1))) + 10
        mean = s["n"] * s["k"] / s["t"]
        low = F.greatest(zero, s["n"] + s["k"] - s["t"], F.floor(mean - spread))
        high = F.least(s["n"], s["k"], F.ceil(mean + spread))
        return let(F.struct(low.alias("low"), high.alias("high")), lambda w: inverted(s, w))

    def choose(n: Column, k: Column) -> Column:
        return log_factorial(n) - log_factorial(k) - log_factorial(n - k)

    def inverted(s: Column, w: Column) -> Column:
        first = F.exp(choose(s["k"], w["low"]) + choose(s["t"] - s["k"], s["n"] - w["low"]) - choose(s["t"], s["n"]))

        def step(acc: Column, x: Column) -> Column:
            following = acc["p"] * ((s["k"] - x) * (s["n"] - x)).cast("double") / (
                (x + 1) * (s["t"] - s["k"] - s["n"] + x + 1)).cast("double")
            return F.struct(F.coalesce(following, F.lit(0.0)).alias("p"), (acc["sum"] + acc["p"]).alias("sum"),
                            F.when(acc["sum"] + acc["p"] <= s["u"], x + 1).otherwise(acc["x"]).alias("x"))

        start = F.struct(first.alias("p"), F.lit(0.0).alias("sum"), w["low"].alias("x"))
        return F.least(F.aggregate(F.sequence(w["low"], w["high"]), start, step, lambda a: a["x"]), w["high"])

    given = F.struct(total.alias("t"), marked.alias("k"), drawn.alias("n"), u.alias("u"))
    return F.when((marked <= 0) | (drawn <= 0), zero).when(drawn >= total, marked).otherwise(let(given, bounded))


def uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def split_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """place, shard, quota, first: the quota of each source in each shard, adding up to the source's.

    A node of the tree holds the vector of all sources' blocks.  Its left half
    gets half of the blocks, source by source a hypergeometric draw from what
    earlier sources left, which is a multivariate hypergeometric draw.  ``quotas``
    (place, quota) has a row for each source; a node is one row, levels are
    generated rows, so no rows are shuffled.
    """
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("place", "quota"))).alias("all")).select(
        F.lit(0).cast("long").alias("node"), F.transform("all", lambda s: s["quota"].cast("long")).alias("q"))

    def left_of(q: Column, node: Column) -> Column:
        total = F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x)
        half = F.floor((total + F.pmod(F.xxhash64(node, F.lit(seed)), F.lit(2))) / 2)  # an odd block goes to either side
        start = F.struct(total.alias("t"), half.alias("n"), F.array().cast("array<bigint>").alias("out"))

        def step(acc: Column, k: Column) -> Column:
            x = hypergeometric(acc["t"], k, acc["n"], uniform(node, F.size(acc["out"]), F.lit(seed)))
            return let(x, lambda got: F.struct((acc["t"] - k).alias("t"), (acc["n"] - got).alias("n"),
                                               F.concat(acc["out"], F.array(got)).alias("out")))

        return F.aggregate(q, start, step, lambda a: a["out"])

    for level in range((shards - 1).bit_length()):
        halves = nodes.withColumn("left", left_of(F.col("q"), F.col("node") + (1 << level)))
        right = F.zip_with("q", "left", lambda a, b: a - b)
        nodes = halves.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")),
            F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("q")))).alias("n")).select("n.node", "n.q")
    leaves = nodes.select(F.col("node").alias("shard"), F.posexplode("q").alias("place", "quota"))
    before = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("first", F.coalesce(F.sum("quota").over(before), F.lit(0)))


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", carry: bool = False) -> DataFrame:
    """doc_id, source, size in words and the block, a hash of the id; with ``carry`` the whole row as a struct too."""
    more = [F.struct("*").alias("row")] if carry else []
    return docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"),
                       F.size(words_of(F.col(text))).cast("long").alias("size"), *more).withColumn(
        "block", F.substring(digest(F.col("doc_id").cast("string")), 1, BLOCK_HEX))


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
         shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """The targets of the sources, and the drawn blocks: source, block, epoch, shard, block_words.

    A source's blocks, once for each epoch, are put in the order of a hash, which is
    its permutation; blocks are drawn in that order until the target's words are
    reached, the last in part.  The number drawn is the source's exact quota, which
    ``split_tree`` deals to the shards; each shard takes the next of the order, so
    shards draw disjoint blocks.  A source has at most 16 ** ``BLOCK_HEX`` blocks,
    so its order is one small task however large it is.
    """
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
    goals = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share)
    goal = goals.select(F.col("source").alias("_s"), "place", F.round("target").cast("long").alias("goal"))
    turns = blocks.join(goal, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn(
        "epoch", F.explode(F.array(*[F.lit(e) for e in range(EPOCHS)])))
    order = Window.partitionBy("place").orderBy("epoch", digest("block", F.col("epoch").cast("string")))
    drawn = turns.where("words > 0").withColumns({
        "start": F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"),
        "turn": F.row_number().over(order) - 1}).where("start < goal").withColumn(
        "block_words", F.least("words", F.col("goal") - F.col("start")))
    quotas = goals.select("place").join(drawn.groupBy("place").agg(F.count("*").alias("quota")), "place", "left").select(
        "place", F.coalesce("quota", F.lit(0)).cast("long").alias("quota"))
    dealt = split_tree(quotas, shards).where("quota > 0").select(
        "place", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("quota") - 1)).alias("turn"))
    return goals, drawn.join(dealt, ["place", "turn"]).select("source", "block", "epoch", "shard", "words", "block_words")


def taken(rows: DataFrame, drawn: DataFrame) -> DataFrame:
    """Adds draws: an array of (epoch, shard, words) for each row, empty if none; words is less than size for a cut row.

    Rows of a block have their places in the order of a hash; a block drawn in part
    gives its first words in that order.  Blocks hold a small share of any
    source, so the places of a hot source are found in many tasks.
    """
    per_block = drawn.groupBy("source", "block").agg(F.collect_list(F.struct("epoch", "shard", "block_words")).alias("turns"))
    order = Window.partitionBy("source", "block").orderBy(digest(F.lit("row"), F.col("doc_id").cast("string")), "size")
    placed = rows.withColumn("_start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    met = placed.alias("r").join(per_block.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (
        F.col("r.block") == F.col("b.block")), "left").select("r.*", "b.turns")
    draws = F.filter(F.transform(F.coalesce("turns", F.array().cast("array<struct<epoch:int,shard:bigint,block_words:bigint>>")),
                                 lambda t: F.struct(t["epoch"].alias("epoch"), t["shard"].alias("shard"), F.greatest(F.lit(0), F.least(
                                     F.col("size"), t["block_words"] - F.col("_start"))).cast("long").alias("words"))),
                     lambda t: t["words"] > 0)
    return met.withColumn("draws", draws).drop("turns", "_start")


def mix_report(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken.

    Null and blank texts have size 0 and nothing taken.  A null source is a source
    of its own, the last.  Rows with one id lie in one block and are mixed like
    others.  An empty table gives an empty one.
    """
    rows = sized(docs, key, text, source)
    goals, drawn = plan(rows)
    got = taken(rows, drawn).withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]))
    return got.alias("r").join(goals.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).select(
        "r.doc_id", "r.size", F.col("g.source_size").alias("source_size"), F.col("g.target").alias("target"), "r.taken")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: shard, turn (the place in the shard's shuffle) and the row as often as it is drawn.

    ``row`` holds all columns of ``docs``.  A document that the end of its source's
    quota cuts has its first words, joined by blanks.
    """
    rows = sized(docs, key, text, source, carry=True)
    _, drawn = plan(rows.select("source", "block", "size"))
    words = F.slice(words_of(F.col(f"row.{text}")), 1, F.col("d.words").cast("int"))
    cut = F.when(F.col("d.words") < F.col("size"), F.array_join(words, " ")).otherwise(F.col(f"row.{text}"))
    return taken(rows, drawn).withColumn("d", F.explode("draws")).select(
        F.col("d.shard").alias("shard"),
        digest(F.col("doc_id").cast("string"), F.col("d.epoch").cast("string"), F.lit("turn")).alias("turn"),
        F.col("row").withField(text, cut).alias("row"))
