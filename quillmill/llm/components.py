"""Connected groups of a table of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.session import fresh_path


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of the edges; root is the least node of its group (order of long).

    Each round hangs the larger neighbours of a node on its least neighbour, then
    the smaller ones on theirs; rounds grow with the logarithm of a group's
    length.  Nodes get their least neighbour by a pre-aggregated minimum, and the
    edges of a node with many neighbours stay spread over the join's tasks.  Each
    round is a table in the shared folder, which cuts the lineage and survives a
    lost executor; the driver sees counts only.
    """
    spark = edges.sparkSession
    path = fresh_path(spark, "components")

    def stored(df: DataFrame, step: str) -> DataFrame:
        df.write.parquet(f"{path}/{step}")
        return spark.read.parquet(f"{path}/{step}")

    now = stored(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo <> hi").distinct(), "0")
    done = now.isEmpty()
    step = 0
    while not done:
        step += 1
        # Large star: every larger neighbour of a node goes to the least of the node and its neighbours.
        both = now.select(F.col("lo").alias("n"), F.col("hi").alias("m")).union(now.select("hi", "lo"))
        least = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        large = now.select(F.col("lo").alias("n"), "hi").join(least, "n").select(F.col("low").alias("lo"), "hi").distinct()
        # Small star: the smaller neighbours of a node, and the node, go to the least of them.
        least = large.groupBy("hi").agg(F.min("lo").alias("low"))
        # Both edges of a joined row are made from it, so the join is planned and run once.
        small = large.join(least, "hi").select("low", F.explode(F.array("lo", "hi")).alias("hi")).where("low <> hi")
        now = stored(small.select(F.col("low").alias("lo"), "hi").distinct(), str(step))
        # Done when each node hangs on one root and no root hangs on another node.
        ends = now.select(F.explode(F.array(F.struct(F.col("hi").alias("n"), F.lit(1).alias("up")), F.struct(F.col("lo").alias("n"), F.lit(0).alias("up")))).alias("e"))
        ends = ends.groupBy("e.n").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("least"))
        done = ends.where("ups > 1 or (ups = 1 and least = 0)").isEmpty()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        now.select("lo", "lo").distinct())
