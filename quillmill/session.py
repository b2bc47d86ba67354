"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "quillmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; on a cluster the master comes from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A local run has no shared folder, so a temporary one is used there; a
    cluster without the setting is refused, since executors would each write
    to their own disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="quillmill-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder; the same name finds the same place after a restart."""
    return os.path.join(checkpoint_root(spark), name)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder that no other run uses."""
    return checkpoint_path(spark, f"{name}-{uuid.uuid4().hex}")


def stored(df, name: str):
    """The rows, written to a table of their own in the shared folder and read back, so no later step computes them again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
