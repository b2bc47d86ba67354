"""Scans with explicit schemas."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill import schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def read_audit(spark: SparkSession, path: str, org: int | None = None,
               since: dt.datetime | None = None) -> DataFrame:
    """Audit fact; both filters prune partitions (organization, day)."""
    df = spark.read.schema(_partitioned(schema.AUDIT)).parquet(path)
    if org is not None:
        df = df.filter(F.col("organization_id") == org)
    if since is not None:
        df = df.filter((F.col("day") >= F.lit(since.date())) & (F.col("timestamp") >= F.lit(since)))
    return df


def _partitioned(s):
    from pyspark.sql import types as T

    return T.StructType([*s.fields, T.StructField("day", T.DateType())])


def with_request_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({"temperature": F.coalesce("temperature", F.lit(0.7)),
                           "stream": F.coalesce("stream", F.lit(False))})


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Chat requests as JSON lines, with the documented defaults."""
    return with_request_defaults(spark.read.schema(schema.REQUEST).json(path))


def requests_from_turns(df: DataFrame) -> DataFrame:
    """One request per assistant turn, with all earlier turns in order.

    The history is the request's own payload, so its size is part of the
    result; it comes from one running window per conversation.
    """
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    message = F.struct("role", F.col("text").alias("content"))
    return (df.withColumn("messages", F.collect_list(message).over(before))
            .filter(F.col("role") == "assistant")
            .select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "conv_id", "turn",
                    "messages", F.col("text").alias("response")))


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Document corpus: whole text files, JSON lines or parquet."""
    if fmt == "text":
        return (spark.read.text(path, wholetext=True)
                .select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")))
    if fmt == "json":
        return spark.read.schema(schema.DOCUMENT).json(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown document format: {fmt}")


def visible_to_org(df: DataFrame, org=None) -> DataFrame:
    """Rows owned by the organization, and system rows."""
    if org is None:
        return df
    return df.filter((F.col("organization_id") == org) | F.col("is_system"))
