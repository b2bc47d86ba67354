"""Sentence, line and word tables made from a document table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.rows import unroll, unroll_fields
from quillmill.functions.text import pairs, sentences, terms


def by_document(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spread documents by key before they are exploded.

    This is the only shuffle of the jobs below: grouping, windows and joins on
    keys that start with the document stay inside the partition, and the text
    moves before it has grown into feature rows.
    """
    return df.repartition(key)


def sentence_table(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per sentence: key, pos (from 0), sentence, n (sentences in the document)."""
    cut = df.select(key, sentences(F.col(text)).alias("ss"))
    return unroll(cut, [key, F.size("ss").alias("n")], "ss", "sentence", "pos")


def feature_table(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Exploded features of every sentence: key, pos, kind (word or pair), feature."""
    base = sentence_table(df, key, text).withColumn("tokens", terms(F.col("sentence"), 3))
    found = F.concat(
        F.transform(F.array_distinct("tokens"), lambda w: F.struct(F.lit("word").alias("kind"), w.alias("feature"))),
        F.transform(F.array_distinct(pairs(F.col("tokens"))),
                    lambda w: F.struct(F.lit("pair").alias("kind"), w.alias("feature"))))
    return unroll_fields(base, [key, "pos"], found)


def in_order(position: str, value: str, out: str) -> Column:
    """Aggregate that gathers one document's values by position."""
    gathered = F.array_sort(F.collect_list(F.struct(position, value)))
    return F.transform(gathered, lambda s: s[value]).alias(out)
