"""The corpus pipeline: five stages over documents, each written as Parquet and read as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import bpe, mixing, neardup, pii, toxicity
from quillmill.session import fresh_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; a null id is scored like any other."""
    whole = docs.select("doc_id", "text", F.struct("*").alias("row"))
    return toxicity.flag_toxic(whole, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 0").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id; of rows with that id, one."""
    return neardup.one_of_each_group(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to the name of its kind; n_chars follows the new text."""
    return pii.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: documents drawn twice occur twice, documents not drawn go."""
    return mixing.mixed(docs).select("row.*").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their digest and that of the text decoded from them."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("ids",))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Fingerprints and learned models have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table stays in the shared folder of the run."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = fresh_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
    return docs
