"""Exact deduplication against a persistent digest index, a table bucketed and sorted by hash."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.session import fresh_path

#: A digest that holds more than one row in so many is hot; there are at most as many hot digests as this.
HOT = 1024
ENTRY = "digest binary, keep_id long, keep_mark long"


def text_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes; a null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def marked_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, digest and a mark of its own for each row, written below ``path`` so that marks are the same in every pass.

    Columns in ``keep`` go along in a struct ``row``, apart from these names.
    """
    more = [F.struct(*keep).alias("row")] if keep else []
    docs.select(F.col(key).cast("long").alias("doc_id"), text_digest(F.col(text)).alias("digest"), *more).withColumn(
        "mark", F.monotonically_increasing_id()).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


class DigestIndex:
    """A table of the digests seen so far, each with the row that stays: digest, keep_id, keep_mark, batch.

    The table is bucketed and sorted by digest, so looking up a batch moves the
    batch to the buckets and never the index.  Its files lie at ``path``, by
    default a fresh folder below ``spark.checkpoint.dir``; opening the same name
    and path again in a later session goes on with what is there.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or fresh_path(spark, "digest-index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(self.name):
            spark.sql(f"CREATE TABLE {self.name} ({ENTRY}, batch string) USING parquet OPTIONS (path '{self.path}') "
                      f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS")

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def _append(self, entries: DataFrame, name: str) -> None:
        """One file for each bucket, sorted."""
        entries.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(
            self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(name)

    def add(self, rows: DataFrame, batch: str | None = None) -> None:
        """Appends the digests of ``rows`` (doc_id, digest, mark) that the index lacks, each with its row of the largest doc_id.

        Copies are folded before they move, so a digest arrives at most once per
        task.  A digest that is there already keeps its row, whatever the new ids;
        adding a batch again therefore changes nothing.
        """
        fresh = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "mark")).alias("keep"))
        lacking = fresh.join(self.entries().select("digest").hint("merge"), "digest", "left_anti")
        self._append(lacking.select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.mark").alias("keep_mark"),
                                    F.lit(batch or uuid.uuid4().hex).alias("batch")), self.name)

    def compacted(self, name: str, path: str) -> DigestIndex:
        """The same index as a new table with one sorted file for each bucket again; each ``add`` has left one more."""
        other = DigestIndex(self.spark, name, path, self.buckets)
        whole = self.entries().groupBy("digest").agg(F.max(F.struct("keep_id", "keep_mark", "batch")).alias("e"))  # bucket by bucket
        other._append(whole.select("digest", "e.*"), other.name)
        return other

    def report(self, rows: DataFrame) -> DataFrame:
        """doc_id, mark, digest, keep_id, group_size, kept for each of ``rows``, all of whose digests the index holds.

        Digests of hot groups, at most ``HOT``, are broadcast with their rows' verdict;
        the rest meets the index by sort-merge join, whose groups are small.
        """
        total = rows.count()
        sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
        found = self.entries().select("digest", "keep_id", "keep_mark").hint("merge").join(sizes, "digest")
        is_hot = F.col("group_size") * HOT > total
        hot = F.broadcast(found.where(is_hot))
        cold = rows.join(hot.select("digest"), "digest", "left_anti").join(found.where(~is_hot).hint("merge"), "digest")
        return rows.join(hot, "digest").unionByName(cold).withColumn("kept", F.col("mark") == F.col("keep_mark"))


def in_two_batches(rows: DataFrame, index: DigestIndex) -> None:
    """Adds the rows of larger ids, then the others, so that of copies the largest id is there first."""
    middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    first = F.coalesce(F.col("doc_id") >= middle, F.lit(False)) if middle is not None else F.lit(False)
    index.add(rows.where(first))
    index.add(rows.where(~first))


def dedup_report(docs: DataFrame, index: DigestIndex | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty.  Of equal texts
    the row with the largest ``key`` stays, a null key being the smallest; of rows
    with that key too exactly one stays.  ``group_size`` counts the rows of the
    table with that text.  With an ``index`` that holds earlier batches, a text
    it knows is dropped and ``keep_id`` names the earlier row.  Very long texts
    are hashed whole.  An empty table gives no rows; other columns, whatever
    their names, take no part.
    """
    spark = docs.sparkSession
    rows = marked_digests(docs, fresh_path(spark, "digests"), key, text)
    if index is None:
        index = DigestIndex(spark)
        in_two_batches(rows, index)
    else:
        # Marks are unique within a run only: shifted by a random start they tell batches apart, too.
        rows = rows.withColumn("mark", F.col("mark") + F.lit(uuid.uuid4().int >> 66))
        index.add(rows)
    return index.report(rows).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, index: DigestIndex | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``dedup_report`` keeps, with all their columns; rows and empty tables as there."""
    spark = docs.sparkSession
    start = uuid.uuid4().int >> 66
    rows = marked_digests(docs, fresh_path(spark, "digests"), key, text, tuple(docs.columns)).withColumn(
        "mark", F.col("mark") + F.lit(start))
    slim = rows.select("doc_id", "digest", "mark")
    if index is None:
        index = DigestIndex(spark)
        in_two_batches(slim, index)
    else:
        index.add(slim)
    stays = index.entries().select(F.col("keep_mark").alias("mark"))
    return rows.join(stays, "mark", "left_semi").select("row.*")
