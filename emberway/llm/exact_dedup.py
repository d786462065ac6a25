"""Exact dedup against a persistent digest index, bucketed and sorted by digest (native)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberway.llm._store import written

BLANKS = " \t\n\x0b\x0c\r"


def digest(text: Column) -> Column:
    """SHA-256 of the text without its [\\x20\\x09-\\x0D] characters; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), BLANKS, ""), 256))


class DigestIndex:
    """A saved table (digest, keep_id, keep_row, n_rows, batch), bucketed and sorted by digest.

    Its files lie in the warehouse, which the cluster shares. Rows are only appended, each digest
    once, with the batch that brought it: a batch that is run again finds its own digests as new
    as before. `buckets` stays as it was when the table was made.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = 16):
        self.spark, self.table, self.buckets = spark, table, buckets

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, rows: DataFrame) -> None:
        """Adds rows of digests that the index lacks, one file a bucket."""
        (rows.repartition(self.buckets, "digest").write.format("parquet").mode("append")
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table))
        self.spark.catalog.refreshTable(self.table)

    def compact(self) -> None:
        """Writes the table anew, as one file a bucket, once appends have left many."""
        new = DigestIndex(self.spark, f"{self.table}_compacted", self.buckets)
        new.append(self.read())
        self.spark.sql(f"drop table {self.table}")
        self.spark.sql(f"alter table {new.table} rename to {self.table}")
        self.spark.catalog.refreshTable(self.table)


def digests(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(doc_id, digest, n_chars, row) for each row of docs, written once; row, the key if there is one, tells repeated rows apart."""
    return written(docs.select(
        "doc_id", digest(F.col("text")).alias("digest"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"),
        (F.col(key) if key else F.monotonically_increasing_id()).alias("row")), "digests")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, key: str | None = None, batch: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when equal without white space [\\x20\\x09-\\x0D]; null counts as empty, so
    all blank texts are one group. Of a batch's equal texts the longest original stays, then the
    smallest doc_id (null last), then one of identical rows. A digest that the index already
    holds keeps the row that it names, so the batch keeps none of that group; group_size counts
    the batch's rows and those counted when the digest was added. The batch's groups are
    anti-joined with the index by sort-merge, those left are appended; without an index an empty
    one is made, and dropped again. A group of any size is one row of the index, and its rows may
    be split among tasks. An empty table gives no rows. Other columns of docs are not read, but for
    key, a column of whole numbers, each once and not below 0: it is returned too.

    batch names the rows given: where a run was lost after its digests were appended, the same
    batch under the same name is told the same again, and appended no second time. Without a name
    each call is a batch of its own.
    """
    spark = docs.sparkSession
    own = index is None
    index = index or DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = F.lit(batch or uuid.uuid4().hex)
    rows = digests(docs, key)
    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "row"))
    groups = rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("n_rows"))
    groups = groups.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "n_rows", name.alias("batch"))
    if not spark.catalog.tableExists(index.table):
        index.append(groups.limit(0))
    old = index.read()
    # the batch's groups once, with what the index held of each before: the only join with the index, by its buckets
    held = old.select("digest", F.col("keep_id").alias("old_id"), F.col("n_rows").alias("old_rows"), F.col("batch").alias("old_batch"))
    known = groups.join(held.hint("merge"), "digest").select("digest", "old_id", "old_rows", "old_batch")
    known = written(known, "known")
    fresh = written(groups.join(old.select("digest").hint("merge"), "digest", "left_anti"), "fresh")
    index.append(fresh)
    again = F.col("old_batch") == name
    seen = known.join(groups, "digest").select(
        "digest", F.when(again, F.col("keep_id")).otherwise(F.col("old_id")).alias("keep_id"), F.when(again, F.col("keep_row")).otherwise(F.lit(-1)).cast("long").alias("keep_row"),
        F.when(again, F.col("n_rows")).otherwise(F.col("old_rows") + F.col("n_rows")).alias("n_rows"))
    told = fresh.drop("batch").unionByName(seen)
    if own:
        spark.sql(f"drop table {index.table}")
    return _told(rows, told, key)


def _told(rows: DataFrame, groups: DataFrame, key: str | None = None) -> DataFrame:
    return rows.join(groups.hint("merge"), "digest").select(
        "doc_id", "keep_id", F.col("n_rows").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), *([F.col("row").alias(key)] if key else []))
