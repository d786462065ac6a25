"""Shared scratch tables: lineage is cut by written Parquet, never by a machine-local folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only in local mode, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="emberway-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


BATCH_BYTES = 4 << 20  #: bytes of rows that Spark hands to a Python worker at a time


def small_batches(spark: SparkSession) -> SparkSession:
    """spark, whose Arrow batches are from now on bounded by bytes too, not by their 10,000 rows alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder, by a codec if one is named, and read back."""
    spark = small_batches(df.sparkSession)
    path = f"{shared_dir(spark)}/emberway/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """docs with a number of each row as column key, written once, so that all later jobs see the same numbers."""
    from pyspark.sql import functions as F

    return written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")


def kept_rows(docs: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Rows of docs (from keyed()) whose key is in keep, without the key.

    Columns of docs may have any names.
    """
    return docs.join(keep.select(key), key, "left_semi").drop(key)


def unused(names: list[str], base: str) -> str:
    """base, with underscores until no column has that name."""
    lower = {n.lower() for n in names}
    while base.lower() in lower:
        base += "_"
    return base
