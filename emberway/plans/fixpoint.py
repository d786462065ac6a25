"""Bounded loops over DataFrames: state is checkpointed in the shared folder, so that lost executors cost no restart."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="emberway-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, by checkpoint() in the folder of spark.checkpoint.dir (one of our own only in local mode)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def cut_counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """cut(df) and, seen by the same job, n, its rows, and for every named condition the rows that meet it."""
    seen = Observation()
    each = [F.count(F.when(c, 1)).alias(k) for k, c in counts.items()]
    return cut(df.observe(seen, F.count("*").alias("n"), *each)), seen.get
