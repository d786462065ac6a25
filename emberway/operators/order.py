"""Numbers, parts and running values by an order of all rows, without a task that has them all; unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberway.plans.fixpoint import cut


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Adds a number from 0 in the order of columns.

    Rows are dealt out by range; each part numbers its own, shifted by the sizes of those before.
    Ties get numbers next to each other, in any order.
    """
    parts = cut(rows.repartitionByRange(*order).withColumn("part_of_range", F.spark_partition_id()))
    sizes = parts.groupBy("part_of_range").count()
    shift = F.sum("count").over(W.orderBy("part_of_range").rowsBetween(W.unboundedPreceding, 0)) - F.col("count")
    inside = F.row_number().over(W.partitionBy("part_of_range").orderBy(*order)) - 1
    both = parts.withColumn("inside_part", inside).join(sizes.select("part_of_range", shift.alias("shift_of_part")), "part_of_range")
    return both.withColumn(name, F.col("inside_part") + F.col("shift_of_part")).drop("inside_part", "shift_of_part", "part_of_range")


def since(rows: DataFrame, at: str, begins, name: str) -> DataFrame:
    """Adds to rows numbered by `at` the number of the last row, itself or before it, where begins holds; null before the first."""
    begun = F.max(F.when(begins, F.col(at)))
    parts = cut(rows.repartitionByRange(at).withColumn("part_of_range", F.spark_partition_id()))
    tails = parts.groupBy("part_of_range").agg(begun.alias("tail"))
    before = F.max("tail").over(W.orderBy("part_of_range").rowsBetween(W.unboundedPreceding, -1))
    both = parts.withColumn("inside_part", begun.over(W.partitionBy("part_of_range").orderBy(at))).join(tails.select("part_of_range", before.alias("before_part")), "part_of_range")
    return both.withColumn(name, F.coalesce("inside_part", "before_part")).drop("inside_part", "before_part", "part_of_range")


def running_max(rows: DataFrame, at: str, value: Column, name: str) -> DataFrame:
    """Adds the greatest value of the rows before a row in the order of `at`, its own not among them; null where none of them has one."""
    parts = cut(rows.withColumn("value_of_row", value).repartitionByRange(at).withColumn("part_of_range", F.spark_partition_id()))
    tails = parts.groupBy("part_of_range").agg(F.max("value_of_row").alias("tail"))
    before = F.max("tail").over(W.orderBy("part_of_range").rowsBetween(W.unboundedPreceding, -1))
    inside = F.max("value_of_row").over(W.partitionBy("part_of_range").orderBy(at).rowsBetween(W.unboundedPreceding, -1))
    both = parts.withColumn("inside_part", inside).join(tails.select("part_of_range", before.alias("before_part")), "part_of_range")
    return both.withColumn(name, F.greatest("inside_part", "before_part")).drop("value_of_row", "inside_part", "before_part", "part_of_range")


def in_parts(rows: DataFrame, keys: list[str], order: list[str], chunk: int) -> DataFrame:
    """Adds at, a row's number among all by keys and order, pos, that among the rows of its keys, part, that of its chunk of so many rows, and parts, how many its keys have.

    Rows with a null key are left out.
    """
    rows = cut(numbered(rows.dropna(subset=keys), [*keys, *order], "at"))
    sizes = rows.groupBy(*keys).agg(F.min("at").alias("first"), F.ceil(F.count("*") / chunk).alias("parts"))
    rows = rows.join(sizes, keys).withColumn("pos", F.col("at") - F.col("first")).drop("first")
    return rows.withColumn("part", F.floor(F.col("pos") / chunk))


def union(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables, by column names."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
