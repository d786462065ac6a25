"""Where queries and their oracles are entered."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Enters a function (spark, sf_dir) as a query, and the SQL that must give the same rows."""

    def enter(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = re.sub(r"\bby\b", '"by"', sql)  # in lower case it is a column
        return f

    return enter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Doubles to some digits, so that two engines agree; -0.0 is 0.0."""
    return df.withColumns({n: F.round(F.col(n), digits) + 0.0 for n in names})


def r(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0"
