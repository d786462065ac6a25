"""Connected components by contraction, without a group that is gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberway.llm._store import written


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of links (a, b): equal labels, and only they, are connected.

    Each round names a node after its least neighbour, or itself if that is less, and puts names
    for nodes in the links; links within a name go. The links at least halve in typical graphs;
    a star takes one round. Only aggregates and joins by node; every round is written. Nulls and
    loops are dropped; no links, no rows.
    """
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = written(edges, "links")
    names = None
    while edges.head(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        now = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "names")
        if names is None:
            names = now
        else:
            later = now.select(F.col("node").alias("old"), F.col("label").alias("new"))
            names = names.join(later, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))
        left, right = (now.select(F.col("node").alias(c), F.col("label").alias(f"{c}2")) for c in "ab")
        step = edges.join(left, "a").join(right, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b")).where("a <> b")
        edges = written(step.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if names is None:
        return links.sparkSession.createDataFrame([], "node long, label long")
    return written(names, "components")
