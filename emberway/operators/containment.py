"""Containment of topology levels: children, ancestors at every level, nested spans, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberway.operators.order import in_parts, numbered, running_max, union

CHUNK = 1_000  #: children that a row lists at most


def uids(entities: DataFrame, prefix: str, order: list[str]) -> DataFrame:
    """Adds uid, the prefix and a number from 0 in an order of columns."""
    rows = numbered(entities, order, "number_of_uid")
    return rows.withColumn("uid", F.concat(F.lit(prefix), F.col("number_of_uid").cast("string"))).drop("number_of_uid")


def child_rows(contains: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """parent, pos, child, part, parts: each child of a parent once, numbered from 0 in their order, `chunk` of them a part. Links with a null end are none."""
    links = contains.select("parent", "child").dropna().distinct()
    return in_parts(links, ["parent"], ["child"], chunk).select("parent", "pos", "child", "part", "parts")


def children(contains: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """parent, part, parts, children: the sorted children of each parent, each once, in parts of at most `chunk`, so that no row or task holds all of a parent's."""
    lists = child_rows(contains, chunk).groupBy("parent", "part", "parts").agg(F.sort_array(F.collect_list("child")).alias("children"))
    return lists.select("parent", "part", "parts", "children")


def ancestors(contains: list[tuple[str, DataFrame]]) -> DataFrame:
    """uid, level, ancestor: all ancestors of each entity, each once.

    contains: (the parents' level, (parent, child)) from the top level down. One join a level; the
    closure of a level is that of the level above, met by its links.
    """
    total, above = None, None
    for level, links in contains:
        own = links.select(F.col("child").alias("uid"), F.lit(level).alias("level"), F.col("parent").alias("ancestor"))
        if above is not None:
            far = links.join(above.withColumnRenamed("uid", "parent"), "parent").select(F.col("child").alias("uid"), "level", "ancestor")
            own = own.unionByName(far)
        above = own.distinct()
        total = above if total is None else total.unionByName(above)
    return total


def parents_map(closure: DataFrame) -> DataFrame:
    """uid, parents: a map from level to the sorted ancestors there."""
    lists = closure.groupBy("uid", "level").agg(F.sort_array(F.collect_set("ancestor")).alias("a"))
    return lists.groupBy("uid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("level", "a")))).alias("parents"))


def level_counts(rows: DataFrame, levels: list[str], measure: Column) -> DataFrame:
    """Counts and totals on each level of a hierarchy and above it, by rollup."""
    return rows.rollup(*levels).agg(F.count("*").alias("n"), measure.alias("total"), F.grouping_id().alias("depth"))


def selection_chain(closure: DataFrame, levels: list[str], own_level: str) -> DataFrame:
    """uid, pos, level, entity: an entity's ancestors in the order of levels, then itself, each once."""
    rank = F.array_position(F.array(*map(F.lit, levels)), F.col("level"))
    own = closure.select("uid").distinct().select("uid", F.lit(own_level).alias("level"), F.col("uid").alias("ancestor"))
    rows = closure.unionByName(own).distinct().withColumn("rank", F.when(F.col("ancestor") == F.col("uid"), len(levels) + 1).otherwise(rank))
    pos = F.row_number().over(W.partitionBy("uid").orderBy("rank", "ancestor")) - 1
    return rows.select("uid", pos.alias("pos"), "level", F.col("ancestor").alias("entity"))


def cycled(chain: Column, index: Column, level: Column | None = None) -> Column:
    """The entry after index in an array, round and round."""
    return F.element_at(chain, (F.pmod(index + 1, F.size(chain)) + 1).cast("int"))


def next_in_chain(chain: DataFrame) -> DataFrame:
    """Adds next: the entity after each entry (uid, pos, entity) of a selection chain, the first one after the last."""
    w = W.partitionBy("uid").orderBy("pos")
    return chain.withColumn("next", F.coalesce(F.lead("entity").over(w), F.first("entity").over(w)))


def nested(contains: list[tuple[str, DataFrame]], leaf: str) -> DataFrame:
    """uid, level, path, lo, hi: the nested spans of entities; leaf names the level below the last links.

    contains as for `ancestors`; uids differ between levels. path leads from the top down to the entity, an entity with
    several parents has a row a path. lo numbers the paths so that what lies below an entity has the numbers after its
    own, up to hi. An entity whose parent is nowhere is a top of its own; links with a null end are none.

    One join a level; the numbers are by range, the spans one aggregate, most of which is done where the rows lie.
    """
    names = [level for level, _ in contains] + [leaf]
    found, reached, held = [], None, None
    for level, links in contains:
        links = links.select("parent", "child").dropna().distinct()
        tops = links.select(F.col("parent").alias("uid")).distinct()
        if held is not None:
            tops = tops.join(held, "uid", "left_anti")
        here = tops.select("uid", F.array("uid").alias("path"))
        here = here if reached is None else reached.unionByName(here)
        found.append(here)
        held = links.select(F.col("child").alias("uid")).distinct()
        reached = here.join(links, F.col("uid") == F.col("parent")).select(F.col("child").alias("uid"), F.concat("path", F.array("child")).alias("path"))
    found.append(reached)
    rows = numbered(union([df.select("path", F.lit(name).alias("level")) for name, df in zip(names, found)]), ["path"], "lo")
    above = F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k))
    spans = rows.select(F.explode(above).alias("path"), "level", "lo").groupBy("path").agg(F.min_by("level", "lo").alias("level"), F.min("lo").alias("lo"), F.max("lo").alias("hi"))
    return spans.select(F.element_at("path", -1).alias("uid"), "level", "path", "lo", "hi")


def below(nest: DataFrame, wanted: Column) -> DataFrame:
    """uid of all entities of nested spans under any entity that meets a condition, each once.

    An entity lies below if a wanted span that begins before it reaches it: a running maximum, no join, for any number of wanted ones.
    """
    return running_max(nest, "lo", F.when(wanted, F.col("hi")), "reach").where("reach >= lo").select("uid").distinct()
