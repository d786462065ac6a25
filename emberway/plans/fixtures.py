"""Domain tables derived from the driver's tables, by one formula for Spark and one, the same, for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberway.operators import graph
from emberway.plans._registry import table

RADIUS = 0.1
FIELD_STEPS = 3

PTS = "pts AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label = 0 AS is_stair FROM embeddings)"
DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
EDGES = f"{PTS}, edges AS (SELECT a.id AS src, b.id AS dst, {DIST} AS d FROM pts a JOIN pts b ON a.id < b.id WHERE {DIST} <= {RADIUS})"
ARCS = f"{EDGES}, arcs AS (SELECT src, dst, d FROM edges UNION ALL SELECT dst, src, d FROM edges)"


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes: the first three components of each embedding; label 0 stands for a stair."""
    at = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), (F.col("label") == 0).alias("is_stair"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.radius_graph(points(spark, sf), RADIUS)


def within(spark: SparkSession, sf: str) -> graph.Within:
    """The arcs of edges(), both ways, as they are asked for."""
    return graph.Within(points(spark, sf).select("id", "x", "y", "z"), RADIUS)


def arcs(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "d"))


TEMPS = "temps AS (SELECT user_id AS node, 20 + avg(value) AS t FROM events GROUP BY user_id)"


def measured_temperatures(spark: SparkSession, sf: str) -> DataFrame:
    """A user's mean value above 20 degrees, for the node of the user's id."""
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("node")).agg((F.lit(20) + F.avg("value")).alias("t"))


_SLAB = """slab AS (SELECT s_suppkey AS geom_id, CASE WHEN s_suppkey % 4 = 0 THEN 'stair' ELSE 'floor' END AS kind,
  CAST((s_suppkey % 50) * 10 AS DOUBLE) AS x, CAST(floor(s_suppkey / 50.0) * 10 AS DOUBLE) AS y, CAST(s_nationkey * 3 AS DOUBLE) AS z,
  CAST(2 + s_suppkey % 7 AS DOUBLE) AS w, ((s_suppkey % 11) - 3) * 0.5 * (2 + s_suppkey % 7) AS t, s_suppkey % 13 = 0 AS flip FROM supplier),
two AS (SELECT geom_id, kind, 0 AS tri_no, flip, x AS ax, y AS ay, z AS az, x + w AS px, y AS py, z AS pz, x AS qx, y + w AS qy, z + t AS qz FROM slab
  UNION ALL SELECT geom_id, kind, 1, flip, x + w, y + w, z + t, x, y + w, z + t, x + w, y, z FROM slab)"""
_PICK = ", ".join(f"CASE WHEN flip THEN {u}{k} ELSE {v}{k} END AS {n}{k}" for n, v, u in (("b", "p", "q"), ("c", "q", "p")) for k in "xyz")
TRI = f"{_SLAB}, tri AS (SELECT geom_id, kind, tri_no, ax, ay, az, {_PICK} FROM two)"
_N = ("((by - ay) * (cz - az) - (bz - az) * (cy - ay))", "((bz - az) * (cx - ax) - (bx - ax) * (cz - az))", "((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))")
_L = f"sqrt({_N[0]} * {_N[0]} + {_N[1]} * {_N[1]} + {_N[2]} * {_N[2]})"
MEASURED = f"{TRI}, measured AS (SELECT *, " + ", ".join(f"CASE WHEN {_L} > 0 THEN {n} / {_L} ELSE 0 END AS u{k}" for n, k in zip(_N, "xyz")) + f", 0.5 * {_L} AS area FROM tri)"


def triangles(spark: SparkSession, sf: str) -> DataFrame:
    """Two triangles a supplier: slabs of some tilt on a grid of places, a few face down; every fourth is a stair."""
    k = F.col("s_suppkey")
    slab = table(spark, sf, "supplier").select(
        k.alias("geom_id"), F.when(k % 4 == 0, "stair").otherwise("floor").alias("kind"), ((k % 50) * 10).cast("double").alias("x"),
        (F.floor(k / 50) * 10).cast("double").alias("y"), (F.col("s_nationkey") * 3).cast("double").alias("z"),
        (2 + k % 7).cast("double").alias("w"), (((k % 11) - 3) * 0.5 * (2 + k % 7)).alias("t"), (k % 13 == 0).alias("flip"))
    x, y, z, w, t = (F.col(c) for c in "xyzwt")
    point = lambda a, b, c: F.struct(a.alias("x"), b.alias("y"), c.alias("z"))
    tri = lambda i, a, p, q: F.struct(F.lit(i).alias("tri_no"), a.alias("a"), F.when(F.col("flip"), q).otherwise(p).alias("b"), F.when(F.col("flip"), p).otherwise(q).alias("c"))
    both = F.array(tri(0, point(x, y, z), point(x + w, y, z), point(x, y + w, z + t)), tri(1, point(x + w, y + w, z + t), point(x, y + w, z + t), point(x + w, y, z)))
    return slab.select("geom_id", "kind", F.explode(both).alias("r")).select("geom_id", "kind", "r.tri_no", *(F.col(f"r.{p}.{a}").alias(p + a) for p in "abc" for a in "xyz"))


BOXES = """boxes AS (SELECT n_nationkey AS id, n_regionkey AS model, n_nationkey % 3 = 0 AS is_stair, CAST((n_nationkey % 5) * 10 AS DOUBLE) AS minx, CAST((n_nationkey % 5) * 10 + 4 + n_nationkey % 3 AS DOUBLE) AS maxx,
  CAST(floor(n_nationkey / 5.0) * 10 AS DOUBLE) AS miny, CAST(floor(n_nationkey / 5.0) * 10 + 3 + n_nationkey % 4 AS DOUBLE) AS maxy, n_nationkey * 0.7 AS z, n_nationkey * 0.7 AS z_min, n_nationkey * 0.7 + 2.5 AS z_max FROM nation)"""


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """A box a nation, its region the model; every third is a stair."""
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        k.alias("id"), F.col("n_regionkey").alias("model"), (k % 3 == 0).alias("is_stair"), ((k % 5) * 10).cast("double").alias("minx"), ((k % 5) * 10 + 4 + k % 3).cast("double").alias("maxx"),
        (F.floor(k / 5) * 10).cast("double").alias("miny"), (F.floor(k / 5) * 10 + 3 + k % 4).cast("double").alias("maxy"), (k * 0.7).alias("z"), (k * 0.7).alias("z_min"), (k * 0.7 + 2.5).alias("z_max"))


WIRES = "wires AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, min(l_returnflag) AS kind FROM lineitem GROUP BY l_partkey, l_suppkey)"


def wires(spark: SparkSession, sf: str) -> DataFrame:
    """Parts and suppliers joined where a line item has both; the least return flag is the edge's kind."""
    pairs = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_returnflag").alias("kind"))
    return pairs.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), "kind")
