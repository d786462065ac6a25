"""Queries on the documented extensions: doors, walls, colours by edge."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberway.operators import extensions
from emberway.plans import fixtures as x
from emberway.plans._registry import query, r, rounded, table

REACH = 0.2

# a wall a supplier, long on x or on y, of four heights
_AT = {"minx": "(k * 37 % 100 - 50) / 125.0::DOUBLE", "miny": "(k * 53 % 100 - 50) / 125.0::DOUBLE"}
WALLS = f"""walls AS (SELECT id, {_AT['minx']} AS minx, {_AT['minx']} + (1 + k % 5) / 32.0::DOUBLE AS maxx, {_AT['miny']} AS miny, {_AT['miny']} + (1 + k % 3) / 16.0::DOUBLE AS maxy, (k % 4 - 2) / 8.0::DOUBLE AS z_min, (k % 4) / 8.0::DOUBLE AS z_max FROM (SELECT s_suppkey AS id, s_suppkey AS k FROM supplier)),
lines AS (SELECT id, CASE WHEN wide THEN minx ELSE cx END AS sx, CASE WHEN wide THEN cy ELSE miny END AS sy, CASE WHEN wide THEN maxx ELSE cx END AS ex, CASE WHEN wide THEN cy ELSE maxy END AS ey, z_min, z_max
  FROM (SELECT *, maxx - minx >= maxy - miny AS wide, (minx + maxx) / 2 AS cx, (miny + maxy) / 2 AS cy FROM walls))"""


def _walls(spark, sf):
    k = F.col("s_suppkey")
    x0, y0 = (k * 37 % 100 - 50) / 125, (k * 53 % 100 - 50) / 125
    return extensions.wall_lines(table(spark, sf, "supplier").select(
        k.alias("id"), x0.alias("minx"), (x0 + (1 + k % 5) / 32).alias("maxx"), y0.alias("miny"), (y0 + (1 + k % 3) / 16).alias("maxy"), ((k % 4 - 2) / 8).alias("z_min"), ((k % 4) / 8).alias("z_max")))


@query("x1_door_links", f"WITH {x.PTS}, near AS (SELECT a.id AS src, b.id AS dst, {x.DIST} AS d FROM pts a JOIN pts b ON a.is_stair AND NOT b.is_stair WHERE {x.DIST} <= {REACH}), ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS k FROM near) SELECT src, dst, {r('d')} AS d FROM ranked WHERE k <= 5")
def doors(spark, sf):
    """The points that are stairs elsewhere are the doors here."""
    p = x.points(spark, sf)
    return rounded(extensions.door_links(p.where("is_stair"), p.where("not is_stair"), reach=REACH), "d")


@query("x2_wall_lines", f"WITH {WALLS} SELECT id, " + ", ".join(f"{r(k)} AS {k}" for k in ("sx", "sy", "ex", "ey", "z_min", "z_max")) + " FROM lines")
def walls(spark, sf):
    return rounded(_walls(spark, sf), "sx", "sy", "ex", "ey", "z_min", "z_max")


def _turn(a: str, b: str, p: str) -> str:
    return f"sign(({b}x - {a}x) * ({p}y - {a}y) - ({b}y - {a}y) * ({p}x - {a}x))"


@query("x3_uncut_edges", f"""WITH {x.EDGES}, {WALLS}, e AS (SELECT src, dst, src % 10 = 0 AS is_door, a.x AS a_x, a.y AS a_y, a.z AS a_z, b.x AS b_x, b.y AS b_y, b.z AS b_z FROM edges JOIN pts a ON a.id = src JOIN pts b ON b.id = dst)
SELECT src, dst, is_door FROM e WHERE is_door OR NOT EXISTS (SELECT 1 FROM lines WHERE greatest(a_z, b_z) >= z_min AND least(a_z, b_z) <= z_max
  AND {_turn('a_', 'b_', 's')} * {_turn('a_', 'b_', 'e')} <= 0 AND {_turn('s', 'e', 'a_')} * {_turn('s', 'e', 'b_')} <= 0)""")
def uncut(spark, sf):
    return extensions.uncut_edges(x.points(spark, sf), x.RADIUS, _walls(spark, sf), lambda a, b: a["id"] % 10 == 0)


@query("x4_edge_colors", f"""WITH {x.EDGES}, {x.TEMPS}, k AS (SELECT least(src::VARCHAR, dst::VARCHAR) || '|' || greatest(src::VARCHAR, dst::VARCHAR) AS key FROM edges), shown AS (SELECT min(l_orderkey * 8 + l_linenumber) AS edge, least(l_partkey::VARCHAR, l_suppkey::VARCHAR) || '|' || greatest(l_partkey::VARCHAR, l_suppkey::VARCHAR) AS key, min(least(l_partkey, l_suppkey)) AS a, max(greatest(l_partkey, l_suppkey)) AS b FROM lineitem GROUP BY key),
s AS (SELECT edge, (coalesce(m.t, 20) + coalesce(n.t, 20)) / 2 AS t FROM shown JOIN (SELECT DISTINCT key FROM k) USING (key) LEFT JOIN temps m ON m.node = a LEFT JOIN temps n ON n.node = b), n AS (SELECT edge, t, least(greatest((t - 20) / 100, 0), 1) * 4 AS n FROM s)
SELECT edge, {r('t')} AS t, {r('least(greatest(n - 2, 0), 1)')} AS red, {r('CASE WHEN n <= 1 THEN n WHEN n <= 3 THEN 1 ELSE 4 - n END')} AS green, {r('least(greatest(2 - n, 0), 1)')} AS blue FROM n""")
def colors(spark, sf):
    """The edges shown are a line item each, between the nodes of its part's and its supplier's number."""
    shown = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("edge"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return rounded(extensions.edge_colors(x.within(spark, sf), shown, x.measured_temperatures(spark, sf)), "t", "red", "green", "blue")
