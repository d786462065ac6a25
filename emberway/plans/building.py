"""Queries on the detection of floors and stairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberway.operators import elements, graph, sampling
from emberway.plans import fixtures as x
from emberway.plans._registry import query, r, rounded, table

STAIR = elements.STAIR
PRODUCT = f"""{x.MEASURED}, prod AS (SELECT geom_id, min(least(ax, bx, cx)) AS minx, max(greatest(ax, bx, cx)) AS maxx, min(least(ay, by, cy)) AS miny, max(greatest(ay, by, cy)) AS maxy, min(least(az, bz, cz)) AS minz, max(greatest(az, bz, cz)) AS maxz, avg(abs(uz)) AS mean_nz FROM measured GROUP BY geom_id),
shape AS (SELECT *, maxx - minx AS sx, maxy - miny AS sy, maxz - minz AS sz, (maxx - minx) * (maxy - miny) AS box_area FROM prod)"""


def _products(spark, sf):
    return elements.product_boxes(sampling.measured(x.triangles(spark, sf)))


@query("b1_distinct_vertices", f"WITH {x.TRI}, c AS (SELECT geom_id * 100 + tri_no * 10 + 0 AS o, ax AS x, ay AS y, az AS z FROM tri UNION ALL SELECT geom_id * 100 + tri_no * 10 + 1, bx, by, bz FROM tri UNION ALL SELECT geom_id * 100 + tri_no * 10 + 2, cx, cy, cz FROM tri), f AS (SELECT round(x, 6) AS kx, round(y, 6) AS ky, round(z, 6) AS kz, min(o) AS o, min_by(x, o) AS x, min_by(y, o) AS y, min_by(z, o) AS z FROM c GROUP BY 1, 2, 3) SELECT 'v' || (row_number() OVER (ORDER BY o) - 1) AS uid, x, y, z FROM f")
def vertices(spark, sf):
    corners = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), *(F.col(p + k).alias(k) for k in "xyz")) for i, p in enumerate("abc"))))
    rows = x.triangles(spark, sf).select("geom_id", "tri_no", corners.alias("c")).select((F.col("geom_id") * 100 + F.col("tri_no") * 10 + F.col("c.i")).alias("ordinal"), "c.x", "c.y", "c.z")
    return elements.distinct_vertices(rows)


@query("b2_face_rows", "WITH " + x.TRI + " SELECT geom_id, tri_no, 'f' || (row_number() OVER (ORDER BY geom_id, tri_no) - 1) AS uid, s_name AS name FROM tri JOIN supplier ON s_suppkey = geom_id")
def faces(spark, sf):
    from emberway.operators.containment import uids

    rows = x.triangles(spark, sf).select("geom_id", "tri_no").join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("geom_id"), F.col("s_name").alias("name")), "geom_id")
    return uids(rows, "f", ["geom_id", "tri_no"])


@query("b3_name_hints", "SELECT p_partkey, upper(p_name) LIKE '%A%' OR upper(p_type) LIKE '%STEEL%' AS like_a FROM part")
def hints(spark, sf):
    t = table(spark, sf, "part")
    return t.select("p_partkey", (elements.hint("a", "p_name") | elements.hint("steel", "p_type")).alias("like_a"))


@query("b4_product_boxes", f"WITH {PRODUCT} SELECT geom_id, {r('sx')} AS spanx, {r('sy')} AS spany, {r('sz')} AS spanz, {r('box_area')} AS box_area, {r('mean_nz')} AS mean_nz FROM shape")
def boxes(spark, sf):
    return rounded(_products(spark, sf).select("geom_id", "spanx", "spany", "spanz", "box_area", "mean_nz"), "spanx", "spany", "spanz", "box_area", "mean_nz")


@query("b5_stair_shapes", f"WITH {PRODUCT} SELECT geom_id FROM shape WHERE sz BETWEEN 1 AND 4 AND greatest(sx, sy) >= 1 AND mean_nz BETWEEN 0.2 AND 0.8 AND sz / greatest(sx, sy) >= 0.2")
def stair_shapes(spark, sf):
    return _products(spark, sf).where(elements.like_stair()).select("geom_id")


@query("b6_floor_shapes", f"WITH {PRODUCT} SELECT geom_id FROM shape WHERE box_area >= 9.0 AND (mean_nz >= 0.3 OR sz <= 1.0)")
def floor_shapes(spark, sf):
    return _products(spark, sf).where(elements.like_floor()).select("geom_id")


@query("b7_footprints", f"WITH {x.TRI} SELECT DISTINCT geom_id, x, y FROM (SELECT geom_id, round(ax, 4) AS x, round(ay, 4) AS y FROM tri UNION ALL SELECT geom_id, round(bx, 4), round(by, 4) FROM tri UNION ALL SELECT geom_id, round(cx, 4), round(cy, 4) FROM tri)")
def footprints(spark, sf):
    return elements.footprint(x.triangles(spark, sf))


@query("b8_treads", f"WITH {x.MEASURED} SELECT geom_id, tri_no, {r('(az / 10 + bz / 10 + cz / 10) / 3')} AS z FROM measured WHERE abs(uz) >= 0.95 AND area / 16 BETWEEN 0.25 AND 3.0 AND greatest(greatest(ax, bx, cx) - least(ax, bx, cx), greatest(ay, by, cy) - least(ay, by, cy)) / 4 <= 1.8")
def treads(spark, sf):
    tri = x.triangles(spark, sf)
    small = tri.select("geom_id", "kind", "tri_no", *((F.col(p + k) / (10 if k == "z" else 4)).alias(p + k) for p in "abc" for k in "xyz"))
    unit = sampling.measured(tri).select("geom_id", "tri_no", "uz", (F.col("area") / 16).alias("area"))
    rows = small.join(unit, ["geom_id", "tri_no"]).withColumn("model", F.lit(0).cast("long"))
    out = elements.treads(rows).select(F.split("tread", ":").alias("k"), "z")
    return rounded(out.select(F.col("k")[0].cast("long").alias("geom_id"), F.col("k")[1].cast("int").alias("tri_no"), "z"), "z")


# flights of eight treads side by side: neighbours overlap, rises differ from flight to flight, some treads are out of step
TREADS = """treads AS (SELECT f % 7 AS model, CAST(p_partkey AS VARCHAR) AS tread, (f % 40) * 0.6 AS minx, (f % 40) * 0.6 + 1.0 AS maxx, floor(f / 40) * 0.7 AS miny, floor(f / 40) * 0.7 + 1.0 AS maxy,
  (i * (13 + 2 * (f % 5)) + f % 3 + CASE WHEN p_size % 11 = 0 THEN 3 WHEN p_size % 7 = 0 THEN 1 ELSE 0 END) / 100 AS z FROM (SELECT *, p_partkey // 8 AS f, p_partkey % 8 AS i FROM part))"""
_CHAINS = f"""WITH RECURSIVE {TREADS}, t AS (SELECT *, row_number() OVER (ORDER BY model, z, tread) AS n FROM treads),
arcs AS (SELECT a.n AS p, b.n AS s, b.z - a.z AS rise FROM t a JOIN t b ON a.model = b.model AND b.z - a.z BETWEEN {STAIR['min_rise']} AND {STAIR['max_rise']}
  AND least(a.maxx, b.maxx) - greatest(a.minx, b.minx) >= {STAIR['overlap']} AND least(a.maxy, b.maxy) - greatest(a.miny, b.miny) >= {STAIR['overlap']}),
nexts AS (SELECT p, list(s ORDER BY rise, s) AS nexts FROM arcs GROUP BY p), all_of AS (SELECT model, min(n) AS lo, max(n) AS hi FROM t GROUP BY model),
walk(model, lo, hi, taken, base, here, rank) AS (SELECT model, lo, hi, [lo], lo, lo, 1 FROM all_of UNION ALL
  SELECT model, lo, hi, list_append(taken, coalesce(up, fresh)), if(up IS NULL, fresh, base), coalesce(up, fresh), rank + 1 FROM (
    SELECT walk.*, list_filter(nexts, lambda x: NOT list_contains(taken, x))[1] AS up, list_filter(range(base + 1, hi + 1), lambda x: NOT list_contains(taken, x))[1] AS fresh FROM walk LEFT JOIN nexts ON p = here)
  WHERE coalesce(up, fresh) IS NOT NULL),
each AS (SELECT model, base, rank, minx, maxx, miny, maxy, z, z - lag(z) OVER (PARTITION BY walk.model, base ORDER BY rank) AS rise FROM walk JOIN t USING (model) WHERE t.n = here),
chains AS (SELECT model, base, count(*) AS n, min(minx) AS minx, max(maxx) AS maxx, min(miny) AS miny, max(maxy) AS maxy, min(z) AS z_min, max(z) AS z_max, max(rise) - min(rise) AS spread FROM each GROUP BY model, base)
SELECT model, row_number() OVER (PARTITION BY model ORDER BY base) - 1 AS stair, n, {r('minx')} AS minx, {r('maxx')} AS maxx, {r('miny')} AS miny, {r('maxy')} AS maxy, {r('z_min')} AS z_min, {r('z_max')} AS z_max
FROM chains WHERE n >= {STAIR['treads']} AND z_max - z_min >= {STAIR['total_rise']} AND spread <= {STAIR['spread']}"""


def flights(spark, sf):
    """model, tread and bounds of TREADS."""
    p, f, i = table(spark, sf, "part"), F.floor(F.col("p_partkey") / 8), F.col("p_partkey") % 8
    odd = F.when(F.col("p_size") % 11 == 0, 3).when(F.col("p_size") % 7 == 0, 1).otherwise(0)
    x0, y0 = (f % 40) * F.lit(0.6), F.floor(f / 40) * F.lit(0.7)
    return p.select((f % 7).alias("model"), F.col("p_partkey").cast("string").alias("tread"), x0.alias("minx"), (x0 + 1.0).alias("maxx"), y0.alias("miny"), (y0 + 1.0).alias("maxy"), ((i * (13 + 2 * (f % 5)) + f % 3 + odd) / 100).alias("z"))


@query("b9_stair_chains", _CHAINS)
def chains(spark, sf):
    return rounded(elements.stair_chains(flights(spark, sf)), "minx", "maxx", "miny", "maxy", "z_min", "z_max")


@query("b10_hint_override", f"WITH {PRODUCT} SELECT geom_id, 'named floor' AS origin FROM prod WHERE geom_id % 5 = 0 UNION ALL SELECT geom_id, 'named stair' FROM prod WHERE geom_id % 10 = 0")
def override(spark, sf):
    p = _products(spark, sf)
    tell = lambda rows, origin: rows.select("geom_id", F.lit(origin).alias("origin"))
    return elements.with_hints(tell(p.where(elements.like_floor()), "shape"), tell(p.where("geom_id % 5 = 0"), "named floor"), tell(p.where("geom_id % 10 = 0"), "named stair"))


@query("b11_merged_levels", f"""WITH RECURSIVE {x.BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY z, id) AS place FROM boxes),
f(model, place, level, is_stair, z, n, minx, maxx, miny, maxy, z_min, z_max) AS (SELECT model, place, 0, is_stair, z, 1::BIGINT, minx, maxx, miny, maxy, z_min, z_max FROM o WHERE place = 1
UNION ALL SELECT model, place, IF(same, level, level + 1), is_stair, IF(same, (fz * fn + z) / (fn + 1), z), IF(same, fn + 1, 1), IF(same, least(minx, fminx), minx), IF(same, greatest(maxx, fmaxx), maxx),
IF(same, least(miny, fminy), miny), IF(same, greatest(maxy, fmaxy), maxy), IF(same, least(z_min, fz_min), z_min), IF(same, greatest(z_max, fz_max), z_max)
FROM (SELECT o.*, f.level, f.z AS fz, f.n AS fn, f.minx AS fminx, f.maxx AS fmaxx, f.miny AS fminy, f.maxy AS fmaxy, f.z_min AS fz_min, f.z_max AS fz_max, abs(o.z - f.z) <= 1.5 AND o.is_stair = f.is_stair AS same FROM f JOIN o ON o.model = f.model AND o.place = f.place + 1))
SELECT model, level, {r('z')} AS z, n, is_stair, minx, maxx, miny, maxy, {r('z_min')} AS z_min, {r('z_max')} AS z_max FROM f QUALIFY place = max(place) OVER (PARTITION BY model, level)""")
def levels(spark, sf):
    b = x.boxes(spark, sf).select("model", F.col("id").alias("box"), "is_stair", "z", "minx", "maxx", "miny", "maxy", "z_min", "z_max")
    return rounded(elements.merged_levels(b), "z", "z_min", "z_max")


@query("b13_floors_or_all", f"WITH {x.BOXES} SELECT model, id FROM boxes WHERE NOT is_stair OR model NOT IN (SELECT model FROM boxes WHERE NOT is_stair)")
def floors(spark, sf):
    return elements.floors_or_all(x.boxes(spark, sf)).select("model", "id")


@query("b14_stair_connectors", f"WITH {x.BOXES} SELECT id, 'stair' AS kind, (minx + maxx) / 2 AS ax, (miny + maxy) / 2 AS ay, {r('z_min + 0.05')} AS az, {r('z_max - 0.05')} AS bz FROM boxes WHERE is_stair")
def connectors(spark, sf):
    return rounded(elements.stair_connectors(x.boxes(spark, sf).where("is_stair")).select("id", "kind", "ax", "ay", "az", "bz"), "az", "bz")


@query("b15_grid_wires", f"""WITH {x.BOXES}, s AS (SELECT *, greatest(least(maxx - minx, maxy - miny) / CASE WHEN is_stair THEN 6 ELSE 12 END, CASE WHEN is_stair THEN 0.5 ELSE 0.75 END) AS step FROM boxes),
n AS (SELECT *, greatest(2, CAST(floor((maxx - minx) / step) AS INTEGER) + 1) AS nx, greatest(2, CAST(floor((maxy - miny) / step) AS INTEGER) + 1) AS ny FROM s)
SELECT id, 'grid_x' AS kind, CAST(i AS INTEGER) AS line, {r('minx + i * step')} AS ax, miny AS ay, {r('minx + i * step')} AS bx, maxy AS by FROM (SELECT *, unnest(range(0, nx + 1)) AS i FROM n)
UNION ALL SELECT id, 'grid_y', CAST(i AS INTEGER), minx, {r('miny + i * step')}, maxx, {r('miny + i * step')} FROM (SELECT *, unnest(range(0, ny + 1)) AS i FROM n)
UNION ALL SELECT id, 'stair_diag', 0, minx, miny, maxx, maxy FROM boxes WHERE is_stair""")
def grid(spark, sf):
    return rounded(elements.grid_wires(x.boxes(spark, sf)).select("id", "kind", "line", "ax", "ay", "bx", "by"), "ax", "ay", "bx", "by")


@query("b16_egress_line", f"""WITH {x.BOXES}, c AS (SELECT model, id, (minx + maxx) / 2 AS x, (miny + maxy) / 2 AS y, z FROM boxes WHERE NOT is_stair),
f AS (SELECT *, row_number() OVER w AS seq, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM c WINDOW w AS (PARTITION BY model ORDER BY z, id)),
s AS (SELECT model, id, (minx + maxx) / 2 AS sx, (miny + maxy) / 2 AS sy, (z_min + z_max) / 2 AS sz FROM boxes WHERE is_stair),
k AS (SELECT f.model, seq, coalesce(sx, (x + nx) / 2) AS sx, coalesce(sy, (y + ny) / 2) AS sy, coalesce(sz, (z + nz) / 2) AS sz, row_number() OVER (PARTITION BY f.model, seq ORDER BY abs((z + nz) / 2 - sz), s.id) AS n FROM f LEFT JOIN s ON s.model = f.model WHERE nz IS NOT NULL)
SELECT model, CAST(seq AS INTEGER) AS seq, 0 AS part, {r('x')} AS x, {r('y')} AS y, {r('z')} AS z FROM f WHERE nz IS NOT NULL
UNION ALL SELECT model, seq, 1, {r('sx')}, {r('sy')}, {r('sz')} FROM k WHERE n = 1
UNION ALL SELECT model, seq, 2, {r('nx')}, {r('ny')}, {r('nz')} FROM f WHERE nz IS NOT NULL""")
def egress(spark, sf):
    b = x.boxes(spark, sf)
    return rounded(elements.egress_line(b.where("not is_stair"), b.where("is_stair")), "x", "y", "z")


@query("b17_wire_kinds", f"WITH {x.WIRES}, k AS (SELECT src, dst FROM wires WHERE kind <> 'R') SELECT count(*) * 2 AS arcs FROM k")
def wire_kinds(spark, sf):
    w = x.wires(spark, sf)
    w = w.where("kind <> 'R'")
    nodes = w.select(F.col("src").alias("id")).union(w.select("dst")).distinct()
    return graph.adjacency(w, nodes).agg(F.count("*").alias("arcs"))
