"""Queries on triangle geometry and walkable points."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberway.functions import geometry
from emberway.operators import sampling
from emberway.plans import fixtures as x
from emberway.plans._registry import query, r, rounded, table

FLOOR_UP, STAIR_UP = geometry.least_up(10), geometry.least_up(45)
_LOW = f"CASE WHEN kind = 'stair' THEN {STAIR_UP!r} ELSE {FLOOR_UP!r} END"
WALK = f"{x.MEASURED}, roof AS (SELECT max(greatest(az, bz, cz)) - 1.0 AS top FROM tri), walk AS (SELECT measured.* FROM measured, roof WHERE area > 1e-6 AND uz >= {_LOW} AND least(az, bz, cz) < top)"
LATTICE = f"""{WALK}, s AS (SELECT *, CAST(greatest(1, ceil(sqrt(area) / 1.5)) AS INTEGER) AS s FROM walk),
uv AS (SELECT *, unnest(range(0, s + 1)) AS u FROM s), uvw AS (SELECT *, unnest(range(0, s - u + 1)) AS v FROM uv),
lat AS (SELECT geom_id, kind, tri_no, u, v, """ + ", ".join(f"a{k} * (1.0::DOUBLE - u::DOUBLE / s - v::DOUBLE / s) + b{k} * (u::DOUBLE / s) + c{k} * (v::DOUBLE / s) AS {k}" for k in "xyz") + " FROM uvw WHERE 1.0::DOUBLE - u::DOUBLE / s - v::DOUBLE / s >= 0)"


def _walkable(spark, sf):
    tri = x.triangles(spark, sf)
    low = F.when(F.col("kind") == "stair", STAIR_UP).otherwise(FLOOR_UP)
    return sampling.walkable(tri, low, roof=sampling.roof_level(tri))


@query("g1_up_axis", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 WHEN p_partkey % 3 = 1 THEN 0 ELSE 2 END AS axis FROM part")
def up_axis(spark, sf):
    name = F.element_at(F.array(F.lit("Y"), F.lit("x"), F.lit("?")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", geometry.up_axis(name).alias("axis"))


@query("g2_normals_and_areas", f"WITH {x.MEASURED} SELECT geom_id, tri_no, {r('ux')} AS ux, {r('uy')} AS uy, {r('uz')} AS uz, {r('area')} AS area FROM measured")
def normals(spark, sf):
    return rounded(sampling.measured(x.triangles(spark, sf)).select("geom_id", "tri_no", "ux", "uy", "uz", "area"), "ux", "uy", "uz", "area")


@query("g4_walkable_triangles", f"WITH {WALK} SELECT geom_id, kind, tri_no FROM walk")
def walkable(spark, sf):
    return _walkable(spark, sf).select("geom_id", "kind", "tri_no")


@query("g7_lattice_points", f"WITH {LATTICE} SELECT geom_id, tri_no, u, v, {r('x')} AS x, {r('y')} AS y, {r('z')} AS z FROM lat")
def lattice(spark, sf):
    return rounded(sampling.lattice(_walkable(spark, sf), 1.5).select("geom_id", "tri_no", F.col("u").cast("long"), F.col("v").cast("long"), "x", "y", "z"), "x", "y", "z")


@query("g8_budgeted_points", f"""WITH {LATTICE}, nth AS (SELECT *, row_number() OVER (PARTITION BY kind, geom_id ORDER BY tri_no, u, v) AS nth FROM lat), n AS (SELECT kind, geom_id, count(*) AS n FROM lat GROUP BY ALL),
st AS (SELECT *, sum(take) OVER (ORDER BY geom_id) - take AS start FROM (SELECT *, least(n, 6) AS take FROM n WHERE kind = 'stair')), st2 AS (SELECT * FROM st WHERE start < 400), used AS (SELECT coalesce(sum(take), 0) AS used FROM st2),
fl AS (SELECT *, used + sum(take) OVER (ORDER BY geom_id) - take AS start FROM (SELECT n.*, used, least(n, greatest(5, floor((400 - used) / (SELECT count(*) FROM n WHERE kind = 'floor')))) AS take FROM n, used WHERE kind = 'floor' AND used < 400)),
q AS (SELECT kind, geom_id, take, start FROM st2 UNION ALL SELECT kind, geom_id, take, start FROM fl WHERE start < 400)
SELECT CAST(start + nth - 1 AS BIGINT) AS ordinal, nth.geom_id, kind = 'stair' AS is_stair, {r('x')} AS x, {r('y')} AS y, {r('z + 0.75')} AS z FROM nth JOIN q USING (kind, geom_id) WHERE nth <= take AND start + nth - 1 < 400""")
def budget(spark, sf):
    points = sampling.lattice(_walkable(spark, sf), 1.5).select("geom_id", "kind", "tri_no", "u", "v", "x", "y", "z")
    return rounded(sampling.budgeted(points, per_stair=6, total=400, least_share=5).withColumn("ordinal", F.col("ordinal").cast("long")), "x", "y", "z")


@query("g14_box_overlaps", f"""WITH {x.BOXES}, o AS (SELECT a.id AS a, b.id AS b, least(a.maxx, b.maxx) - greatest(a.minx, b.minx) AS ox, least(a.maxy, b.maxy) - greatest(a.miny, b.miny) AS oy
FROM (SELECT id, minx, maxx + 8 AS maxx, miny, maxy + 8 AS maxy FROM boxes) a JOIN (SELECT id, minx, maxx + 8 AS maxx, miny, maxy + 8 AS maxy FROM boxes) b ON a.id < b.id) SELECT * FROM o WHERE ox > 0 AND oy > 0""")
def overlaps(spark, sf):
    boxes = x.boxes(spark, sf).withColumns({c: F.col(c) + 8 for c in ("maxx", "maxy")})
    return geometry.overlapping(boxes, 8.0)


@query("g15_inferred_up_axis", f"WITH {x.TRI} SELECT kind, CASE WHEN max(greatest(az, bz, cz)) - min(least(az, bz, cz)) > 1.2 * (max(greatest(ay, by, cy)) - min(least(ay, by, cy))) THEN 'z' ELSE 'y' END AS up FROM tri GROUP BY kind")
def inferred(spark, sf):
    from emberway.sources.mesh import inferred_up

    return inferred_up(x.triangles(spark, sf), ["kind"])


@query("g16_turned_points", f"WITH {x.PTS} SELECT id, {r('-x')} AS x, {r('-z')} AS y, {r('y')} AS z FROM pts")
def turned(spark, sf):
    from emberway.sources.mesh import turned as turn

    return rounded(turn(x.points(spark, sf), flip_x=True).select("id", "x", "y", "z"), "x", "y", "z")


@query("g17_medial_axis", f"""WITH {x.PTS}, p AS (SELECT id % 10 AS model, x, y, z FROM pts), m AS (SELECT model, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM p GROUP BY model),
v AS (SELECT *, xy AS vx, (xx + yy) / 2 + sqrt(greatest(pow((xx + yy) / 2, 2) - (xx * yy - xy * xy), 0)) - xx AS vy FROM m), u AS (SELECT *, vx / sqrt(vx * vx + vy * vy) AS dx, vy / sqrt(vx * vx + vy * vy) AS dy FROM v),
s AS (SELECT u.model, mx, my, mz, dx, dy, min((x - mx) * dx + (y - my) * dy) AS lo, max((x - mx) * dx + (y - my) * dy) AS hi FROM p JOIN u ON u.model = p.model GROUP BY ALL)
SELECT model, {r('mx + lo * dx')} AS sx, {r('my + lo * dy')} AS sy, {r('mz + 0.1')} AS sz, {r('mx + hi * dx')} AS ex, {r('my + hi * dy')} AS ey, {r('mz + 0.1')} AS ez FROM s""")
def medial(spark, sf):
    from emberway.operators.elements import medial_axis

    p = x.points(spark, sf).select((F.col("id") % 10).alias("model"), "x", "y", "z")
    return rounded(medial_axis(p), "sx", "sy", "sz", "ex", "ey", "ez")
