"""Walkable points on triangle meshes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberway.functions.geometry import AXES, area, least_up, normal

FLAT = 1e-6  #: triangles of so little area are left out


def triangles(meshes: DataFrame) -> DataFrame:
    """geom_id, kind, tri_no and corners ax to cz of meshes (geom_id, kind, vertices, indices, normals), and the given normal of each first corner.

    vertices and normals are flat arrays of coordinates. Triangles that point outside are left out,
    a normal outside is null.
    """
    tri = meshes.select("geom_id", "kind", "vertices", "normals", F.posexplode(F.transform(
        F.sequence(F.lit(0), (F.size("indices") / 3).cast("int") - 1), lambda t: F.slice("indices", t * 3 + 1, 3))).alias("tri_no", "at")).where(F.size("indices") >= 3)
    last = F.floor(F.size("vertices") / 3)  # a vertex that is cut off is outside
    tri = tri.where(F.forall("at", lambda i: (i >= 0) & (i < last)))
    corner = lambda k, j: F.get("vertices", F.col("at")[k] * 3 + j)
    given = lambda j: F.get("normals", F.col("at")[0] * 3 + j)
    return tri.select("geom_id", "kind", "tri_no", *(corner(k, j).alias(p + a) for k, p in enumerate("abc") for j, a in enumerate(AXES)), *(given(j).alias(f"n{a}") for j, a in enumerate(AXES)))


def measured(tri: DataFrame) -> DataFrame:
    """Adds the unit normal ux, uy, uz and the area; a given first-corner normal nx, ny, nz comes before the computed one."""
    n = normal()
    given = "nx" in tri.columns
    return tri.select("*", *((F.coalesce(f"n{k}", c) if given else c).alias(f"u{k}") for k, c in zip(AXES, n)), area().alias("area"))


def walkable(tri: DataFrame, slope_deg: float | Column, up: str = "z", roof: DataFrame | None = None) -> DataFrame:
    """Triangles of enough area whose normal's up component passes the slope filter; with roof (one row, `top`), none that lie wholly at top or above."""
    low = F.lit(least_up(slope_deg)) if isinstance(slope_deg, float | int) else slope_deg
    kept = measured(tri).where((F.col("area") > FLAT) & (F.col(f"u{up}") >= low))
    if roof is not None:
        kept = kept.crossJoin(F.broadcast(roof)).where(F.least(f"a{up}", f"b{up}", f"c{up}") < F.col("top")).drop("top")
    return kept


def roof_level(tri: DataFrame, up: str = "z", below: float = 1.0) -> DataFrame:
    """top: the height from which a triangle is roof, one row."""
    return tri.agg((F.max(F.greatest(f"a{up}", f"b{up}", f"c{up}")) - below).alias("top"))


def lattice(tri: DataFrame, spacing: float) -> DataFrame:
    """Adds u, v and x, y, z: points of a barycentric lattice of s steps a side, s = ceil(sqrt(area) / spacing), 1 at least.

    The third weight is 1 - u/s - v/s in doubles; a point for which it comes out below zero is left out.
    """
    steps = F.greatest(F.lit(1), F.ceil(F.sqrt("area") / F.lit(max(spacing, 1e-3)))).cast("int")
    at = tri.withColumn("s", steps).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("s"))))
    at = at.withColumn("v", F.explode(F.sequence(F.lit(0), F.col("s") - F.col("u"))))
    p, q = F.col("u") / F.col("s"), F.col("v") / F.col("s")
    at = at.withColumn("p", p).withColumn("q", q).withColumn("w", 1.0 - F.col("p") - F.col("q")).where("w >= 0")
    return at.select("*", *((F.col(f"a{k}") * F.col("w") + F.col(f"b{k}") * F.col("p") + F.col(f"c{k}") * F.col("q")).alias(k) for k in AXES)).drop("p", "q", "w")


def budgeted(points: DataFrame, per_stair: int = 300, total: int = 3000, agent_height: float = 0.75, least_share: int = 100) -> DataFrame:
    """ordinal, geom_id, is_stair, x, y, z: stairs first, within a budget, raised by the agent's height on z.

    A stair gives its first per_stair points (by triangle, u, v); stairs count while the points
    before them are below the total. What is left is shared by the floors alike, least_share each
    at least; floors too count while the points before them are below the total. The first `total`
    points stay. Only the counts of the geometries are ordered in one place, not their points.
    """
    w = W.partitionBy("kind", "geom_id").orderBy("tri_no", "u", "v")
    p = points.withColumn("nth", F.row_number().over(w))
    n = p.groupBy("kind", "geom_id").agg(F.count("*").alias("n"))
    before = W.partitionBy("kind").orderBy("geom_id").rowsBetween(W.unboundedPreceding, -1)
    stairs = n.where("kind = 'stair'").withColumn("take", F.least("n", F.lit(per_stair))).withColumn("start", F.coalesce(F.sum("take").over(before), F.lit(0))).where(F.col("start") < total)
    used = stairs.agg(F.coalesce(F.sum("take"), F.lit(0)).alias("used"))
    floors = n.where("kind = 'floor'").crossJoin(F.broadcast(used)).crossJoin(F.broadcast(n.where("kind = 'floor'").agg(F.count("*").alias("floors"))))
    share = F.greatest(F.lit(least_share), F.floor((F.lit(total) - F.col("used")) / F.col("floors")))
    floors = floors.where(F.col("used") < total).withColumn("take", F.least("n", share)).withColumn("start", F.col("used") + F.coalesce(F.sum("take").over(before), F.lit(0))).where(F.col("start") < total)
    quota = stairs.select("kind", "geom_id", "take", "start").unionByName(floors.select("kind", "geom_id", "take", "start"))
    kept = p.join(quota, ["kind", "geom_id"]).where(F.col("nth") <= F.col("take")).withColumn("ordinal", F.col("start") + F.col("nth") - 1).where(F.col("ordinal") < total)
    return kept.select("ordinal", "geom_id", (F.col("kind") == "stair").alias("is_stair"), "x", "y", (F.col("z") + agent_height).alias("z"))


def spacing_rules(requested: float, max_edge_floor: float | None = None, max_edge_stair: float | None = None) -> dict[str, float]:
    """Spacings and link lengths that follow from the spacing asked for."""
    base = max(requested, 1.5)
    return {"floor": base, "stair": max(0.3 * base, 0.3), "max_edge_floor": max_edge_floor or 1.5 * base, "max_edge_stair": max_edge_stair or 0.4}


def spacings(requests: DataFrame) -> DataFrame:
    """Adds to requests (requested, max_edge_floor, max_edge_stair; null or 0: by rule) the columns of `spacing_rules`: floor, stair and both link lengths."""
    base = F.greatest(F.col("requested"), F.lit(1.5))
    asked = lambda name, rule: F.coalesce(F.when(F.col(name) != 0, F.col(name)), rule)
    return requests.withColumns({"floor": base, "stair": F.greatest(base * 0.3, F.lit(0.3)), "max_edge_floor": asked("max_edge_floor", base * 1.5), "max_edge_stair": asked("max_edge_stair", F.lit(0.4))})
