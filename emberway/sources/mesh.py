"""Mesh payloads: parts merged into one mesh, ids by class, axes turned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberway.sources.contract import BadPayload

# The classes of products that a building model's ids are collected from.
CATEGORIES = {
    "slabs": ("IFCSLAB", "IFCSLABSTANDARDCASE", "IFCSLABELEMENTEDCASE"),
    "stairs": ("IFCSTAIR", "IFCSTAIRFLIGHT"),
    "coverings": ("IFCCOVERING",),
    "doors": ("IFCDOOR",),
    "spaces": ("IFCSPACE",),
    "walls": ("IFCWALL",),
    "storeys": ("IFCBUILDINGSTOREY",),
}
NORMAL_SCALE = 32767.0  #: of normals that come as 16-bit integers


def merged_parts(parts: DataFrame) -> DataFrame:
    """geom_id, part, base and the part's indices moved by base: parts (geom_id, part, n_vertices, indices) as of one mesh.

    base is the number of vertices of a geometry's parts before this one.
    """
    before = F.sum("n_vertices").over(W.partitionBy("geom_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    rows = parts.withColumn("base", F.coalesce(before, F.lit(0)))
    return rows.select("geom_id", "part", "base", F.transform("indices", lambda i: i + F.col("base")).alias("indices"))


def placed(points: DataFrame, matrix: list[float]) -> DataFrame:
    """Points (x, y, z) under a 4 x 4 matrix of 16 numbers, column after column."""
    m = matrix
    to = lambda r: F.col("x") * m[r] + F.col("y") * m[4 + r] + F.col("z") * m[8 + r] + m[12 + r]
    return points.withColumns({"x": to(0), "y": to(1), "z": to(2)})


def ids_by_class(products: DataFrame) -> DataFrame:
    """category, express_id, each once: products (express_id, ifc_type) of the classes in CATEGORIES."""
    pairs = [F.struct(F.lit(c).alias("category"), F.lit(t).alias("ifc_type")) for c, ts in CATEGORIES.items() for t in ts]
    classes = products.sparkSession.range(1).select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    return products.withColumn("ifc_type", F.upper("ifc_type")).join(F.broadcast(classes), "ifc_type").select("category", "express_id").distinct()


def payload(ids: DataFrame, meshes: DataFrame) -> DataFrame:
    """Meshes (geom_id, vertices) of the ids that have vertices; refuses an empty payload."""
    rows = ids.join(meshes, "geom_id").where(F.size("vertices") > 0)
    return rows


def required(rows: DataFrame) -> DataFrame:
    if not rows.head(1):
        raise BadPayload(400, "no geometry")
    return rows


def check_upload(name: str, size: int) -> None:
    """What an upload of a building model must be; a model's own format takes a tessellator that is not part of this library."""
    if not name.lower().endswith(".ifc"):
        raise BadPayload(400, "not an .ifc file")
    if size <= 0:
        raise BadPayload(400, "an empty file")


def inferred_up(tri: DataFrame, by: list[str], asked: str | None = None) -> DataFrame:
    """by, up: y or z as asked for; else z where a model is more than 1.2 times as high on z as on y, else y."""
    if asked in ("y", "z"):
        return tri.select(*by).distinct().withColumn("up", F.lit(asked))
    span = lambda k: F.max(F.greatest(f"a{k}", f"b{k}", f"c{k}")) - F.min(F.least(f"a{k}", f"b{k}", f"c{k}"))
    return tri.groupBy(*by).agg(F.when(span("z") > 1.2 * span("y"), "z").otherwise("y").alias("up"))


def turned(points: DataFrame, flip_x: bool = False, flip_y: bool = False, flip_z: bool = False) -> DataFrame:
    """Points mirrored on some axes, then turned by 90 degrees about x: (x, y, z) becomes (x, -z, y)."""
    x, y, z = (-F.col(k) if f else F.col(k) for k, f in zip("xyz", (flip_x, flip_y, flip_z)))
    return points.withColumns({"x": x, "y": -z, "z": y})
