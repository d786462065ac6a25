"""The viewer's JSON contract: vertices, edges, faces and raw records, read, told apart and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERTEX = "type string, uid string, uuid string, coordinates array<double>, Coordinates array<double>, dictionary map<string,string>"
CONTRACT = (
    "vertices array<struct<type:string,uid:string,uuid:string,coordinates:array<double>,dictionary:map<string,string>>>, "
    "edges array<struct<type:string,uid:string,uuid:string,vertices:array<string>,dictionary:map<string,string>>>, "
    "faces array<struct<type:string,uid:string,uuid:string,triangles:array<array<array<double>>>,dictionary:map<string,string>>>, "
    "raw array<struct<type:string,uid:string,uuid:string,vertices:array<string>,ifc_guid:string,ifc_name:string,ifc_type:string>>"
)
SAMPLE = "vertices array<struct<id:string,x:double,y:double,z:double,data:map<string,string>>>, faces array<struct<id:string,vertex_ids:array<string>,data:map<string,string>>>"


class BadPayload(ValueError):
    """A payload that is refused; status as an HTTP service would give it."""

    def __init__(self, status: int, reason: str):
        super().__init__(reason)
        self.status = status


def payload_kind(text: Column) -> Column:
    """`contract` (an object with vertices and faces), `list`, `export` (refused), `other` (refused) or `broken` (no JSON)."""
    keys = F.json_object_keys(text)
    has = lambda k: F.array_contains(keys, k)
    parsed = F.try_parse_json(text)
    return (
        F.when(text.isNull() | parsed.isNull(), "broken").when(has("vertices") & has("faces"), "contract").when(has("export_version") & has("main_tree"), "export")
        .when(F.startswith(F.trim(text), F.lit("[")), "list").otherwise("other")
    )


def read_contract(spark: SparkSession, path: str) -> DataFrame:
    """One row a file of contracts, with its four collections; refuses files of any other kind (status 400, or 422 where they are no JSON)."""
    files = spark.read.text(path, wholetext=True)
    bad = files.select(payload_kind(F.col("value")).alias("kind")).where("kind <> 'contract'").head(1)
    if bad:
        raise BadPayload(422 if bad[0]["kind"] == "broken" else 400, f"a payload is {bad[0]['kind']}")
    return files.select(F.from_json("value", CONTRACT).alias("c")).select("c.*")


def read_topologies(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of files that hold a JSON list: type, uid (or uuid) and its dictionary."""
    schema = "type string, uid string, uuid string, coordinates array<double>, vertices array<string>, dictionary map<string,string>"
    rows = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    return rows.withColumn("uid", F.coalesce("uid", "uuid"))


def vertex_coordinates(vertices: DataFrame, other: str | None = None) -> DataFrame:
    """id, x, y, z: uid or uuid, and the first three of at least three coordinates under either name."""
    at = F.coalesce("coordinates", other) if other else F.col("coordinates")
    rows = vertices.select(F.coalesce("uid", "uuid").alias("id"), at.alias("at")).where("id is not null and size(at) >= 3")
    return rows.select("id", *(F.col("at")[i].alias(k) for i, k in enumerate("xyz")))


def last_by_uid(raw: DataFrame, order: str) -> DataFrame:
    """The last record, by an order column, of each uid (or uuid)."""
    value = F.struct(*raw.columns)
    return raw.groupBy(F.coalesce("uid", "uuid").alias("key")).agg(F.max_by(value, order).alias("r")).select("key", "r.*")


def edge_source(edges: DataFrame, raw: DataFrame) -> DataFrame:
    """uid, vertices of the edges; if there are none, of raw records of type Edge that have vertices."""
    some = edges.agg((F.count("*") > 0).alias("some"))
    spare = raw.where("type = 'Edge' and size(vertices) > 0").select("uid", "vertices").crossJoin(F.broadcast(some)).where("not some").drop("some")
    return edges.select("uid", "vertices").unionByName(spare)


def summary(vertices: DataFrame, edges: DataFrame, faces: DataFrame) -> DataFrame:
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(vertices, "vertices").crossJoin(count(edges, "edges")).crossJoin(count(faces, "faces"))


def sample_summary(sample: DataFrame) -> DataFrame:
    """num_vertices, num_faces, face_ids of each sample topology (SAMPLE); missing collections are empty."""
    return sample.select(F.greatest(F.size("vertices"), F.lit(0)).alias("num_vertices"), F.greatest(F.size("faces"), F.lit(0)).alias("num_faces"), F.coalesce(F.col("faces.id"), F.array().cast("array<string>")).alias("face_ids"))


def write_contract(tables: dict[str, DataFrame], path: str) -> None:
    """Writes each collection as JSON lines under path; collections stay distributed."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")
