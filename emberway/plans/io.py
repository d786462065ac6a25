"""Queries on sources, sinks and the event stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from emberway.operators import graph
from emberway.plans import fires
from emberway.plans import fixtures as x
from emberway.plans._registry import query, r, rounded, table
from emberway.plans.fixpoint import shared_folder
from emberway.sources import contract, lines, mesh
from emberway.streaming import events


@query("s1_health", "SELECT CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END AS status, count(*) AS nodes FROM embeddings")
def health(spark, sf):
    n = F.count("*")
    return table(spark, sf, "embeddings").agg(F.when(n > 0, "ok").otherwise("empty").alias("status"), n.alias("nodes"))


@query("s2_dictionaries", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events WHERE props->>'k' IS NOT NULL")
def dictionaries(spark, sf):
    k = F.variant_get(F.parse_json("props"), "$.k", "bigint")
    return table(spark, sf, "events").select("event_id", k.alias("k")).where("k is not null")


@query("s4_payload_kinds", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'contract' WHEN 1 THEN 'export' WHEN 2 THEN 'list' WHEN 3 THEN 'other' ELSE 'broken' END AS kind FROM events")
def kinds(spark, sf):
    texts = F.array(F.lit('{"vertices": [], "faces": []}'), F.lit('{"export_version": 1, "main_tree": {}}'), F.concat(F.lit(" ["), F.col("props"), F.lit("]")), F.col("props"), F.concat(F.lit("{"), F.col("props")))
    return table(spark, sf, "events").select("event_id", contract.payload_kind(F.element_at(texts, (F.col("event_id") % 5 + 1).cast("int"))).alias("kind"))


@query("s8_merged_parts", "SELECT geom_id, part, CAST(base AS BIGINT) AS base, CAST(base AS BIGINT) + 2 AS last_index FROM (SELECT l_orderkey AS geom_id, row_number() OVER w AS part, coalesce(sum(3 + l_quantity % 5) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate))")
def parts(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("geom_id"), F.row_number().over(w).cast("long").alias("part"), (3 + F.col("l_quantity") % 5).cast("long").alias("n_vertices"), F.array(*(F.lit(i).cast("long") for i in range(3))).alias("indices"))
    return mesh.merged_parts(rows).select("geom_id", "part", "base", F.array_max("indices").alias("last_index"))


@query("s9_ids_by_class", "SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'slabs' WHEN 1 THEN 'stairs' ELSE 'doors' END AS category, p_size AS express_id FROM part")
def classes(spark, sf):
    kind = F.element_at(F.array(F.lit("IfcSlab"), F.lit("IfcStairFlight"), F.lit("IfcDoor")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return mesh.ids_by_class(table(spark, sf, "part").select(F.col("p_size").alias("express_id"), kind.alias("ifc_type")))


@query("s10_payload", "SELECT vec_id AS geom_id FROM embeddings WHERE vec_id % 4 = 1 AND len(embedding) > 0")
def payload(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("geom_id"), F.when(F.col("vec_id") % 4 == 1, F.col("embedding")).otherwise(F.slice("embedding", 1, 0)).alias("vertices"))
    return mesh.payload(rows.select("geom_id"), rows).select("geom_id")


@query("s11_contract_export", f"WITH {x.EDGES} SELECT 'edge' AS type, 'e' || src || '_' || dst AS uid FROM edges UNION ALL SELECT 'vertex', 'v' || id FROM pts")
def export(spark, sf):
    by_ends = graph.radius_graph(x.points(spark, sf), x.RADIUS, by=("src", "dst"))  # ids that begin alike lie next to each other, in less space
    e = by_ends.select(F.lit("edge").alias("type"), F.concat(F.lit("e"), "src", F.lit("_"), "dst").alias("uid"))
    return e.unionByName(x.points(spark, sf).select(F.lit("vertex").alias("type"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("uid")))


@query("s13_sse_lines", "SELECT event_id, 'data: ' || '{\"step\":' || event_id || ',\"type\":\"' || event_type || '\"}' || chr(10) || chr(10) AS line FROM events")
def sse(spark, sf):
    body = F.to_json(F.struct(F.col("event_id").alias("step"), F.col("event_type").alias("type")))
    return table(spark, sf, "events").select("event_id", events.sse_line(body).alias("line"))


@query("s12_lines_sink", f"WITH {x.PTS} SELECT id, {r('x')} AS x FROM pts")
def lines_sink(spark, sf):
    path = f"{shared_folder(spark)}/emberway/lines-{uuid.uuid4().hex}"
    rows = rounded(x.points(spark, sf).select("id", "x"), "x")
    lines.write_lines(rows.select(F.to_json(F.struct("id", "x")).alias("value")), path)
    return lines.read_lines(spark, path).select(F.from_json("value", "id long, x double").alias("v")).select("v.*")


@query("s13_event_sink", "SELECT event_id, 'data: ' || '{\"step\":' || event_id || ',\"type\":\"' || event_type || '\"}' || chr(10) || chr(10) AS line FROM events")
def event_sink(spark, sf):
    """The lines of a stream of events, through the sink and back."""
    path = f"{shared_folder(spark)}/emberway/events-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    body = F.to_json(F.struct(F.col("event_id").alias("step"), F.col("event_type").alias("type")))
    lines.stream_lines(stream.select(events.sse_line(body).alias("value")), f"{path}/lines", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    told = lines.read_lines(spark, f"{path}/lines").withColumnRenamed("value", "line")
    return told.select(F.get_json_object(F.substring("line", 7, 1 << 20), "$.step").cast("long").alias("event_id"), "line")


@query("s15_sample_summary", "SELECT CAST(count(*) AS INTEGER) AS num_vertices, CAST(count(*) FILTER (n_regionkey = 0) AS INTEGER) AS num_faces, count(*) FILTER (n_regionkey = 0) AS n_ids FROM nation")
def sample(spark, sf):
    n = table(spark, sf, "nation")
    v = n.agg(F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("id"))).alias("vertices"), F.collect_list(F.when(F.col("n_regionkey") == 0, F.struct(F.col("n_nationkey").cast("string").alias("id")))).alias("faces"))
    return contract.sample_summary(v).select("num_vertices", "num_faces", F.size("face_ids").cast("long").alias("n_ids"))


@query("s16_client_summary", "SELECT (SELECT count(*) FROM customer) AS vertices, (SELECT count(*) FROM orders) AS edges, (SELECT count(*) FROM part) AS faces")
def client(spark, sf):
    return contract.summary(*(table(spark, sf, t) for t in ("customer", "orders", "part")))


@query("s17_last_by_uid", "SELECT CAST(o_custkey AS VARCHAR) AS key, max(o_orderkey) AS pos FROM orders GROUP BY 1")
def last(spark, sf):
    k = F.col("o_custkey").cast("string")
    even = F.col("o_custkey") % 2 == 0
    raw = table(spark, sf, "orders").select(F.when(even, k).alias("uid"), F.when(~even, k).alias("uuid"), F.col("o_orderkey").alias("pos"))
    return contract.last_by_uid(raw, "pos").select("key", "pos")


@query("s18_edge_fallback", "SELECT 'e' || l_orderkey || '.' || l_linenumber AS uid, CAST(2 AS INTEGER) AS n FROM lineitem WHERE l_returnflag = 'R'")
def fallback(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.concat(F.lit("e"), "l_orderkey", F.lit("."), "l_linenumber").alias("uid"), F.when(F.col("l_returnflag") == "R", "Edge").otherwise("Face").alias("type"), F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("vertices"))
    return contract.edge_source(rows.where("false"), rows).select("uid", F.size("vertices").alias("n"))


PART = 120  #: nodes an event tells, so that a step has several
_FIELD_ROWS = " UNION ALL ".join(f"SELECT {s} AS step, node, {r('t')} AS t FROM t{s}" for s in range(x.FIELD_STEPS + 1))


@query("e1_event_table", f"""WITH {fires.FIELD}, told AS (SELECT *, (row_number() OVER (PARTITION BY step ORDER BY node) - 1) // {PART} AS part, (count(*) OVER (PARTITION BY step) + {PART} - 1) // {PART} AS parts FROM ({_FIELD_ROWS})),
events AS (SELECT step, 1 AS rank, part, 'temperature_step' AS type, '{{"step":' || step || ',"part":' || part || ',"parts":' || parts || ',"temperatures":{{' || string_agg('"' || node || '":' || CAST(t AS VARCHAR), ',' ORDER BY node) || '}}}}' AS payload FROM told GROUP BY step, part, parts
UNION ALL SELECT 2147483647, 3, 0, 'done', '{{}}')
SELECT row_number() OVER (ORDER BY step, rank, part) - 1 AS seq, CAST(step AS INTEGER) AS step, rank, CAST(part AS BIGINT) AS part, type, payload FROM events""")
def event_table(spark, sf):
    field = fires._field(spark, sf)
    return events.event_table(rounded(field, "t"), chunk=PART)


@query("e5_dispatched_events", f"SELECT event_id AS step, {r('value')} AS value FROM events WHERE event_type = 'click'")
def dispatch(spark, sf):
    lines = table(spark, sf, "events").select(F.to_json(F.struct(F.col("event_type").alias("type"), F.col("event_id").alias("step"), "value")).alias("value"))
    broken = lines.limit(1).select(F.lit("{not json").alias("value"))
    return rounded(events.dispatched(lines.unionByName(broken), "click", "step long, value double"), "value")
