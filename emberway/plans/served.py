"""Queries on what a session of graphs and the rules of requests give."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from emberway.operators import graph, sampling
from emberway.plans import fires, graphs
from emberway.plans import fixtures as x
from emberway.plans._registry import query, r, rounded, table
from emberway.plans.fixpoint import cut
from emberway.plans.sessions import GraphSession
from emberway.streaming import events


def _session(spark, sf) -> GraphSession:
    """The radius graph as `ifc`, the cell graph as `cell` with its cells' bounds."""
    session = GraphSession(spark, f"s{uuid.uuid4().hex}")
    cells = cut(graph.numbered(graph.gaps_filled(graph.snapped(x.points(spark, sf), graphs.CELL), graphs.GAP)))
    nodes = cells.select("id", *((F.col(f"i{k}") * graphs.CELL).alias(k) for k in "xyz"))
    boxes = nodes.select("id", *((F.col(k) + s * graphs.CELL / 2).alias(f"{name}{k}") for k in "xyz" for name, s in (("min", -1), ("max", 1))))
    session.register("cell", nodes, graph.grid_links(cells).withColumn("d", F.lit(graphs.CELL)), boxes)
    session.register("ifc", x.points(spark, sf), x.edges(spark, sf), radius=x.RADIUS)
    return session


@query("c16_registered_graphs", f"WITH {graphs.NUMBERED}, {x.EDGES.partition(', edges')[1].lstrip(', ')}{x.EDGES.partition(', edges')[2]}, links AS (SELECT a.id FROM numbered a JOIN numbered b ON abs(a.ix - b.ix) + abs(a.iy - b.iy) + abs(a.iz - b.iz) = 1 AND a.id < b.id) SELECT 'ifc' AS graph, (SELECT count(*) FROM pts) AS nodes, (SELECT count(*) FROM edges) AS edges UNION ALL SELECT 'cell', (SELECT count(*) FROM numbered), (SELECT count(*) FROM links)")
def registered(spark, sf):
    session = _session(spark, sf)
    size = lambda k: session.nodes(k).agg(F.lit(k).alias("graph"), F.count("*").alias("nodes")).crossJoin(session.edges(k).agg(F.count("*").alias("edges")))
    return size("ifc").unionByName(size("cell"))


_BOX = ", ".join(f"{r(f'i{k} * {graphs.CELL}::DOUBLE {s} {graphs.CELL / 2}')} AS {name}{k}" for k in "xyz" for name, s in (("min", "-"), ("max", "+")))


@query("s14_cell_bounds", f"WITH {graphs.NUMBERED} SELECT id, {_BOX} FROM numbered")
def cell_bounds(spark, sf):
    return rounded(_session(spark, sf).cells("cell"), *(f"{name}{k}" for k in "xyz" for name in ("min", "max")))


@query("f5_session_fire", f"WITH RECURSIVE {fires.BFS} SELECT CAST(step AS INTEGER) AS step, node FROM levels")
def session_fire(spark, sf):
    return _session(spark, sf).fire("ifc", fires.SOURCE, radial=False, max_steps=fires.MAX_STEPS).select("step", F.explode("nodes").alias("node"))


@query("f5_session_radial", f"""WITH {x.EDGES}, unit AS (SELECT min(CASE WHEN d > 0 THEN d END) AS step FROM edges), {fires._ORIGIN}, last AS (SELECT least(ceil(max(d) / step), 59) AS last FROM d, unit GROUP BY step)
SELECT CAST(floor(d / step) AS INTEGER) AS step, id AS node FROM d, unit, last WHERE floor(d / step) <= last""")
def session_radial(spark, sf):
    return _session(spark, sf).fire("ifc", fires.SOURCE).select("step", F.explode("nodes").alias("node"))


@query("e4_routed_requests", "SELECT event_id, coalesce(event_id % 2 = 0 AND value > 20 AND CASE WHEN event_id % 3 = 0 THEN 'ifc' ELSE 'wire' END = 'ifc' AND props->>'k' <> '' AND CASE WHEN user_id % 5 > 0 THEN CAST(user_id AS VARCHAR) ELSE '' END <> '', false) AS routed FROM events")
def routed(spark, sf):
    e, mode = F.col("event_id"), F.when(F.col("event_id") % 3 == 0, "ifc").otherwise("wire")
    end = F.when(F.col("user_id") % 5 > 0, F.col("user_id").cast("string")).otherwise("")
    return table(spark, sf, "events").select("event_id", events.routed(e % 2 == 0, F.col("value") > 20, mode, F.get_json_object("props", "$.k"), end).alias("routed"))


@query("g9_spacing_rules", f"WITH q AS (SELECT p_partkey, p_size / 10::DOUBLE AS requested, CASE p_partkey % 3 WHEN 0 THEN p_size / 4::DOUBLE WHEN 1 THEN 0.0 END AS f, CASE WHEN p_partkey % 4 = 0 THEN 0.7 END AS s FROM part) SELECT p_partkey, {r('greatest(requested, 1.5)')} AS floor, {r('greatest(0.3 * greatest(requested, 1.5), 0.3)')} AS stair, {r('coalesce(nullif(f, 0), 1.5 * greatest(requested, 1.5))')} AS max_edge_floor, {r('coalesce(s, 0.4)')} AS max_edge_stair FROM q")
def spacing(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    asked = table(spark, sf, "part").select("p_partkey", (size / 10).alias("requested"), F.when(k % 3 == 0, size / 4).when(k % 3 == 1, 0.0).alias("max_edge_floor"), F.when(k % 4 == 0, 0.7).alias("max_edge_stair"))
    return rounded(sampling.spacings(asked).drop("requested"), "floor", "stair", "max_edge_floor", "max_edge_stair")


@query("c11_grid_parameters", f"WITH q AS (SELECT p_partkey, p_size / 8::DOUBLE AS base, CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 16 + 1) / 16::DOUBLE END AS c FROM part) SELECT p_partkey, {r('coalesce(c, base)')} AS cell, {r('least(coalesce(c, base), 0.15)')} AS v_cell, CAST(greatest(2, ceil(base / coalesce(c, base)) + 1) AS BIGINT) AS max_gap FROM q")
def grid(spark, sf):
    k = F.col("p_partkey")
    asked = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 8).alias("base"), F.when(k % 3 > 0, (k % 16 + 1) / 16).alias("cell"))
    return rounded(graph.grid_columns(asked).drop("base"), "cell", "v_cell")


@query("s7_mesh_triangles", f"""WITH m AS (SELECT vec_id AS geom_id, embedding[1:63] AS v, t, [t, t + 1, t + 2 + (vec_id % 5) * 5] AS c FROM embeddings, range(10) g(t) WHERE len(embedding) >= 63)
SELECT geom_id, CAST(t AS INTEGER) AS tri_no, {", ".join(f"{r(f'v[c[{k + 1}] * 3 + {j + 1}]')} AS {p}{a}" for k, p in enumerate("abc") for j, a in enumerate("xyz"))}, {", ".join(f"{r(f'CASE WHEN geom_id % 2 = 0 THEN v[64 - c[1] * 3 - {j + 1}] END')} AS n{a}" for j, a in enumerate("xyz"))} FROM m WHERE c[3] < 21""")
def mesh_triangles(spark, sf):
    """A mesh an embedding: 21 vertices, ten triangles, some of whose corners lie outside; every second mesh has normals."""
    t = F.sequence(F.lit(0), F.lit(9))
    corners = F.flatten(F.transform(t, lambda i: F.array(i, i + 1, i + 2 + (F.col("vec_id") % 5).cast("int") * 5)))
    rows = table(spark, sf, "embeddings").where("size(embedding) >= 63").withColumn("v", F.slice("embedding", 1, 63).cast("array<double>"))
    meshes = rows.select(F.col("vec_id").alias("geom_id"), F.lit("floor").alias("kind"), F.col("v").alias("vertices"), corners.alias("indices"), F.when(F.col("vec_id") % 2 == 0, F.reverse("v")).alias("normals"))
    names = [c for c in sampling.triangles(meshes).columns if c not in ("geom_id", "kind", "tri_no")]
    return rounded(sampling.triangles(meshes).drop("kind"), *names)
