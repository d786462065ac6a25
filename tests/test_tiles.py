"""Arcs that are found in tiles of points, against the same arcs as a table."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from emberway.functions.geometry import distance, half_up, squared
from emberway.operators import extensions, fire, graph, paths, tiles
from emberway.plans import catalog
from emberway.streaming import spread

R = 0.6


def drawn(spark, n=60, seed=4):
    rng = random.Random(seed)
    rows = [(i, *(rng.randrange(-16, 16) / 16 for _ in range(3)), 20.0 + rng.randrange(4) * 50) for i in range(n)] + [(n, 0.5, 0.5, 0.5, 20.0), (n + 1, 0.5, 0.5, 0.5, 90.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double, t double").localCheckpoint()
    return points.drop("t"), points.select(F.col("id").alias("node"), "t")


def found(df):
    return {r["node"]: (r["dist"], r["prev"]) for r in df.collect()}


def test_distances_and_trees_by_tiles(spark):
    points, warm = drawn(spark)
    edges = graph.radius_graph(points, R).localCheckpoint()
    cold = spark.createDataFrame([], "node long, t double")
    costs = lambda temperatures: paths.both_ways(paths.hazard_edges(edges, temperatures, 0.5)).localCheckpoint()
    end = 7
    want = found(paths.distances(costs(warm), 0))
    assert len(want) > 20 and found(paths.distances(paths.heated(points, R, warm, 0.5), 0)) == want
    got = found(paths.distances(paths.heated(points, R, warm, 0.5), 0, end=end, width=0.2))
    assert all(want[n] == v for n, v in got.items()) and (end in got) == (end in want)
    tree = paths.Tree(paths.heated(points, R, cold, 0.5), 0)
    for temperatures in (warm, cold):  # dearer, then cheaper again
        tree.change(paths.heated(points, R, temperatures, 0.5))
        assert found(tree.best) == found(paths.distances(costs(temperatures), 0))


def test_heat_by_tiles_without_stored_arcs(spark, monkeypatch):
    points, _ = drawn(spark, 40)
    arcs = graph.arcs(graph.radius_graph(points, 0.6)).localCheckpoint()
    told = lambda df: {(r["step"], r["node"]): round(r["t"], 9) for r in df.collect()}
    want = told(fire.heat(arcs, points, 0, 3))
    monkeypatch.setattr(graph, "pairs_within", None)  # pairs are not joined
    monkeypatch.setattr(tiles.Dealt.__init__, "__defaults__", (3,))  # crowded cubes come in parts
    assert told(fire.heat(graph.Within(points, 0.6), points, 0, 3)) == want and max(t for (s, n), t in want.items() if s == 2 and n) > 20


def test_links_steps_and_shown_edges_join_no_pairs(spark, monkeypatch, tmp_path):
    points, warm = drawn(spark)
    edges = graph.radius_graph(points, R).localCheckpoint()
    rows = {r["id"]: (r["x"], r["y"], r["z"]) for r in points.collect()}
    burnt = {(r["node"], r["step"]) for r in fire.ignition(graph.arcs(edges), 0, 4).collect()}
    step = graph.step_size(edges, points).first()["step"]
    shown = spark.createDataFrame([(i, i % 9, (i * 7) % 62) for i in range(40)], "edge long, src long, dst long")
    colors = sorted(tuple(r) for r in extensions.edge_colors(edges, shown, warm).collect())
    monkeypatch.setattr(graph, "pairs_within", None)
    monkeypatch.setattr(tiles.Dealt.__init__, "__defaults__", (3,))
    arcs = graph.Within(points, R)
    assert sorted(tuple(r) for r in extensions.edge_colors(arcs, shown, warm).collect()) == colors and colors
    assert graph.step_size(arcs, points).first()["step"] == step
    doors, floors = points.where("id % 4 = 0"), points.where("id % 4 > 0")
    want = set()
    for a in (i for i in rows if i % 4 == 0):
        near = sorted((math.dist(rows[a], rows[b]), b) for b in rows if b % 4)
        want |= {(a, b) for d, b in [p for p in near if p[0] <= R][:2]}
    assert {(r["src"], r["dst"]) for r in extensions.door_links(doors, floors, 2, R).collect()} == want
    stream = spread.FireStream(arcs, f"file://{tmp_path}/fire", 4)
    stream.ignite(0)
    assert {(r["node"], r["step"]) for r in stream.burn_out().collect()} == burnt


def test_pairs_of_a_graph_come_from_tiles_by_length(spark, monkeypatch):
    points, _ = drawn(spark)
    points = points.withColumn("is_stair", F.col("id") % 3 == 0).localCheckpoint()
    rows = {r["id"]: r for r in points.collect()}
    near = lambda r, same: {(a, b) for a in rows for b in rows if a < b and math.dist(rows[a][1:4], rows[b][1:4]) <= r and same(rows[a], rows[b])}
    monkeypatch.setattr(graph, "pairs_within", None)  # pairs are not joined
    got = [(r["src"], r["dst"], r["d"], r["task"]) for r in graph.radius_graph(points, R).withColumn("task", F.spark_partition_id()).collect()]
    assert len(got) == len({p[:2] for p in got}) and {p[:2] for p in got} == near(R, lambda a, b: True)
    assert all(abs(d - math.dist(rows[a][1:4], rows[b][1:4])) < 1e-9 for a, b, d, _ in got)
    tiled = sum(p[3] != q[3] or p[2] > q[2] for p, q in zip(got, got[1:]))
    assert tiled < len(got) / 4  # equal lengths of a tile lie next to each other
    monkeypatch.setattr(tiles.Dealt.__init__, "__defaults__", (3,))  # crowded cubes come in parts
    monkeypatch.setattr(tiles, "EMIT", 5)
    stair, floor = near(0.7, lambda a, b: a["is_stair"] and b["is_stair"]), near(R, lambda a, b: not (a["is_stair"] or b["is_stair"]))
    want = {("stair", *p) for p in stair} | {("floor", *p) for p in floor}
    assert {(r["kind"], r["src"], r["dst"]) for r in graph.hybrid_graph(points, 0.7, R).collect()} == want and stair and floor
    along = lambda a, b: max(u := abs(rows[a]["x"] - rows[b]["x"]), v := abs(rows[a]["y"] - rows[b]["y"])) <= 0.01 or min(u, v) <= 0.25 * max(u, v)
    straight = {(r["kind"], r["src"], r["dst"]) for r in graph.hybrid_graph(points, 0.7, R, straight=True).collect()}
    assert straight == {p for p in want if p[0] == "stair" or along(*p[1:])} and straight != want


def test_fire_over_points_is_found_in_tiles(spark, monkeypatch):
    rng = random.Random(21)
    rows = [(i, *(rng.uniform(0, 2) for _ in range(3))) for i in range(200)] + [(200, 9.0, 9.0, 9.0), (201, 1.0, 1.0, 1.0), (202, 1.0, 1.0, 1.0), (203, float("nan"), 1.0, 1.0), (204, None, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double")
    want = sorted(map(tuple, fire.ignition(graph.arcs(graph.radius_graph(points, 0.4)), 0, 6).collect()))
    monkeypatch.setattr(graph, "pairs_within", None)  # pairs were joined, by one task where their ends take little space
    monkeypatch.setattr(tiles.Dealt.__init__, "__defaults__", (3,))
    assert sorted(map(tuple, fire.ignition(graph.Within(points, 0.4), 0, 6).collect())) == want
    assert max(step for _, step in want) >= 3


def test_rounding_in_tasks_is_that_of_spark(spark):
    rng = random.Random(9)
    x = [rng.uniform(-1, 1) * 10 ** rng.randrange(-7, 14) for _ in range(3000)] + [k / 2e6 for k in range(-200, 200)] + [0.1234565, 1.0000005, 2.5e-7, -0.0, 1e300, float("inf"), float("nan")]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6) + 0.0).collect()]
    assert list(map(repr, half_up(np.array(x), 6).tolist())) == list(map(repr, want))


def test_squared_lengths_and_hazard_costs_come_from_tiles(spark, monkeypatch):
    points, warm = drawn(spark)
    warm = warm.where("node % 3 = 0").localCheckpoint()
    six = lambda df, *names: sorted(map(tuple, df.withColumns({n: F.round(n, 6) + 0.0 for n in names}).collect()))
    ends = graph.radius_graph_with_ends(points, R)
    want = six(ends.select("src", "dst", squared("a_", "b_", ("x", "y")).alias("d2_flat"), squared("a_", "b_").alias("d2")), "d2_flat", "d2")
    costs = six(paths.hazard_edges(ends.withColumn("d", distance("a_", "b_")), warm, 0.5), "length", "avg_t", "hazard", "cost")
    monkeypatch.setattr(graph, "pairs_within", None)  # pairs were joined, and came in no order
    assert sorted(map(tuple, graph.squared_lengths(points, R, 6).collect())) == want
    got = paths.hazard_radius_graph(points, R, warm, 0.5, digits=6).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(tuple(r)[:6] for r in got) == costs and len({r["avg_t"] for r in got}) > 3
    assert sum(p["task"] == q["task"] and (p["avg_t"], p["length"]) > (q["avg_t"], q["length"]) for p, q in zip(got, got[1:])) < len(got) / 4


def test_walls_meet_pairs_in_tiles(spark, monkeypatch):
    rng = random.Random(3)
    points = spark.createDataFrame([(i, rng.uniform(-2, 2), rng.uniform(-2, 2), rng.uniform(0, 1)) for i in range(150)], "id long, x double, y double, z double").localCheckpoint()
    lines = [(i, x, y, x + rng.choice([0, 1.5]), y + rng.choice([0, 0.7]), 0.2, 0.8) for i in range(12) for x, y in [(rng.uniform(-2, 1), rng.uniform(-2, 1))]]
    walls = spark.createDataFrame(lines + [(50 + i, *w) for i, *w in lines], "id long, sx double, sy double, ex double, ey double, z_min double, z_max double")
    edges = graph.radius_graph_with_ends(points, 0.4).withColumn("is_door", F.col("src") % 10 == 0)
    want = sorted(map(tuple, extensions.not_through_walls(edges, walls, 0.5).select("src", "dst", "is_door").collect()))
    n = edges.count()
    monkeypatch.setattr(graph, "pairs_within", None)  # pairs were joined, and each with its walls
    monkeypatch.setattr(tiles.Dealt.__init__, "__defaults__", (7,))
    uncut = lambda walls: sorted(map(tuple, extensions.uncut_edges(points, 0.4, walls, lambda a, b: a["id"] % 10 == 0).collect()))
    assert uncut(walls) == want and 0 < len(want) < n
    assert len(uncut(walls.where("false"))) == n


def test_exported_edges_lie_next_to_those_that_begin_alike(spark):
    rows = catalog.QUERIES["s11_contract_export"](spark, "/root/testdata/sf0.001").where("type = 'edge'").withColumn("task", F.spark_partition_id()).collect()
    heads = [(r["task"], r["uid"].split("_")[0]) for r in rows]
    assert sum(a != b for a, b in zip(heads, heads[1:])) < len(heads) / 2  # by length nearly all differed
