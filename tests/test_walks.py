import pytest

import __spark_entry__
from emberway.operators import paths


def test_whole_walk_matches_its_sql(spark):
    """At 10,000 events most of the walk lies beyond event 1,000."""
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("lineitem", "events"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = sorted(map(tuple, __spark_entry__.queries()["p8_path_edges"](spark, sf).select("pos", "edge").collect()))
    assert found == sorted(c.sql(__spark_entry__.oracle_sql()["p8_path_edges"]).fetchall())
    assert found[-1][0] > 9000


def test_a_walk_does_not_go_through_one_task(spark):
    nodes = [i * 7 % 100 for i in range(2000)]
    walk = spark.createDataFrame(list(enumerate(nodes)), "pos long, node long").repartition(5)
    keys = spark.createDataFrame([("0|7", 1), ("14|7", 2), ("0|93", 3)], "key string, edge long")
    out = paths.path_edges(walk, keys)
    known = {"0|7": 1, "14|7": 2, "0|93": 3}
    steps = ((i, "|".join(sorted(map(str, p)))) for i, p in enumerate(zip(nodes, nodes[1:])))
    assert sorted(map(tuple, out.collect())) == [(i, known[k]) for i, k in steps if k in known]
    assert "SinglePartition" not in out._jdf.queryExecution().toString()


def test_arcs_found_from_points_are_those_of_the_graph(spark, monkeypatch):
    """Fire, burning edges and heat on a radius graph that is not stored, against the same on its arcs; and no row of a pair is written."""
    import random

    from pyspark.sql import functions as F

    from emberway.operators import fire, graph, learning
    from emberway.plans.sessions import GraphSession

    rng = random.Random(8)
    rows = [(i, rng.uniform(0, 3), rng.uniform(0, 1), rng.uniform(0, 1)) for i in range(150)] + [(150, 9.0, 9.0, 9.0), (151, 0.5, 0.5, 0.5), (152, 0.5, 0.5, 0.5)]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double")
    edges = graph.radius_graph(points, 0.5)
    arcs, near = graph.arcs(edges), graph.Within(points, 0.5)
    got = lambda df: sorted(map(tuple, df.collect()))
    pairs = got(near.met(points.select(F.col("id").alias("src"))).select("src", "dst"))
    assert pairs == got(arcs)
    most, counted = [], fire.cut_counted
    monkeypatch.setattr(fire, "cut_counted", lambda df: (lambda out: most.append(out[1]["n"]) or out)(counted(df)))
    levels = fire.ignition(near, 0, 8)
    assert got(levels) == got(fire.ignition(arcs, 0, 8, both_ways=True)) and max(s for _, s in got(levels)) >= 4
    assert max(most) <= len(rows)
    burning = levels.where("step <= 2").select("node")
    assert got(fire.burning_edges(near, burning)) == got(fire.burning_edges(edges, burning).select("src", "dst"))
    heat = lambda a: [(s, n, round(t, 9)) for s, n, t in got(fire.heat(a, points, 0, 4))]
    assert heat(near) == heat(arcs)
    assert got(learning.values(near, 7, 3)) == got(learning.values(arcs, 7, 3))
    session = GraphSession(spark, "near")
    session.register("stored", points, edges)
    session.register("found", points, edges, radius=0.5)
    assert got(session.fire("found", 0, radial=False, max_steps=3)) == got(session.fire("stored", 0, radial=False, max_steps=3))


def test_walls_cut_short_edges_in_one_pass(spark):
    """With a bound on lengths the same edges stay, and edges are not shuffled."""
    import random

    from pyspark.sql import functions as F

    from emberway.operators import extensions, graph

    rng = random.Random(3)
    points = spark.createDataFrame([(i, rng.uniform(-2, 2), rng.uniform(-2, 2), rng.uniform(0, 1)) for i in range(150)], "id long, x double, y double, z double")
    lines = [(i, x, y, x + rng.choice([0, 1.5]), y + rng.choice([0, 0.7]), 0.2, 0.8) for i in range(12) for x, y in [(rng.uniform(-2, 1), rng.uniform(-2, 1))]]
    walls = spark.createDataFrame(lines + [(50 + i, *w) for i, *w in lines], "id long, sx double, sy double, ex double, ey double, z_min double, z_max double")
    edges = graph.radius_graph_with_ends(points, 0.4).withColumn("is_door", F.col("src") % 10 == 0)
    got = lambda df: sorted(map(tuple, df.select("src", "dst", "is_door").collect()))
    short = extensions.not_through_walls(edges, walls, 0.5, longest=0.4)
    assert got(short) == got(extensions.not_through_walls(edges, walls, 0.5)) and 0 < short.count() < edges.count()
    plan = short._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("SortMergeJoin") <= 1
    temperatures = spark.createDataFrame([(i, 20.0 + 9 * i) for i in range(0, 150, 3)], "node long, t double")
    from emberway.operators import paths

    hazard = lambda df: sorted(map(tuple, df.select("src", "dst", "length", "avg_t", "hazard", "cost").collect()))
    assert hazard(paths.hazard_radius_graph(points, 0.4, temperatures, 0.5)) == hazard(paths.hazard_edges(graph.radius_graph(points, 0.4), temperatures, 0.5))
