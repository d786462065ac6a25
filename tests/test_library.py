import math

import pytest
from pyspark.sql import functions as F

from emberway.functions import geometry, styles
from emberway.operators import containment, elements, extensions, fire, graph, nearest, paths, sampling
from emberway.plans.sessions import GraphSession
from emberway.sources import contract, mesh
from emberway.streaming import events

TAIL = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 1.0)]


def arcs(spark, rows=TAIL):
    return spark.createDataFrame(rows, "src long, dst long, cost double")


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*(names or df.columns)).collect())


def right_triangle(spark, side):
    cols = "geom_id long, kind string, tri_no int, " + ", ".join(f"{p}{k} double" for p in "abc" for k in "xyz")
    return spark.createDataFrame([(1, "floor", 0, 0.0, 0.0, 0.0, side, 0.0, 0.0, 0.0, side, 0.0)], cols)


@pytest.mark.parametrize(("s", "n"), [(4, 15), (5, 20), (6, 27), (7, 36), (10, 64)])
def test_lattice_loses_points_to_rounding(spark, s, n):
    tri = sampling.measured(right_triangle(spark, math.sqrt(2.0) * s))
    assert sampling.lattice(tri, 1.0000001).count() == n


def test_slope_filter_takes_sine_of_the_angle(spark):
    assert geometry.least_up(10) == pytest.approx(math.sin(math.radians(10)))
    assert sampling.walkable(right_triangle(spark, 2.0), 10.0).count() == 1
    assert sampling.walkable(right_triangle(spark, 1e-4), 10.0).count() == 0


def test_triangles_of_a_mesh(spark):
    m = spark.createDataFrame([(1, "floor", [0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0], [0, 1, 2, 0, 1, 9], [0.0, 0.0, -1.0])], "geom_id long, kind string, vertices array<double>, indices array<int>, normals array<double>")
    (tri,) = sampling.measured(sampling.triangles(m)).collect()
    assert (tri["uz"], tri["area"]) == (-1.0, 0.5)


def test_budget_stairs_overshoot_and_floors_get_nothing(spark):
    pts = [(k, g, 0, u, 0, 0.0, 0.0, 0.0) for k, g in (("stair", 1), ("stair", 2), ("floor", 3)) for u in range(5)]
    p = spark.createDataFrame(pts, "kind string, geom_id long, tri_no int, u int, v int, x double, y double, z double")
    out = sampling.budgeted(p, per_stair=4, total=6).collect()
    assert sorted(r["ordinal"] for r in out) == list(range(6)) and all(r["is_stair"] and r["z"] == 0.75 for r in out)
    assert sampling.budgeted(p, per_stair=2, total=9, least_share=2).where("not is_stair").count() == 5
    assert sampling.spacing_rules(0.5) == {"floor": 1.5, "stair": 0.3 * 1.5, "max_edge_floor": 2.25, "max_edge_stair": 0.4}


def test_rounding():
    assert graph.grid_parameters(1.5, 0.3) == {"cell": 0.3, "v_cell": 0.15, "max_gap": 6}
    assert graph.grid_parameters(1.5)["max_gap"] == 2


def test_round_half_even_and_truncation(spark):
    r = spark.sql("select array(0.5d, 1.5d, 2.5d, -0.7d) v").select(F.transform("v", geometry.round_half_even).alias("r"), geometry.truncated(F.col("v")[3]).alias("t")).first()
    assert r["r"][:3] == [0.0, 2.0, 2.0] and r["t"] == 0


def test_distances_paths_and_ties(spark):
    tree = paths.distances(arcs(spark), 1)
    assert rows(tree, "node", "dist") == [(1, 0.0), (2, 1.0), (3, 2.0), (4, 3.0)]
    assert rows(paths.path_to(tree, 4)) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert rows(paths.path_to(tree, 1)) == [(0, 1)] and rows(paths.path_to(tree, 9)) == []
    tie = arcs(spark, [(1, 5, 1.0), (1, 2, 1.0), (5, 9, 1.0), (2, 9, 1.0)])
    assert dict(rows(paths.distances(tie, 1), "node", "dist"))[9] == 2.0 and rows(paths.path_to(paths.distances(tie, 1), 9))[1] == (1, 2)


def test_long_path(spark):
    chain = arcs(spark, [(i, i + 1, 1.0) for i in range(12)])
    assert rows(paths.path_to(paths.distances(chain, 0), 12)) == [(i, i) for i in range(13)]


def test_hazard_costs(spark):
    e = spark.createDataFrame([(1, 2, 2.0), (2, 3, 1.0)], "src long, dst long, d double")
    t = spark.createDataFrame([(1, 120.0), (2, 70.0)], "node long, t double")
    out = paths.hazard_edges(e, t, 0.5)
    assert rows(out, "src", "avg_t", "cost") == [(1, 95.0, pytest.approx(2.75)), (2, 45.0, pytest.approx(1.125))]
    assert paths.survivable(out, 90.0).count() == 1 and paths.survivable(out, 0).count() == paths.survivable(out, None).count() == 2
    assert rows(paths.hazard_edges(e, t, 0.0), "cost") == [(1.0,), (2.0,)]


def test_recompute_gate():
    assert paths.recompute_steps(15, 5) == [4, 9, 14] and paths.recompute_steps(3, 1) == [0, 1, 2]


def test_dynamic_routes_fall_back(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 4, 2.0), (4, 3, 2.0)], "src long, dst long, d double")
    t = spark.createDataFrame([(0, 2, 300.0), (1, 2, 300.0), (1, 4, 300.0)], "step int, node long, t double")
    out = paths.changed_routes(paths.dynamic_routes(e, t, 1, 3, [0, 1], 0.5, 100.0))
    assert rows(out, "step", "pos", "node", "mode", "changed") == [
        (0, 0, 1, "safe", True), (0, 1, 4, "safe", True), (0, 2, 3, "safe", True), (1, 0, 1, "hazard", True), (1, 1, 2, "hazard", True), (1, 2, 3, "hazard", True)]


def test_fire_levels_and_heat(spark):
    a = graph.arcs(arcs(spark))
    levels = fire.ignition(a, 1, 60)
    assert rows(levels) == [(1, 0), (2, 1), (3, 1), (4, 2)] and rows(fire.ignition(a, 1, 1)) == [(1, 0), (2, 1), (3, 1)]
    two = spark.createDataFrame([(1, 2)], "src long, dst long")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert rows(fire.heat(graph.arcs(two), nodes, 1, 2).where("step = 1"), "node", "t") == [(1, 120.0), (2, pytest.approx(140.0)), (3, 20.0)]


def test_radial_keeps_empty_buckets(spark):
    n = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 4.5, 0.0, 0.0), (3, 99.0, 0.0, 0.0)], "id long, x double, y double, z double")
    out = fire.timeline(fire.radial(n, 0, 1.0, 6)).orderBy("step").collect()
    assert [r["nodes"] for r in out] == [[0], [1], [], [], [2]]


def test_nearest_prefers_the_level(spark):
    n = spark.createDataFrame([(1, 5.0, 0.0, 0.0), (2, 0.0, 1.6, 0.0)], "id long, x double, y double, z double")
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "probe int, px double, py double, pz double")
    assert rows(nearest.nearest_nodes(n, p)) == [(0, 1)]


def test_grid(spark):
    cells = spark.createDataFrame([(0, 0, 0), (3, 0, 0), (9, 0, 0)], "ix long, iy long, iz long")
    full = graph.gaps_filled(cells, 3)
    assert rows(full) == [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0), (9, 0, 0)]
    assert rows(graph.grid_links(graph.numbered(full))) == [(0, 1), (1, 2), (2, 3)]


def test_flat_model_has_no_voxels(spark):
    box = "select 0d minx, 4d maxx, 0d miny, 4d maxy, 0d minz, {}d maxz"
    assert graph.voxels(spark.sql(box.format(0)), 1.0).count() == 0
    assert graph.voxels(spark.sql(box.format(4)), 1.0).count() == 64 and graph.voxels(spark.sql(box.format(4)), 0.1).count() <= 2000


@pytest.mark.parametrize(("n", "found"), [(5, 1), (4, 0)])
def test_stair_chain(spark, n, found):
    t = spark.createDataFrame([(1, str(i), 0.0, 1.0, 0.0, 1.0, i * 0.17) for i in range(n)], "model long, tread string, minx double, maxx double, miny double, maxy double, z double")
    assert elements.stair_chains(t).count() == found


def test_merge_fold(spark):
    b = spark.createDataFrame([(1, i, s, z, 0.0, 1.0, 0.0, 1.0) for i, (z, s) in enumerate([(0.0, False), (1.0, False), (2.0, False), (2.2, False), (5.0, True), (5.5, False)])], "model long, box int, is_stair boolean, z double, minx double, maxx double, miny double, maxy double")
    assert [(pytest.approx(r["z"]), r["n"]) for r in elements.merged_levels(b).orderBy("level").collect()] == [(1.3, 4), (5.0, 1), (5.5, 1)]


def test_merge_fold_of_a_large_model(spark):
    """Many boxes at all heights in one model, some gaps, kinds and models in turn, as folded one by one."""
    rows = [(m, i, (i // 700) % 3 == 1, (i * 0.013 + (i // 500) * 1.3 - 4) if m else i * 0.01, 0.0 - i, 1.0 + i, 0.0, 1.0) for m in (0, 1) for i in range(3000)] + [(2, 0, False, 1.0, 0.0, 1.0, 0.0, 1.0)]
    want = []
    for m, i, kind, z, x0, x1, *_ in sorted(rows, key=lambda r: (r[0], r[3], r[1])):
        last = want[-1] if want else None
        if last and last[0] == m and last[1] == kind and abs(z - last[2]) <= 1.5:
            last[2:] = [(last[2] * last[3] + z) / (last[3] + 1), last[3] + 1, min(last[4], x0), max(last[5], x1)]
        else:
            want.append([m, kind, z, 1, x0, x1])
    b = spark.createDataFrame(rows, "model long, box int, is_stair boolean, z double, minx double, maxx double, miny double, maxy double").repartition(7)
    out = elements.merged_levels(b).orderBy("model", "level").collect()
    assert [[r["model"], r["is_stair"], r["z"], r["n"], r["minx"], r["maxx"]] for r in out] == want and len(want) > 20
    assert [r["level"] for r in out if r["model"] == 1] == list(range(sum(w[0] == 1 for w in want)))


def test_selection(spark):
    c = [("faces", spark.createDataFrame([("f", "w")], "parent string, child string")), ("wires", spark.createDataFrame([("w", "e"), ("w", "e")], "parent string, child string"))]
    closure = containment.ancestors(c)
    assert rows(closure) == [("e", "faces", "f"), ("e", "wires", "w"), ("w", "faces", "f")]
    assert rows(containment.selection_chain(closure, ["faces", "wires"], "edges").where("uid = 'e'"), "pos", "entity") == [(0, "f"), (1, "w"), (2, "e")]


def test_colors(spark):
    r = spark.range(1).select(*styles.temperature_rgb(F.lit(20.0)), *styles.temperature_rgb(F.lit(500.0)), styles.hex_color(F.lit(255), F.lit(0), F.lit(16))).first()
    assert tuple(r) == (0.0, 0.0, 1.0, 1.0, 0.0, 0.0, "#ff0010")


def test_contract_files(spark, tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    good.mkdir(), bad.mkdir()
    (good / "a.json").write_text('{"vertices": [{"type": "Vertex", "uuid": "v1", "coordinates": [1, 2, 3]}], "faces": []}')
    (bad / "a.json").write_text('{"export_version": 1, "main_tree": {}}')
    c = contract.read_contract(spark, str(good))
    v = c.select(F.explode("vertices").alias("v")).select("v.*")
    assert rows(contract.vertex_coordinates(v)) == [("v1", 1.0, 2.0, 3.0)]
    with pytest.raises(contract.BadPayload) as e:
        contract.read_contract(spark, str(bad))
    assert e.value.status == 400
    (bad / "a.json").write_text("no json")
    with pytest.raises(contract.BadPayload) as e:
        contract.read_contract(spark, str(bad))
    assert e.value.status == 422
    (tmp_path / "list.json").write_text('[{"type": "Edge", "uuid": "e1", "dictionary": {"k": "v"}}]')
    assert rows(contract.read_topologies(spark, str(tmp_path / "list.json")), "uid") == [("e1",)]
    contract.write_contract({"vertices": v}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/vertices")).count() == 1


def test_uploads_and_meshes(spark):
    mesh.check_upload("a.IFC", 1)
    for name, size in (("a.obj", 1), ("a.ifc", 0)):
        with pytest.raises(contract.BadPayload):
            mesh.check_upload(name, size)
    p = spark.createDataFrame([(1, 0, 3, [0, 1, 2]), (1, 1, 4, [0, 3])], "geom_id int, part int, n_vertices int, indices array<int>")
    assert rows(mesh.merged_parts(p), "base", "indices") == [(0, [0, 1, 2]), (3, [3, 6])]
    pt = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double")
    assert rows(mesh.placed(pt, [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 10, 20, 30])) == [(11.0, 22.0, 33.0)] and rows(mesh.turned(pt)) == [(1.0, -3.0, 2.0)]
    with pytest.raises(contract.BadPayload):
        mesh.required(pt.limit(0))


def test_graph_sessions(spark):
    n = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(4)], "id long, x double, y double, z double")
    e = graph.radius_graph(n, 1.0)
    s = GraphSession(spark, "t")
    s.register("ifc", n, e)
    assert [r["node"] for r in s.path("ifc", (0, 0, 0), (3, 0, 0)).orderBy("pos").collect()] == [0, 1, 2, 3]
    assert s.resolve("ifc", node=2) == 2 and s.resolve("ifc", node=77) == 1 and s.cells("ifc").count() == 0
    assert [r["nodes"] for r in s.fire("ifc", 0).orderBy("step").collect()] == [r["nodes"] for r in s.fire("ifc", 0, radial=False).orderBy("step").collect()] == [[0], [1], [2], [3]]
    route = [r["node"] for r in s.learned_route("ifc", 0, 1, episodes=1, max_steps=2).orderBy("pos").collect()]
    assert route == [0, 1]  # its only arc, and there is the exit
    for graph_id in ("wire", "cell"):
        with pytest.raises(contract.BadPayload):
            s.nodes(graph_id)
    s.register("ifc", n, e.limit(1))
    with pytest.raises(contract.BadPayload) as x:
        s.path("ifc", (0, 0, 0), (3, 0, 0))
    assert x.value.status == 404


def test_event_table(spark):
    t = spark.createDataFrame([(0, n, 20.0 + n) for n in range(5)] + [(1, 1, 30.0)], "step int, node long, t double")
    r = spark.createDataFrame([(1, 2.0, True, i, n) for i, n in enumerate([4, 2, 7])], "step int, cost double, changed boolean, pos long, node long")
    out = events.event_table(t, r, t.select("node", "t").limit(3), chunk=2).orderBy("seq").collect()
    assert [x["seq"] for x in out] == list(range(len(out)))
    kinds = [(x["type"], x["part"]) for x in out]
    steps = [("temperature_step", 0), ("temperature_step", 1), ("temperature_step", 2), ("temperature_step", 0)]
    assert kinds == [("meta", 0), ("meta", 1), *steps, ("path_update", 0), ("path_update", 1), ("done", 0)]
    assert [x["payload"] for x in out if x["step"] == 0][2] == '{"step":0,"part":2,"parts":3,"temperatures":{"4":24.0}}'
    assert [x["payload"] for x in out if x["type"] == "path_update"] == ['{"step":1,"part":%d,"parts":2,"cost":2.0,"changed":true,"path":%s}' % p for p in ((0, "[4,2]"), (1, "[7]"))]
    assert "meta" not in {x["type"] for x in events.event_table(t, cells=t.limit(0)).collect()}
    assert events.enabled(True, True, "ifc", "a", "b") and not events.enabled(True, True, "ifc", "", "b") and not events.enabled(True, True, "wire", "a", "b")


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("s", 1, "a"), ("s", 2, "a"), ("s", 3, "b")], "session string, step long, path string").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("session string, step long, path string").parquet(str(source))
    q = events.route_changes(stream).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("changes"), "step", "changed") == [(1, True), (2, False), (3, True)]


def test_extensions(spark):
    e = spark.createDataFrame([(1, 2, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, False), (1, 3, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, True), (1, 4, 0.0, 0.0, 0.0, 0.5, 0.0, 0.0, False)], "src long, dst long, a_x double, a_y double, a_z double, b_x double, b_y double, b_z double, is_door boolean")
    w = extensions.wall_lines(spark.sql("select 9L id, 0.9d minx, 1.1d maxx, -3d miny, 3d maxy, 0d z_min, 3d z_max"))
    assert rows(extensions.not_through_walls(e, w), "dst") == [(3,), (4,)]
    d = spark.createDataFrame([(7, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    f = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(9)], "id long, x double, y double, z double")
    assert rows(extensions.door_links(d, f), "dst") == [(0,), (1,), (2,), (3,)]


def test_treads_of_a_refused_chain_are_used_up(spark):
    """Three treads that rise evenly are no stair; four above one of them are one only if they do not need it."""
    from emberway.operators import elements

    tread = lambda model, name, z: (model, name, 0.0, 1.0, 0.0, 1.0, z)
    rows = [tread(1, f"t{i}", i * 0.17) for i in range(3)]  # too few
    rows += [tread(2, "a", 0.0), tread(2, "b", 0.2), *(tread(2, f"c{i}", 0.35 + i * 0.17) for i in range(4))]  # uneven from a: b and all above are used up
    rows += [tread(3, f"t{i}", i * 0.17) for i in range(5)] + [tread(3, f"u{i}", 5 + i * 0.2) for i in range(5)]
    schema = "model long, tread string, minx double, maxx double, miny double, maxy double, z double"
    out = elements.stair_chains(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["model"], r["stair"], r["n"]) for r in out) == [(3, 0, 5), (3, 1, 5)]


def test_egress_lines_keep_to_their_model(spark):
    from emberway.operators import elements

    floor = lambda model, name, z: (model, name, 0.0, 2.0, 0.0, 2.0, z, z, z)
    schema = "model long, id long, minx double, maxx double, miny double, maxy double, z double, z_min double, z_max double"
    floors = spark.createDataFrame([floor(1, 1, 0.0), floor(1, 2, 3.0), floor(2, 3, 0.0), floor(2, 4, 3.0), floor(3, 5, 0.0)], schema)
    stairs = spark.createDataFrame([(1, 8, 4.0, 6.0, 4.0, 6.0, 0.0, 0.0, 3.0), (1, 9, 8.0, 8.0, 8.0, 8.0, 9.0, 9.0, 12.0)], schema)
    via = {r["model"]: (r["x"], r["y"], r["z"]) for r in elements.egress_line(floors, stairs).where("part = 1").collect()}
    assert via == {1: (5.0, 5.0, 1.5), 2: (1.0, 1.0, 1.5)}


def test_numbers_follow_the_order(spark):
    from emberway.operators.order import numbered

    rows = numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5), ["k"]).collect()
    assert all(r["k"] == r["number"] for r in rows) and len(rows) == 1000
    assert numbered(spark.range(0).select(F.col("id").alias("k")), ["k"]).collect() == []


def test_routes_where_there_are_none(spark):
    from emberway.operators import paths

    edges = spark.createDataFrame([(1, 2, 1.0), (3, 4, 1.0)], "src long, dst long, d double")
    field = spark.createDataFrame([(1, 1, 20.0)], "step int, node long, t double")
    assert paths.changed_routes(paths.dynamic_routes(edges, field, 1, 4, [1])).collect() == []
    with pytest.raises(ValueError):
        paths.distances(edges.withColumnRenamed("d", "cost"), 1, rounds=1)
