"""Nearest nodes down a pyramid of cells, against a look at every node."""

import random

from emberway.operators import nearest


def plain(nodes, probes, axis=1):
    out = []
    for probe, *p in probes:
        best = []
        for n, *q in nodes:
            level = abs(q[axis] - p[axis]) <= nearest.LEVEL
            best.append((not level, sum((a - b) ** 2 for i, (a, b) in enumerate(zip(q, p)) if not level or i != axis), n))
        out.append((probe, min(best)[2]))
    return sorted(out)


def test_pyramid_finds_the_nearest(spark, monkeypatch):
    monkeypatch.setattr(nearest, "HELD", 2)
    rng = random.Random(4)
    at = lambda w: round(rng.uniform(0, w), 1)
    nodes = [(i, at(40), float(rng.choice([0, 3, 6, 30])), at(40)) for i in range(150)]
    nodes += [(200 + i, 3 + at(0.5), 3.0, 4 + at(0.5)) for i in range(120)]  # a crowd in one place
    nodes += [(400 + i, 5.0, 6.0, 5.0) for i in range(5)] + [(500, 400.0, 0.0, -90.0)]  # ties, and one far out
    probes = [(i, at(60) - 10, rng.choice([0.0, 1.5, 1.6, 3.2, 15.0, -9.0, 29.0]), at(60) - 10) for i in range(150)] + [(900, 5.0, 6.0, 5.0), (901, 1e6, 0.0, 0.0)]
    n = spark.createDataFrame(nodes, "id long, x double, y double, z double")
    p = spark.createDataFrame([*probes, (999, None, 0.0, 0.0)], "probe long, px double, py double, pz double")
    got = sorted((r["probe"], r["id"]) for r in nearest.nearest_nodes(n, p).collect())
    assert got == plain(nodes, probes)
    few = p.where("probe in (1, 2, 900, 999)")
    assert sorted((r["probe"], r["id"]) for r in nearest.nearest_nodes(n, few).collect()) == [g for g in got if g[0] in (1, 2, 900)]


def test_pyramid_of_little(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PICKED", 0)
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "probe long, px double, py double, pz double")
    one = spark.createDataFrame([(7, 1.0, 9.0, 1.0)], "id long, x double, y double, z double")
    assert [tuple(r) for r in nearest.nearest_nodes(one, p).collect()] == [(1, 7)]
    assert nearest.nearest_nodes(one.limit(0), p).collect() == []


def test_rows_grow_with_boxes_not_probes(spark, monkeypatch):
    """Probes of a place go down the pyramid together: forty times the probes there, but no more rows between levels."""
    monkeypatch.setattr(nearest, "HELD", 2)
    rng = random.Random(6)
    n = spark.createDataFrame([(i, rng.uniform(0, 40), float(rng.choice([0, 3, 6])), rng.uniform(0, 40)) for i in range(200)], "id long, x double, y double, z double")
    places = [(rng.uniform(0, 40), rng.choice([0.0, 3.2]), rng.uniform(0, 40)) for _ in range(8)]
    cut, seen = nearest.cut, []

    def counting(df):
        out = cut(df)
        if "bound" in out.columns:
            seen.append(out.count())
        return out

    monkeypatch.setattr(nearest, "cut", counting)
    pyramid, most = nearest.Pyramid(n), []
    for copies in (1, 40):
        rows = [(i * 8 + j, *p) for i in range(copies) for j, p in enumerate(places)]
        p = spark.createDataFrame(rows, "probe long, px double, py double, pz double")
        got = sorted((r["probe"], r["id"]) for r in pyramid.nearest(p, "y").collect())
        assert len(got) == len(rows) and got == plain([tuple(r) for r in n.collect()], rows)
        most.append(max(seen))
        seen.clear()
    assert most[0] == most[1]
