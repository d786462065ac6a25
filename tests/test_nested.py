"""Nested spans, children and steps in parts, running maxima, and rules of requests, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from emberway.operators import containment, extensions, fire, graph, sampling
from emberway.operators.order import running_max
from emberway.streaming import events

LINK = "parent string, child string"


def levels(spark, seed, width=9):
    """Links of three levels: shared children, repeated links, null ends, parents that nobody holds."""
    r = random.Random(seed)
    names = [[f"{p}{i}" for i in range(n)] for p, n in (("a", 3), ("b", width), ("c", 2 * width), ("d", 3 * width))]
    out = []
    for up, down in zip(names, names[1:]):
        links = [(r.choice(up), c) for c in down for _ in range(r.randint(0, 2))]
        out.append(links + links[:2] + [(None, down[0]), (up[0], None), (f"lost{up[0]}", down[-1])])
    return out


def plain_paths(all_links):
    """Every path from a top down, in order."""
    below, held = {}, set()
    for links in all_links:
        for p, c in links:
            if p is not None and c is not None:
                below.setdefault(p, set()).add(c)
                held.add(c)

    def walk(path):
        yield path
        for c in below.get(path[-1], ()):
            yield from walk((*path, c))

    return sorted(p for top in set(below) - held for p in walk((top,)))


@pytest.mark.parametrize("seed", range(3))
def test_spans_of_all_paths(spark, seed):
    links = levels(spark, seed)
    contains = [(n, spark.createDataFrame(rows, LINK)) for n, rows in zip("abc", links)]
    nest = containment.nested(contains, "d").cache()
    paths = plain_paths(links)
    got = {tuple(r["path"]): (r["uid"], r["level"], r["lo"], r["hi"]) for r in nest.collect()}
    assert len(got) == nest.count() == len(paths)
    for i, p in enumerate(paths):
        last = max(j for j, q in enumerate(paths) if q[: len(p)] == p)
        assert got[p] == (p[-1], p[-1].removeprefix("lost")[0], i, last)
    for wanted in (["b1"], ["a0", "b2", "c3"], ["d0"], ["nobody"], ["losta0", "c1"]):
        want = {p[-1] for p in paths if set(p[:-1]) & set(wanted)}
        found = [r["uid"] for r in containment.below(nest, F.col("uid").isin(wanted)).collect()]
        assert sorted(found) == sorted(want)
    closure = containment.ancestors([(n, df.dropna()) for n, df in contains])
    assert {(r["uid"], r["ancestor"]) for r in closure.collect()} == {(p[-1], a) for p in paths for a in p[:-1]}


def test_no_links_no_spans(spark):
    none = spark.createDataFrame([], LINK)
    nest = containment.nested([("a", none), ("b", none)], "c")
    assert nest.count() == 0 and containment.below(nest, F.lit(True)).count() == 0
    assert containment.children(none).count() == 0


def test_children_come_in_parts(spark):
    """One parent has nearly all children: no row has more than a part of them."""
    links = [("hot", f"x{i:04d}") for i in range(500)] + [("cold", "x0001"), ("cold", "x0001"), (None, "x"), ("hot", None)]
    out = containment.children(spark.createDataFrame(links, LINK).repartition(5), 64).orderBy("parent", "part").collect()
    assert [(r["parent"], r["part"], r["parts"], len(r["children"])) for r in out] == [("cold", 0, 1, 1)] + [("hot", p, 8, 64 if p < 7 else 52) for p in range(8)]
    assert [c for r in out for c in r["children"]] == ["x0001"] + [f"x{i:04d}" for i in range(500)]
    rows = containment.child_rows(spark.createDataFrame(links, LINK), 64).where("parent = 'hot'").orderBy("pos").collect()
    assert [(r["pos"], r["child"]) for r in rows] == [(i, f"x{i:04d}") for i in range(500)]


def test_steps_come_in_parts(spark):
    lit = spark.createDataFrame([(n, 0) for n in range(30)] + [(99, 2)], "node long, step int").repartition(3)
    out = fire.timeline(lit, last=3, chunk=8).orderBy("step", "part").collect()
    assert [(r["step"], r["part"], r["parts"], len(r["nodes"])) for r in out] == [(0, 0, 4, 8), (0, 1, 4, 8), (0, 2, 4, 8), (0, 3, 4, 6), (1, 0, 1, 0), (2, 0, 1, 1), (3, 0, 1, 0)]
    assert [n for r in out for n in r["nodes"]] == [*range(30), 99]
    assert fire.timeline(lit.limit(0)).count() == 0


def test_running_maximum(spark):
    r = random.Random(5)
    values = [(i, r.choice([None, r.randint(0, 1000)])) for i in range(300)]
    out = running_max(spark.createDataFrame(values, "at long, v long").repartition(6), "at", F.col("v"), "m").orderBy("at").collect()
    for i, row in enumerate(out):
        assert row["m"] == max((v for _, v in values[:i] if v is not None), default=None)


def test_selection_goes_round(spark):
    chain = spark.createDataFrame([("e", 0, "f"), ("e", 1, "w"), ("e", 2, "e"), ("f", 0, "f")], "uid string, pos int, entity string")
    assert sorted((r["uid"], r["pos"], r["next"]) for r in containment.next_in_chain(chain).collect()) == [("e", 0, "w"), ("e", 1, "e"), ("e", 2, "f"), ("f", 0, "f")]


def test_rules_hold_for_tables_of_requests(spark):
    asked = [(0.5, None, None), (4.0, 0.0, 0.0), (2.0, 9.0, 0.7)]
    out = sampling.spacings(spark.createDataFrame(asked, "requested double, max_edge_floor double, max_edge_stair double")).collect()
    for (requested, floor, stair), row in zip(asked, out):
        assert {k: row[k] for k in ("floor", "stair", "max_edge_floor", "max_edge_stair")} == pytest.approx(sampling.spacing_rules(requested, floor, stair))
    cells = [(1.5, None), (1.5, 0.1), (1.5, 4.0), (0.1, None)]
    for (base, cell), row in zip(cells, graph.grid_columns(spark.createDataFrame(cells, "base double, cell double")).collect()):
        assert {k: row[k] for k in ("cell", "v_cell", "max_gap")} == pytest.approx(graph.grid_parameters(base, cell))
    requests = [(True, True, "ifc", "a", "b"), (True, False, "ifc", "a", "b"), (True, True, "wire", "a", "b"), (True, True, "ifc", "", "b"), (True, True, "ifc", None, "b"), (True, True, "ifc", "a", None), (None, True, "ifc", "a", "b")]
    told = spark.createDataFrame(requests, "stream_path boolean, use_temperature boolean, mode string, start string, end string")
    names = [F.col(c) for c in told.columns]
    assert [r[0] for r in told.select(events.routed(*names)).collect()] == [events.enabled(*r) for r in requests]


def test_edge_colors(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    shown = spark.createDataFrame([("e9", 2, 1), ("e5", 1, 2), ("e7", 1, 3), ("e1", 3, 2)], "edge string, src long, dst long")
    t = spark.createDataFrame([(1, 120.0), (2, 120.0)], "node long, t double")
    out = {r["edge"]: tuple(r)[1:] for r in extensions.edge_colors(edges, shown, t).collect()}
    assert out == {"e5": (120.0, 1.0, 0.0, 0.0), "e1": (70.0, 0.0, 1.0, 0.0)}
