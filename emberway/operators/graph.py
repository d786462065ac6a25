"""Building navigation graphs: radius joins by spatial bins, grid snap with gap filling, voxels, adjacency."""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberway.functions.geometry import AXES, distance, half_up, round_half_even
from emberway.operators import order, tiles
from emberway.plans.fixpoint import cut


def pairs_within(left: DataFrame, right: DataFrame, r: float, extra: Column | None = None) -> DataFrame:
    """Rows of left (columns a_...) with rows of right (b_...) at a distance of r at most.

    Space is cut into cubes of side r. A right row lies in one cube, a left row looks into the 27
    around its own: an equi-join on cube, with the distance as residual. No cube's rows are
    gathered; AQE splits a crowded one.
    """
    a = left.select(*(F.col(c).alias(f"a_{c}") for c in left.columns))
    b = right.select(*(F.col(c).alias(f"b_{c}") for c in right.columns), *(F.floor(F.col(k) / r).alias(f"cube_{k}") for k in AXES))
    for k in AXES:
        own = F.floor(F.col(f"a_{k}") / r)
        a = a.withColumn(f"cube_{k}", F.explode(F.array(own - 1, own, own + 1)))
    near = F.col("d") <= r
    joined = a.join(b, [f"cube_{k}" for k in AXES]).withColumn("d", distance("a_", "b_")).where(near if extra is None else near & extra)
    return joined.drop(*(f"cube_{k}" for k in AXES))


def radius_graph(points: DataFrame, r: float, kept: Callable | None = None, more: tuple[str, ...] = (), columns: dict[str, str] | None = None, **of_pairs) -> DataFrame:
    """src, dst, d with src < dst: points (id, x, y, z) at a distance of r at most; kept: of both ends' columns, as arrays, which may be joined.

    more: other columns of the points that tiles.pairs() gets, columns: names and types of what its told() gives.
    """
    own, kind = cut(points.select("id", *AXES, *more)), dict(points.dtypes)["id"]
    schema = {"src": kind, "dst": kind, "d": "double"} | (columns or {})
    return tiles.folded(own, tiles.Dealt(own, r), r, tiles.pairs(kept, **of_pairs), ", ".join(f"{n} {t}" for n, t in schema.items()))


def squared_lengths(points: DataFrame, r: float, digits: int) -> DataFrame:
    """src, dst, d2_flat, d2 of the radius graph: its edges' squared lengths on x and y, and on all axes, to some digits."""

    def told(a, b, d):
        e = [(a[k] - b[k]) * (a[k] - b[k]) for k in AXES]  # in the order of geometry.squared
        return {"d2_flat": half_up(e[0] + e[1], digits), "d2": half_up(e[0] + e[1] + e[2], digits)}

    return radius_graph(points, r, told=told, columns={"d2_flat": "double", "d2": "double"}).drop("d")


def radius_graph_with_ends(points: DataFrame, r: float) -> DataFrame:
    """src, dst, d and the coordinates a_x to b_z of the ends: with_ends(radius_graph()), without a shuffle of its edges."""
    rows = pairs_within(points.select("id", *AXES), points.select("id", *AXES), r, F.col("a_id") < F.col("b_id"))
    return rows.withColumnsRenamed({"a_id": "src", "b_id": "dst"})


class Within:
    """The arcs of a radius graph, both ways: found from its points (id, x, y, z, ...) when they are asked for, never stored or shuffled.

    There are as many of them as pairs of points, many more than points where these are dense. What is asked
    of a node's arcs is reduced where they are found: rows come dealt out by the cube of dst.
    weigh: an arc's cost by its length and the columns of its ends, as arrays; inf is no arc. dearest: what no cost is above.
    level: a column of the points; if it is the only one that weigh takes, an arc gets cheaper only as it falls at an end.
    """

    def __init__(self, points: DataFrame, r: float, weigh: Callable | None = None, dearest: float | None = None, level: str | None = None):
        self.r, self.weigh, self.dearest, self.level = r, weigh or length, r if dearest is None else dearest, level
        self.points = cut(points)
        self.kind = dict(points.dtypes)["id"]
        self._dealt: tiles.Dealt | None = None

    def met(self, front: DataFrame, to: DataFrame | None = None) -> DataFrame:
        """The rows of front (src, ...) with dst and d of each arc of their nodes; to: only arcs to these nodes (node)."""
        rows = pairs_within(self._at(front), self._to(to), self.r, F.col("a_id") != F.col("b_id"))
        rest = [F.col(f"a_{c}").alias(c) for c in front.columns if c != "src"]
        return rows.select(F.col("a_id").alias("src"), *rest, F.col("b_id").alias("dst"), "d")

    def folded(self, front: DataFrame, fold: tiles.Fold, schema: str, to: DataFrame | None = None) -> DataFrame:
        """What tiles.folded() makes of the arcs from the rows of front (src, ...) to all nodes, or to these (node)."""
        if self._dealt is None:
            self._dealt = tiles.Dealt(self.points, self.r)
        among = None if to is None else to.select(F.col("node").alias("id"))
        return tiles.folded(self._at(front), self._dealt, self.r, fold, schema, among=among)

    def costs(self, pairs: DataFrame) -> DataFrame:
        """pairs (src, dst, ...) with the cost of their arc, where they have one; the points of pairs alone are looked at."""
        rows, weigh, names, told = pairs, self.weigh, self.points.columns, pairs.columns
        for end, prefix in (("src", "a_"), ("dst", "b_")):
            rows = rows.join(self.points.select(*(F.col(c).alias(prefix + c) for c in names)), F.col(end) == F.col(f"{prefix}id"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = ({c: batch.column(prefix + c).to_numpy(zero_copy_only=False) for c in names} for prefix in ("a_", "b_"))
                yield batch.select(told).append_column("cost", pa.array(weigh(batch.column("d").to_numpy(), a, b)))

        schema = ", ".join(f"`{c}` {t}" for c, t in [*pairs.dtypes, ("cost", "double")])
        return rows.withColumn("d", distance("a_", "b_")).where((F.col("d") <= self.r) & (F.col("src") != F.col("dst"))).mapInArrow(run, schema)

    def costing(self, above: float = -math.inf, most: float = math.inf) -> Within:
        """The arcs whose cost is above one bound and not above another."""
        some, weigh = copy.copy(self), self.weigh

        def bounded(d, a, b):
            cost = weigh(d, a, b)
            return np.where((cost > above) & (cost <= most), cost, np.inf)

        some.weigh = bounded
        return some

    def _at(self, front: DataFrame) -> DataFrame:
        return front.withColumnRenamed("src", "id").join(self.points, "id")

    def _to(self, nodes: DataFrame | None) -> DataFrame:
        return self.points if nodes is None else self.points.join(nodes.select(F.col("node").alias("id")), "id", "left_semi")


def length(d, a, b):
    return d


def met(front: DataFrame, arcs: DataFrame | Within, *columns: str) -> DataFrame:
    """The rows of front (src, ...) with dst, and columns, of each arc of their nodes."""
    rows = arcs.met(front) if isinstance(arcs, Within) else front.join(arcs.select("src", "dst", *columns), "src")
    return rows.select(*front.columns, "dst", *columns)


def rectilinear(axes: tuple[str, str] = ("x", "y")) -> Callable:
    """Whether a link runs along one of two axes: its lesser extent is at most a quarter of the greater, where that is above 0.01."""

    def kept(a, b):
        u, v = (np.abs(a[k] - b[k]) for k in axes)
        major, minor = np.maximum(u, v), np.minimum(u, v)
        return ~((major > 0.01) & (minor > 0.25 * major))

    return kept


def hybrid_graph(points: DataFrame, r_stair: float, r_floor: float, straight: bool = False, axes: tuple[str, str] = ("x", "y")) -> DataFrame:
    """src, dst, d, kind: stair points within r_stair of each other and floor points within r_floor, never one of each.

    straight keeps only floor links that run along one of the two horizontal axes.
    """
    parts = []
    for kind, r in (("stair", r_stair), ("floor", r_floor)):
        own = points.where(F.col("is_stair") == (kind == "stair"))
        parts.append(radius_graph(own, r, rectilinear(axes) if straight and kind == "floor" else None).withColumn("kind", F.lit(kind)))
    return parts[0].unionByName(parts[1])


def forced_links(points: DataFrame, existing: DataFrame | None = None, share: int = 10, rise: float = 1.0, reach: float = 2.0, k: int = 3, axis: str = "y") -> DataFrame:
    """src (a stair point), dst (a floor point), d: how the ends of the stairs join the floors.

    The lowest and the highest max(2, n // share) of n stair points on `axis`, ties by id, are
    linked with their k nearest floor points within reach and within rise on the axis, ties by id.
    There are no links unless both kinds occur; links that exist (src, dst, either way) are left out.
    """
    stairs = cut(order.numbered(points.where("is_stair").select("id", *AXES), [axis, "id"], "place"))
    n = stairs.count()
    take = max(2, n // share)
    ends = stairs.where((F.col("place") < take) | (F.col("place") >= n - take)).drop("place")
    kind = dict(points.dtypes)["id"]
    level = tiles.nearest(k, lambda near, ends: np.abs(ends[axis] - near[axis]) <= rise)
    links = tiles.folded(points.where("not is_stair").select("id", *AXES), ends, reach, level, f"src {kind}, dst {kind}, d double", apart=False)
    if existing is not None:
        both = existing.select("src", "dst").unionByName(existing.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        links = links.join(both, ["src", "dst"], "left_anti")
    return links


def snapped(points: DataFrame, cell: float, vertical: float | None = None, up: str = "z") -> DataFrame:
    """ix, iy, iz: the grid cells that hold points, each once; coordinates are rounded half to even."""
    size = {k: (vertical or cell) if k == up else cell for k in AXES}
    return points.select(*(round_half_even(F.col(k) * (1.0 / size[k])).cast("long").alias(f"i{k}") for k in AXES)).distinct()


def gaps_filled(cells: DataFrame, max_gap: int) -> DataFrame:
    """Cells, and those between neighbours on an axis that are at most max_gap apart; only cells that were there count as neighbours."""
    names = [f"i{k}" for k in AXES]
    out = cells.select(*names)
    for k in names:
        others = [n for n in names if n != k]
        after = F.lead(k).over(W.partitionBy(*others).orderBy(k))
        gap = cells.select(*names, after.alias("after")).where((F.col("after") - F.col(k) > 1) & (F.col("after") - F.col(k) <= max_gap))
        out = out.unionByName(gap.select(*others, F.explode(F.sequence(F.col(k) + 1, F.col("after") - 1)).alias(k)).select(*names))
    return out.distinct()


def numbered(cells: DataFrame, first: int = 0) -> DataFrame:
    """Adds id, from first, in the order of ix, iy, iz."""
    return order.numbered(cells, ["ix", "iy", "iz"], "id").select((F.col("id") + first).alias("id"), "ix", "iy", "iz")


def grid_links(cells: DataFrame) -> DataFrame:
    """src, dst for cells (id, ix, iy, iz) that share a face, src the lower one on their axis."""
    steps = [[F.lit(int(i == j)) for j in range(3)] for i in range(3)]
    move = F.explode(F.array(*(F.struct(*(s.alias(f"d{k}") for s, k in zip(row, AXES))) for row in steps)))
    probe = cells.select(F.col("id").alias("src"), "ix", "iy", "iz", move.alias("m")).select("src", *((F.col(f"i{k}") + F.col(f"m.d{k}")).alias(f"i{k}") for k in AXES))
    return probe.join(cells.withColumnRenamed("id", "dst"), ["ix", "iy", "iz"]).select("src", "dst")


def grid_parameters(base: float, cell: float | None = None) -> dict[str, float]:
    """The cell size, its vertical size, and the largest gap that is filled."""
    size = base if cell is None else cell
    return {"cell": size, "v_cell": min(size, 0.15), "max_gap": max(2, math.ceil(base / size) + 1)}


def grid_columns(requests: DataFrame) -> DataFrame:
    """requests (base, cell; null: as base) with the columns of `grid_parameters`."""
    size = F.coalesce("cell", "base")
    return requests.withColumns({"cell": size, "v_cell": F.least(size, F.lit(0.15)), "max_gap": F.greatest(F.lit(2).cast("long"), F.ceil(F.col("base") / size) + 1)})


def arcs(edges: DataFrame) -> DataFrame:
    """src, dst both ways, each once, without loops."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def adjacency(edges: DataFrame, nodes: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """arcs of the edges of some kinds whose ends are both nodes (id)."""
    kept = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    for end in ("src", "dst"):
        kept = kept.join(nodes.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    return arcs(kept)


def output_edges(links: DataFrame) -> DataFrame:
    """Arcs as undirected edges, the end that is less as a string first."""
    return links.where(F.col("src").cast("string") < F.col("dst").cast("string"))


def edge_key() -> Column:
    """a|b of an edge's ends in the order of strings."""
    a, b = F.col("src").cast("string"), F.col("dst").cast("string")
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def edge_keys(edges: DataFrame) -> DataFrame:
    """key, edge: a|b of an edge's ends in the order of strings, and the first edge that has it."""
    return edges.groupBy(edge_key().alias("key")).agg(F.min("edge").alias("edge"))


def with_ends(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds the coordinates a_x to b_z of an edge's ends."""
    for end, prefix in (("src", "a_"), ("dst", "b_")):
        links = links.join(nodes.select(F.col("id").alias(end), *(F.col(k).alias(prefix + k) for k in AXES)), end)
    return links


def step_size(links: DataFrame | Within, nodes: DataFrame) -> DataFrame:
    """step: the least positive length of an edge, 1.0 if there is none."""
    if isinstance(links, Within):
        d = links.folded(links.points.select(F.col("id").alias("src")), tiles.least_length, "d double")
        return d.agg(F.coalesce(F.min("d"), F.lit(1.0)).alias("step"))
    d = with_ends(links, nodes).select(distance("a_", "b_").alias("d"))
    return d.agg(F.coalesce(F.min(F.when(F.col("d") > 0, F.col("d"))), F.lit(1.0)).alias("step"))


def bounds(points: DataFrame) -> DataFrame:
    return points.agg(*(f(k).alias(f"{n}{k}") for k in AXES for n, f in (("min", F.min), ("max", F.max))))


def voxels(box: DataFrame, cell: float, most: int = 2000) -> DataFrame:
    """i, j, k, cx, cy, cz and the bounds of the cells of a box (minx to maxz); none if a span is not positive.

    An axis has max(1, int(span / cell)) cells; if there would be more than `most`, each count is
    scaled by the cube root of the excess and cut down, to 1 at least.
    """
    for k in AXES:
        box = box.withColumn(f"span{k}", F.col(f"max{k}") - F.col(f"min{k}"))
    for k in AXES:
        box = box.withColumn(f"n{k}", F.greatest(F.lit(1), F.floor(F.col(f"span{k}") / cell)))
    box = box.where("spanx > 0 and spany > 0 and spanz > 0").where(" and ".join(f"span{k} < double('infinity')" for k in AXES))
    total = F.col("nx") * F.col("ny") * F.col("nz")
    scale = F.pow(total / F.lit(float(most)), F.lit(1 / 3))
    for k in AXES:
        box = box.withColumn(f"m{k}", F.when(total > most, F.greatest(F.lit(1), F.floor(F.col(f"n{k}") / scale))).otherwise(F.col(f"n{k}")))
    for k, i in zip(AXES, "ijk"):
        box = box.withColumn(i, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"m{k}") - 1)))
    size = {k: F.col(f"span{k}") / F.col(f"m{k}") for k in AXES}
    low = {k: F.col(f"min{k}") + F.col(i) * size[k] for k, i in zip(AXES, "ijk")}
    return box.select("i", "j", "k", *((low[k] + size[k] / 2).alias(f"c{k}") for k in AXES), *(low[k].alias(f"lo{k}") for k in AXES), *((low[k] + size[k]).alias(f"hi{k}") for k in AXES), *(F.col(f"m{k}") for k in AXES))
