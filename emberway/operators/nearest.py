"""Nearest nodes: on the same level first, then anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberway.functions.geometry import AXES
from emberway.plans.fixpoint import cut, cut_counted

PICKED = 64  #: probes that are compared with all nodes
FAN, HELD = 4, 16  #: cells a side in a cell of the next level; nodes in a cell of the lowest level, about
FEW = 100_000  #: cells of a level, of nine numbers, that are broadcast rather than shuffled
CELL, BOX = ("cx", "cy", "cz"), ("bx", "by", "bz")
LEVEL = 1.5  #: nodes no further than this from the point on the vertical axis are on its level


def _order(vertical: str) -> Column:
    flat = sum(((F.col(k) - F.col(f"p{k}")) * (F.col(k) - F.col(f"p{k}")) for k in AXES if k != vertical), F.lit(0.0))
    full = sum(((F.col(k) - F.col(f"p{k}")) * (F.col(k) - F.col(f"p{k}")) for k in AXES), F.lit(0.0))
    level = F.abs(F.col(vertical) - F.col(f"p{vertical}")) <= LEVEL
    return F.struct(F.when(level, 0).otherwise(1).alias("phase"), F.when(level, flat).otherwise(full).alias("d2"), F.col("id"))


def nearest_nodes(nodes: DataFrame, probes: DataFrame, vertical: str = "y") -> DataFrame:
    """probe, id: for each probe (probe, px, py, pz) the nearest node (id, x, y, z).

    Nodes on the probe's level come first, by distance off the vertical axis; without one, all by
    distance; ties to the smaller id. Probes are told apart by probe; one that lacks a coordinate has no row. A few picked points, by count, meet all
    nodes in one scan; more of them go down a pyramid of cells (see Pyramid).
    """
    whole = probes.select("probe", *(F.col(f"p{k}").cast("double").alias(f"p{k}") for k in AXES))
    probes, counts = cut_counted(whole.where(" and ".join(f"p{k} is not null" for k in AXES)))
    if counts["n"] <= PICKED:
        met = nodes.crossJoin(F.broadcast(probes))
        return met.groupBy("probe").agg(F.min(_order(vertical)).alias("m")).select("probe", F.col("m.id").alias("id"))
    pyramid = Pyramid(nodes)
    level = cut(pyramid.nearest(probes, vertical))
    rest = cut(probes.join(level.select("probe"), "probe", "left_anti"))
    return level.unionByName(pyramid.nearest(rest))


class Pyramid:
    """Cells over nodes (id, x, y, z): parts of each axis' span that hold a few nodes each, FAN of them a side in a cell of the next level, up to one.

    A cell knows the box that its nodes really fill, so a search from the top takes into the next level only
    cells that could hold a node as near as one that some other cell holds for certain. It goes down once for
    the probes of a box together, so that there are rows for each box and cell, not for each probe and cell.
    """

    def __init__(self, nodes: DataFrame):
        self.nodes = cut(nodes.select("id", *(F.col(k).cast("double").alias(k) for k in AXES)).where(" and ".join(f"{k} is not null and not isnan({k})" for k in AXES)))
        found = self.nodes.agg(F.count("*"), *(f(k) for k in AXES for f in (F.min, F.max))).first()
        n, bounds = found[0], found[1:]
        self.levels: list[tuple[DataFrame, int]] = []
        if not n:
            return
        height = 0
        while FAN ** (2 * height) * HELD < n:  # nodes of buildings lie on surfaces, so that two of three axes fill
            height += 1
        self.least = dict(zip(AXES, bounds[::2]))
        self.size = {k: (bounds[2 * i + 1] - bounds[2 * i]) / FAN**height or 1.0 for i, k in enumerate(AXES)}
        cell = {f"c{k}": F.least(F.floor((F.col(k) - self.least[k]) / self.size[k]), F.lit(FAN**height - 1)) for k in AXES}
        self.nodes = cut(self.nodes.withColumns(cell))
        box = lambda rows, own: rows.groupBy(*CELL).agg(*(f(own(k, n)).alias(f"{n}{k}") for k in AXES for n, f in (("min", F.min), ("max", F.max))))
        rows, counts = cut_counted(box(self.nodes, lambda k, n: k))
        self.levels.append((rows, counts["n"]))
        for _ in range(height):
            up = rows.withColumns({c: F.floor(F.col(c) / FAN) for c in CELL})
            rows, counts = cut_counted(box(up, lambda k, n: f"{n}{k}"))
            self.levels.append((rows, counts["n"]))

    def nearest(self, probes: DataFrame, vertical: str | None = None) -> DataFrame:
        """probe, id of the nearest node, ties to the smaller id; with a vertical axis, of those on the probe's level, off that axis: none if there is none."""
        if not self.levels:
            return probes.select("probe").join(self.nodes.select("id"), F.lit(False))
        flat = [k for k in AXES if k != vertical]
        square = lambda c: c * c
        gap = lambda k: F.greatest(F.col(f"min{k}") - F.col(f"high{k}"), F.col(f"low{k}") - F.col(f"max{k}"), F.lit(0.0))
        far = lambda k: F.greatest(F.col(f"high{k}") - F.col(f"min{k}"), F.col(f"max{k}") - F.col(f"low{k}"))
        low, high = (sum((square(f(k)) for k in flat), F.lit(0.0)) for f in (gap, far))
        if vertical:
            high = F.when(far(vertical) <= LEVEL, high)  # all its nodes are on the level
        side = {k: LEVEL / 8 if k == vertical else 2 * self.size[k] for k in AXES}
        probes = probes.where(" and ".join(f"not isnan(p{k})" for k in AXES)).withColumns({f"b{k}": F.floor((F.col(f"p{k}") - self.least[k]) / side[k]) for k in AXES})
        ways = probes.groupBy(*BOX).agg(*(f(f"p{k}").alias(f"{n}{k}") for k in AXES for n, f in (("low", F.min), ("high", F.max))))
        ways = ways.select("*", *(F.lit(0).cast("long").alias(c) for c in CELL), F.lit(float("inf")).alias("bound"))
        own = [*BOX, *(f"{n}{k}" for k in AXES for n in ("low", "high"))]
        for cells, n in self.levels[-2::-1]:
            below = cells.withColumns({f"up_{c}": F.floor(F.col(c) / FAN) for c in CELL})
            ways = ways.withColumnsRenamed({c: f"up_{c}" for c in CELL}).join(F.broadcast(below) if n <= FEW else below, [f"up_{c}" for c in CELL])
            ways = ways.where(gap(vertical) <= LEVEL) if vertical else ways
            bound = F.least("bound", F.min(high).over(W.partitionBy(*BOX)))
            ways = ways.withColumn("low", low).withColumn("bound", bound).where("low <= bound")
            ways = cut(ways.select(*own, *CELL, "bound"))
        met = probes.join(ways.select(*BOX, *CELL).join(self.nodes, list(CELL)), list(BOX))
        if vertical:
            met = met.where(F.abs(F.col(vertical) - F.col(f"p{vertical}")) <= LEVEL)
        d2 = sum((square(F.col(k) - F.col(f"p{k}")) for k in flat), F.lit(0.0))
        return met.groupBy("probe").agg(F.min(F.struct(d2.alias("d2"), "id")).alias("m")).select("probe", F.col("m.id").alias("id"))


def resolved(nodes: DataFrame, wanted: DataFrame, vertical: str = "y") -> DataFrame:
    """probe, id: the node that a request (probe, node_id, px, py, pz) means: node_id if there is such a node, else the nearest to the point; null without either."""
    known = wanted.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("probe", F.col("node_id").alias("id"))
    rest = wanted.join(known, "probe", "left_anti")
    near = nearest_nodes(nodes, rest.where("px is not null and py is not null and pz is not null").select("probe", "px", "py", "pz"), vertical)
    found = known.unionByName(near)
    return wanted.select("probe").join(found, "probe", "left")


def default_start(nodes: DataFrame, vertical: str = "y") -> DataFrame:
    """id of the node nearest to the centre of all nodes' bounds."""
    centre = nodes.agg(*(((F.min(k) + F.max(k)) / 2).alias(f"p{k}") for k in AXES)).withColumn("probe", F.lit(0))
    return nearest_nodes(nodes, centre, vertical).select("id")
