"""Documented extensions beyond the surveyed code: doors as waypoints, walls that cut links, colours by edge. Not part of the parity inventory."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberway.functions.geometry import AXES
from emberway.functions.styles import temperature_rgb
from emberway.operators import tiles
from emberway.operators.graph import Within, edge_key, radius_graph
from emberway.plans.fixpoint import cut_counted

FEW = 100_000  #: squares of walls, of eight numbers, that are broadcast rather than shuffled


def door_links(doors: DataFrame, floors: DataFrame, k: int = 5, reach: float = 3.0) -> DataFrame:
    """src (a door), dst, d: each door's bottom centre with its k nearest floor nodes within reach."""
    schema = f"src {dict(doors.dtypes)['id']}, dst {dict(floors.dtypes)['id']}, d double"
    return tiles.folded(floors.select("id", "x", "y", "z"), doors.select("id", "x", "y", "z"), reach, tiles.nearest(k), schema, apart=False)


def wall_lines(walls: DataFrame) -> DataFrame:
    """id, the ends sx, sy, ex, ey and z_min, z_max of a wall's centre line along its box's longer horizontal side."""
    along_x = F.col("maxx") - F.col("minx") >= F.col("maxy") - F.col("miny")
    cx, cy = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    pick = lambda a, b: F.when(along_x, a).otherwise(b)
    return walls.select("id", pick(F.col("minx"), cx).alias("sx"), pick(cy, F.col("miny")).alias("sy"), pick(F.col("maxx"), cx).alias("ex"), pick(cy, F.col("maxy")).alias("ey"), "z_min", "z_max")


def _side(ax: str, ay: str, bx: str, by: str, px: str, py: str) -> Column:
    c = F.col
    return F.signum((c(bx) - c(ax)) * (c(py) - c(ay)) - (c(by) - c(ay)) * (c(px) - c(ax)))


def not_through_walls(edges: DataFrame, walls: DataFrame, cell: float = 2.0, longest: float | None = None) -> DataFrame:
    """Edges (src, dst, a_x to b_z, is_door) that cross no wall line of their height; door edges stay.

    Both are dealt into the squares that their boxes touch, so that only neighbours meet; walls along the same line
    count once. With longest, a length on x or y that no edge is above, and cells of more than that, an edge touches
    two squares an axis at most: it then looks into that of its least corner only, as walls stand in those below
    theirs too, and edges are neither repeated nor, where walls are few, shuffled.
    """
    walls = walls.select("sx", "sy", "ex", "ey", "z_min", "z_max").distinct()
    squares = lambda df, x1, y1, x2, y2: df.withColumn("cx", F.explode(F.sequence(F.floor(F.least(x1, x2) / cell), F.floor(F.greatest(x1, x2) / cell)))).withColumn("cy", F.explode(F.sequence(F.floor(F.least(y1, y2) / cell), F.floor(F.greatest(y1, y2) / cell))))
    e = squares(edges.where("not is_door"), "a_x", "a_y", "b_x", "b_y")
    w = squares(walls, "sx", "sy", "ex", "ey")
    high = (F.greatest("a_z", "b_z") >= F.col("z_min")) & (F.least("a_z", "b_z") <= F.col("z_max"))
    crosses = (_side("a_x", "a_y", "b_x", "b_y", "sx", "sy") * _side("a_x", "a_y", "b_x", "b_y", "ex", "ey") <= 0) & (_side("sx", "sy", "ex", "ey", "a_x", "a_y") * _side("sx", "sy", "ex", "ey", "b_x", "b_y") <= 0)
    if longest is not None and longest < cell:
        for k in ("cx", "cy"):
            w = w.withColumn(k, F.explode(F.array(F.col(k), F.col(k) - 1)))
        w, counts = cut_counted(w.distinct())
        w = F.broadcast(w) if counts["n"] <= FEW else w
        at = edges.withColumns({f"edge_c{k}": F.floor(F.least(f"a_{k}", f"b_{k}") / cell) for k in "xy"})
        same = (F.col("edge_cx") == F.col("cx")) & (F.col("edge_cy") == F.col("cy"))
        return at.join(w, same & ~F.col("is_door") & high & crosses, "left_anti").drop("edge_cx", "edge_cy")
    met = e.join(w, ["cx", "cy"]).where(high)
    cut = met.where(crosses).select("src", "dst").distinct()
    return edges.join(cut.withColumn("cut", F.lit(True)), ["src", "dst"], "left").where("is_door or cut is null").drop("cut")


def uncut_edges(points: DataFrame, r: float, walls: DataFrame, is_door: Callable) -> DataFrame:
    """src, dst, is_door: not_through_walls() of the radius graph over points (id, x, y, z), whose pairs meet walls where they are found.

    is_door: whether an edge is one, of its ends' columns as arrays. Walls go to all tasks, those along the same line once; on which side of
    a wall's line an end lies is told once a pair, and only pairs on both sides of a line near them are looked at further.
    """
    walls = walls.select("sx", "sy", "ex", "ey", "z_min", "z_max").dropna().distinct().toPandas().to_numpy(np.float64).reshape(-1, 6)
    sent = points.sparkSession.sparkContext.broadcast(walls)
    side = lambda ax, ay, bx, by, px, py: np.sign((bx - ax) * (py - ay) - (by - ay) * (px - ax))

    def lets(a, b):
        stays, some = np.ones(len(a["id"]), bool), np.flatnonzero(~is_door(a, b))
        if not len(some):
            return stays
        low, high = ({k: f(a[k][some], b[k][some]) for k in AXES} for f in (np.minimum, np.maximum))
        w = sent.value
        near = (np.maximum(w[:, 0], w[:, 2]) >= low["x"].min()) & (np.minimum(w[:, 0], w[:, 2]) <= high["x"].max()) & (np.maximum(w[:, 1], w[:, 3]) >= low["y"].min())
        near &= (np.minimum(w[:, 1], w[:, 3]) <= high["y"].max()) & (w[:, 4] <= high["z"].max()) & (w[:, 5] >= low["z"].min())
        ax, ay, bx, by, lz, hz = a["x"][some], a["y"][some], b["x"][some], b["y"][some], low["z"], high["z"]
        for sx, sy, ex, ey, z_min, z_max in w[near]:
            at = np.flatnonzero((hz >= z_min) & (lz <= z_max) & (side(sx, sy, ex, ey, ax, ay) * side(sx, sy, ex, ey, bx, by) <= 0))
            if not len(at):
                continue
            ends = ax[at], ay[at], bx[at], by[at]
            at = at[side(*ends, sx, sy) * side(*ends, ex, ey) <= 0]
            if len(at):
                stays[some[at]] = False
                rest = np.ones(len(some), bool)
                rest[at] = False
                some, ax, ay, bx, by, lz, hz = (v[rest] for v in (some, ax, ay, bx, by, lz, hz))
        return stays

    edges = radius_graph(points, r, lets=lets, told=lambda a, b, d: {"is_door": is_door(a, b)}, columns={"is_door": "boolean"}, by=("src", "dst"))
    return edges.select("src", "dst", "is_door")


def edge_colors(edges: DataFrame | Within, shown: DataFrame, temperatures: DataFrame, ambient: float = 20.0) -> DataFrame:
    """edge, t, red, green, blue for the edges (edge, src, dst) that a viewer shows: those that a graph's edges (src, dst) run along, either way.

    t is the mean of the ends' temperatures (node, t); an end without one has that of its surroundings. Of shown edges
    between the same nodes the first has the colour.
    """
    first = shown.groupBy(edge_key().alias("key")).agg(F.min(F.struct("edge", "src", "dst")).alias("first")).select("key", "first.*")
    if isinstance(edges, Within):  # only the edges that are shown are looked at
        met = first.join(edges.costs(first.select("src", "dst", "key")).select("key"), "key", "left_semi")
    else:
        met = first.join(edges.select(edge_key().alias("key")), "key", "left_semi")
    for end in ("src", "dst"):
        known = temperatures.select(F.col("node").alias(end), F.col("t").alias(f"{end}_t"))
        met = met.join(known, end, "left").withColumn(f"{end}_t", F.coalesce(f"{end}_t", F.lit(ambient)))
    red, green, blue = temperature_rgb(F.col("t"))
    return met.select("edge", ((F.col("src_t") + F.col("dst_t")) / 2).alias("t")).select("edge", "t", red.alias("red"), green.alias("green"), blue.alias("blue"))
