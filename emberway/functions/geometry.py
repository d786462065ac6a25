"""Geometry of points and triangles as column expressions; every coordinate is a double."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def up_axis(name: Column) -> Column:
    """0, 1 or 2 for an axis name; what is neither x nor y is z."""
    return F.when(F.lower(name) == "y", 1).when(F.lower(name) == "x", 0).otherwise(2)


def distance(a: str, b: str, axes: tuple[str, ...] = AXES) -> Column:
    """Distance of points whose columns have prefixes a and b."""
    return F.sqrt(squared(a, b, axes))


def squared(a: str, b: str, axes: tuple[str, ...] = AXES) -> Column:
    total = None
    for k in axes:
        d = F.col(a + k) - F.col(b + k)
        total = d * d if total is None else total + d * d
    return total


def cross(a: str = "a", b: str = "b", c: str = "c") -> tuple[Column, Column, Column]:
    """The cross product of b - a and c - a, columns ax, ay, az and so on."""
    u = [F.col(b + k) - F.col(a + k) for k in AXES]
    v = [F.col(c + k) - F.col(a + k) for k in AXES]
    return u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]


def length(v: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def normal() -> tuple[Column, ...]:
    """The unit normal of triangle a, b, c; zeros if it has no area."""
    n = cross()
    size = length(n)
    return tuple(F.when(size > 0, k / size).otherwise(0.0) for k in n)


def area() -> Column:
    return length(cross()) * 0.5


def least_up(slope_deg: float) -> float:
    """The least up component of a normal that a slope filter of so many degrees lets through."""
    return math.cos(math.radians(90 - slope_deg))


def round_half_even(c: Column) -> Column:
    return F.rint(c)


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Doubles to some digits as Spark's round() gives them, by their decimal digits where these may decide; -0.0 is 0.0."""
    size = np.abs(x) * 10.0**digits
    whole = np.floor(size)
    out = np.copysign((whole + (size - whole >= 0.5)) / 10.0**digits, x) + 0.0
    for i in np.flatnonzero((np.abs(size - whole - 0.5) < 1e-6) | ~(size < 1e9)):
        if np.isfinite(x[i]):
            out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, Context(prec=400))) + 0.0
        else:
            out[i] = x[i]
    return out


def truncated(c: Column) -> Column:
    return c.cast("long")


def overlap(lo_a: str, hi_a: str, lo_b: str, hi_b: str) -> Column:
    """Length that two spans share; negative if they lie apart."""
    return F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b)


def overlapping(boxes: DataFrame, cell: float) -> DataFrame:
    """a, b, ox, oy: boxes (id, minx, maxx, miny, maxy) that overlap on both axes, a < b, and by how much.

    Boxes meet by the grid cells that they touch; a pair counts in the first cell that both touch.
    """
    spans = {k: [F.floor(F.col(f"{e}{k}") / cell) for e in ("min", "max")] for k in "xy"}
    at = boxes.select("id", "minx", "maxx", "miny", "maxy", F.explode(F.sequence(*spans["x"])).alias("cx"), *(s.alias(f"{e}cy") for e, s in zip(("min", "max"), spans["y"])))
    at = at.withColumn("cy", F.explode(F.sequence("mincy", "maxcy"))).drop("mincy", "maxcy")
    left, right = (at.select("cx", "cy", *(F.col(c).alias(f"{p}_{c}") for c in ("id", "minx", "maxx", "miny", "maxy"))) for p in "ab")
    met = left.join(right, ["cx", "cy"]).where("a_id < b_id")
    first = [F.floor(F.greatest(f"a_min{k}", f"b_min{k}") / cell) == F.col(f"c{k}") for k in "xy"]
    span = [overlap(f"a_min{k}", f"a_max{k}", f"b_min{k}", f"b_max{k}").alias(f"o{k}") for k in "xy"]
    return met.where(first[0] & first[1]).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), *span).where("ox > 0 and oy > 0")
