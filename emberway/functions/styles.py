"""Colours and opacities of what a viewer shows, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COLD, HOT = 20.0, 120.0  #: the ends of the temperature ramp, in degrees
# Ends of the ramp's four segments, red, green and blue from 0 to 1.
RAMP = ((0.0, 0.0, 1.0), (0.0, 1.0, 1.0), (0.0, 1.0, 0.0), (1.0, 1.0, 0.0), (1.0, 0.0, 0.0))
DEFAULT_OPACITY = 0.6


def temperature_rgb(t: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of a temperature, clamped to the ramp: blue, cyan, green, yellow, red."""
    n = (F.least(F.greatest(t, F.lit(COLD)), F.lit(HOT)) - COLD) / (HOT - COLD)
    at = n * (len(RAMP) - 1)
    out = []
    for k in range(3):
        c = F.lit(RAMP[-1][k])
        for i in reversed(range(len(RAMP) - 1)):
            lo, hi = RAMP[i][k], RAMP[i + 1][k]
            c = F.when(at <= i + 1, lo + (hi - lo) * (at - i)).otherwise(c)
        out.append(c)
    return tuple(out)


def hex_color(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of components from 0 to 255."""
    return F.format_string("#%02x%02x%02x", *(F.least(F.greatest(c, F.lit(0)), F.lit(255)).cast("int") for c in (r, g, b)))


def unit_components(c: Column) -> Column:
    """An array of colour components in 0 to 1: if any is above 1 in size, all are out of 255."""
    return F.when(F.exists(c, lambda x: F.abs(x) > 1), F.transform(c, lambda x: x / 255.0)).otherwise(c)


def opacity(*sources: Column) -> Column:
    """The first source that is given, else DEFAULT_OPACITY, clamped to 0 and 1."""
    return F.least(F.greatest(F.coalesce(*sources, F.lit(DEFAULT_OPACITY)), F.lit(0.0)), F.lit(1.0))


def edge_state(on_path: Column, burning: Column) -> Column:
    """An edge on the path is shown as such even where it burns."""
    return F.when(on_path, "path").when(burning, "fire").otherwise("base")


def vertex_state(on_path: Column, burning: Column) -> Column:
    """A burning vertex is shown as such even on the path."""
    return F.when(burning, "fire").when(on_path, "path").otherwise("base")
