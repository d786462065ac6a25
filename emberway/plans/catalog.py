"""Queries by name, and the SQL that each is held against.

A name begins with the survey's id of the operator that the query applies to the driver's tables.
"""

from __future__ import annotations

from emberway.plans import building, containment, extensions, fires, graphs, io, meshes, served
from emberway.plans._registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "building", "containment", "extensions", "fires", "graphs", "io", "meshes", "served"]
