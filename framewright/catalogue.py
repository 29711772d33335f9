"""All registered queries of the library proper, and the SQL that each is held against."""

from __future__ import annotations

import importlib

from framewright.registry import ORACLE, QUERIES

MODULES = ("groups", "sequences", "quality", "stencil", "components", "polyline", "matching", "raster", "scalars", "documents", "metrics", "tracks", "sources_queries", "vectorize", "stylize", "crop")

for _name in MODULES:
    importlib.import_module(f"framewright.plans.{_name}")

__all__ = ["ORACLE", "QUERIES"]
