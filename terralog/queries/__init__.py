"""Every registered query. Importing this package fills the registry."""

import importlib

from terralog.queries.registry import ORACLE, QUERIES

for _name in ("geometry", "measures", "spatial", "logs", "graph", "spacetime", "places", "decisions", "files", "streams"):
    importlib.import_module(f"terralog.queries.{_name}")

__all__ = ["ORACLE", "QUERIES"]
