"""All queries of the library outside the training-data subpackage, with their oracles."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("retrieval", "text", "compute", "tree", "structure", "views", "tools", "scoring", "lookup", "plans", "events", "search", "nodes", "catalogs")
QUERIES: dict = {}
ORACLES: dict = {}
for _name in FAMILIES:
    _family = import_module(f"docloom.queries.{_name}").FAMILY
    QUERIES |= _family.queries
    ORACLES |= _family.oracles
