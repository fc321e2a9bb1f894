"""Names of the engine's queries, their callables and their oracle SQL, filled in by the query modules."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}

for _m in ("text_queries", "graph_queries", "memory_queries", "eval_queries", "extension_queries", "name_queries", "find_queries", "link_queries", "closure_queries", "incremental_queries", "build_queries"):
    importlib.import_module(f"tarnwell.plans.{_m}")
