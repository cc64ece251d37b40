"""The registered queries of this package: one for each operator, over its whole table."""

from __future__ import annotations

import importlib

#: Modules with operator queries; each has QUERIES (name -> callable) and ORACLES (name -> SQL).
MODULES = ["token_queries", "dedup_queries", "html_queries", "langid_queries", "near_queries", "lm_queries", "vector_queries", "manifest_queries", "quality_queries"]


def load() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"coinweave.llm.{name}")
        queries.update(module.QUERIES)
        oracles.update(module.ORACLES)
    return queries, oracles
