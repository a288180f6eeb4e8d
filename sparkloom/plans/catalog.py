"""Registry of the library's own queries: name -> callable, name -> DuckDB SQL."""

from __future__ import annotations

from sparkloom.plans import graph_queries, memory_queries, text_queries  # noqa: F401 - they register their queries
from sparkloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
