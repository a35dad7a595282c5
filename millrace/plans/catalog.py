"""Registry of the library's queries and their DuckDB twins.

Each module of ``millrace.plans`` registers queries named after the operators they apply; importing this
module loads them all.
"""

from __future__ import annotations

from importlib import import_module

from millrace.plans.registry import ORACLE_SQL, QUERIES

for _name in ("text", "dedup", "retrieval", "web", "telemetry", "graph", "relational", "window", "rag", "page", "recovery", "slo"):
    import_module(f"millrace.plans.{_name}_queries")

__all__ = ["ORACLE_SQL", "QUERIES"]
