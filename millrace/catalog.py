"""Registry of the queries over the driver's tables, and of their DuckDB statements."""

from __future__ import annotations

from millrace.plans import assess, changes, evidence, graphs, memories, relational, retrieval, scope, selection, statistics, text, usage

FLAGSHIP = "bm25_topk"
MODULES = (text, memories, graphs, statistics, usage, evidence, relational, selection, retrieval, scope, changes, assess)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.registry.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.registry.oracles.items()}
