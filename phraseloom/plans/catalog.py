"""All named queries of the core and their SQL twins."""

from __future__ import annotations

from phraseloom.plans import checks, index_queries

FLAGSHIP = "phrase_count"
_MODULES = [index_queries, checks]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.SQL.items()}
