"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from . import queries_dedup, queries_models, queries_output, queries_text

_MODULES = (queries_dedup, queries_models, queries_output, queries_text)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
