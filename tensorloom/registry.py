"""All queries of the library's own operators and their SQL."""

from __future__ import annotations

from .queries import more, plans, relations, tensors

_MODULES: tuple = (tensors, relations, plans, more)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
