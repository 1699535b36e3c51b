"""Queries of the mapping engine and their oracle SQL."""

from __future__ import annotations

from ..shipping import shipped

from . import queries as _queries

MODULES = (_queries,)


def queries() -> dict:
    return {k: shipped(f) for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
