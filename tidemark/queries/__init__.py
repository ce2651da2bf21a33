"""Registered queries: each a Spark plan, most with the SQL that checks it."""

from __future__ import annotations

from . import aggregates, extra, functions, more, relational, series, streams, temporal, values, windows

MODULES = (temporal, relational, aggregates, windows, functions, more, extra, values, series, streams)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.REGISTRY.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.REGISTRY.sql.items()}
