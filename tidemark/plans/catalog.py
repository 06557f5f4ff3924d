"""All registered queries and their SQL."""

from __future__ import annotations

from tidemark.plans import (
    aggregate_queries,
    check_queries,
    fleet,
    output_queries,
    projection_queries,
    source_queries,
    stream_queries,
    window_queries,
)

_MODULES = (fleet, window_queries, aggregate_queries, projection_queries, source_queries, output_queries, check_queries,
            stream_queries)


def queries() -> dict:
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
