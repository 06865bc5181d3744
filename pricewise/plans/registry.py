"""Query registry: name -> (Spark builder, DuckDB oracle text or None).

Every registered query reads whole canonical tables (derived from the driver's tables) so
its work grows with the data.  Oracle text is written against the canonical table names;
``with_tables`` prefixes the CTEs that build them from the raw tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.canonical import with_tables

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its (optional) DuckDB oracle."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn
    return deco


def _load_all() -> None:
    from . import (q_aggregates, q_filters, q_forecast, q_joins, q_models, q_paging,  # noqa: F401
                   q_quality, q_scalars, q_series, q_sources)


def all_queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _load_all()
    return {k: with_tables(v) for k, v in _ORACLES.items()}
