"""Registered queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if it has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from siftwork.plans import claims, formats, graph, library, lists, relational, search, state, text, views  # noqa: F401


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search over documents: tokens, BM25, a language filter, top 20."""
    _load()
    return QUERIES["search_bm25_top20"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
