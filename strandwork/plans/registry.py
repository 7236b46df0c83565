"""Registry of the runnable queries and their oracle SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Fixtures, duckdb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, **ctes: str):
    """Register `fn(fixtures) -> DataFrame` under `name`, with optional oracle SQL."""

    def wrap(fn: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
        if oracle:
            ORACLES[name] = duckdb(oracle, **ctes)
        return fn

    return wrap


def load() -> None:
    from . import sequence_queries, interval_queries, expression_queries, geneset_queries  # noqa: F401
    from . import name_queries, graph_queries, classify_queries, source_queries  # noqa: F401
