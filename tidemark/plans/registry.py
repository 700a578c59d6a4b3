"""Registered queries: each runs a library operator over the derived estate, whole tables always."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.estate import Estate, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **views: str) -> Callable:
    """Register `fn(estate)` under `name`, with the DuckDB text that must give the same rows."""

    def register(fn: Callable[[Estate], DataFrame]) -> Callable[[Estate], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Estate(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql, **views)
        return fn

    return register
