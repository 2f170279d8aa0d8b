"""Registered queries: each reads the given tables and has an SQL counterpart where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowloom.plans.fixtures import for_duckdb

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = for_duckdb(sql)
        return run

    return register


def load_all() -> None:
    from rowloom.plans import datasets, evaluation, registry, sampling, templates  # noqa: F401
