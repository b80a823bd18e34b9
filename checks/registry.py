"""Registry of queries with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers `function(tables) -> DataFrame` under `name`."""
    def add(function: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return function
    return add
