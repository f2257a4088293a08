"""Registry of the named queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under its own or the given name."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if oracle is not None:
            ORACLES[key] = oracle
        return f

    return register
