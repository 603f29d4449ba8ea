"""Registered queries of the library's own operators over the supplied tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenframe.queries import algorithms, data, functions, graphs, models, stores
from lumenframe.session import ship

Query = Callable[[SparkSession, str], DataFrame]
_PARTS = (algorithms, data, functions, graphs, models, stores)

FLAGSHIP: Query = data.st_corr


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for part in _PARTS:
        found |= part.queries()

    def shipped(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {name: shipped(f) for name, f in found.items()}


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for part in _PARTS:
        found |= part.oracle_sql()
    return found
