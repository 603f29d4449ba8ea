"""Tables and roundings that the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
#: Numeric columns of lineitem, and a key of its rows.
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, -0 made 0."""
    return df.select(*((F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes))


def draw_sql(key: str, seed: int | str, i: int = 0) -> str:
    """SQL for the even draw that a key (SQL for its text), a seed and a number fix."""
    return f"((('0x' || substr(md5({key} || '|{seed}|{i}'), 1, 13))::BIGINT + 5e-1) / 4503599627370496e0)"


def normal_sql(key: str, seed: int | str) -> str:
    return f"(sqrt(-2e0 * ln({draw_sql(key, seed)})) * cos(2e0 * pi() * {draw_sql(key, seed, 1)}))"


class Registry:
    """Queries of a module, by decorator, each with its SQL."""

    def __init__(self) -> None:
        self.found: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        self.found[name] = query
        if sql:
            self.sql[name] = sql

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.add(f.__name__, f, sql)
            return f

        return put
