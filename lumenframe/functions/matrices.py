"""Matrix norms and distances on long tables (keys..., i, j, value): one row per cell, any number of matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import registry
from lumenframe.functions.registry import register


@register("matrix_norm", "pq-norm")
def pq_norm(cells: DataFrame, keys: list[str], p: float = 2, q: float = 2, axes: tuple[str, str] = ("i", "j")) -> DataFrame:
    """(sum over axes[1] of (sum over axes[0] of |value| ** p) ** (q / p)) ** (1 / q)."""
    if axes[0] == axes[1]:
        raise ValueError("the axes of a matrix norm must differ")
    inner = cells.groupBy(*keys, axes[1]).agg(F.sum(F.pow(F.abs("value"), F.lit(float(p)))).alias("s"))
    outer = F.pow(F.sum(F.pow("s", F.lit(q / p))), F.lit(1 / q)).alias("norm")
    return inner.groupBy(*keys).agg(outer)


@register("matrix_norm", "frobenius")
def frobenius_norm(cells: DataFrame, keys: list[str], axes: tuple[str, str] = ("i", "j")) -> DataFrame:
    if axes[0] == axes[1]:
        raise ValueError("the axes of a matrix norm must differ")
    return cells.groupBy(*keys).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


def cell_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of a - b. A cell that only one of them has counts as missing in both, since shapes then differ."""
    on = [*keys, "i", "j"]
    return a.select(*on, F.col("value").alias("x")).join(b.select(*on, F.col("value").alias("y")), on).select(*on, (F.col("x") - F.col("y")).alias("value"))


@register("matrix_distance", "frobenius")
def frobenius_distance(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return frobenius_norm(cell_difference(a, b, keys), keys).withColumnRenamed("norm", "distance")


@register("matrix_distance", "pq-distance")
def pq_distance(a: DataFrame, b: DataFrame, keys: list[str], p: float = 2, q: float = 2) -> DataFrame:
    return pq_norm(cell_difference(a, b, keys), keys, p, q).withColumnRenamed("norm", "distance")


def norms() -> list[str]:
    return registry.names("matrix_norm")


def norm(cells: DataFrame, keys: list[str], name: str = "frobenius", **kwargs: float) -> DataFrame:
    return registry.get("matrix_norm", name)(cells, keys, **kwargs)


def distances() -> list[str]:
    return registry.names("matrix_distance")


def distance(a: DataFrame, b: DataFrame, keys: list[str], name: str = "frobenius", **kwargs: float) -> DataFrame:
    return registry.get("matrix_distance", name)(a, b, keys, **kwargs)
