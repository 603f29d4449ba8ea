"""Regression errors as aggregates over rows of (x, y)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions import registry
from lumenframe.functions.registry import register


@register("error", "sad")
def sad(x: Column, y: Column) -> Column:
    return F.sum(F.abs(x - y))


@register("error", "rss")
def rss(x: Column, y: Column) -> Column:
    return F.sum((x - y) * (x - y))


@register("error", "mse")
def mse(x: Column, y: Column) -> Column:
    return F.avg((x - y) * (x - y))


@register("error", "mae")
def mae(x: Column, y: Column) -> Column:
    return F.avg(F.abs(x - y))


@register("error", "rmse")
def rmse(x: Column, y: Column) -> Column:
    return F.sqrt(mse(x, y))


def errors() -> list[str]:
    return registry.names("error")


def error(x: Column, y: Column, name: str = "mse") -> Column:
    return registry.get("error", name)(x, y)
