"""Vector norms and distances, over the rows of a group or inside an array column.

Each norm is a pair of builders with one name: `length(x)` is an aggregate over rows, `array_length(x)` a scalar over
an array column. Distances are norms of the difference. Over rows, nulls are left out as in any aggregate; an array
with a null element has a null norm, and an empty array has length 0 (null for means and maximum).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions import registry
from lumenframe.functions.registry import register


def _sum(x: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda total, v: total + f(v.cast("double")))


def _mean(x: Column, f: Callable[[Column], Column]) -> Column:
    return F.when(F.size(x) > 0, _sum(x, f) / F.size(x))


def _root(x: Column, p: float) -> Column:
    return x if p == 1 else F.sqrt(x) if p == 2 else F.pow(x, F.lit(1 / p))


def _power(x: Column, p: float) -> Column:
    return F.abs(x) if p == 1 else x * x if p == 2 else F.pow(F.abs(x), F.lit(float(p)))


@register("vector_norm", "p-norm")
def p_norm(x: Column, p: float = 2) -> Column:
    return _root(F.sum(_power(x, p)), p)


@register("vector_norm", "1-norm")
def one_norm(x: Column) -> Column:
    return F.sum(F.abs(x))


@register("vector_norm", "euclid")
def euclid_norm(x: Column) -> Column:
    return p_norm(x, 2)


@register("vector_norm", "maximum")
def maximum_norm(x: Column) -> Column:
    return F.max(F.abs(x))


@register("vector_norm", "p-mean")
def p_mean(x: Column, p: float = 2) -> Column:
    return _root(F.avg(_power(x, p)), p)


@register("vector_norm", "abs-mean")
def abs_mean(x: Column) -> Column:
    return F.avg(F.abs(x))


@register("vector_norm", "quadratic-mean")
def quadratic_mean(x: Column) -> Column:
    return p_mean(x, 2)


@register("array_norm", "p-norm")
def array_p_norm(x: Column, p: float = 2) -> Column:
    return _root(_sum(x, lambda v: _power(v, p)), p)


@register("array_norm", "1-norm")
def array_one_norm(x: Column) -> Column:
    return _sum(x, F.abs)


@register("array_norm", "euclid")
def array_euclid_norm(x: Column) -> Column:
    return array_p_norm(x, 2)


@register("array_norm", "maximum")
def array_maximum_norm(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))


@register("array_norm", "p-mean")
def array_p_mean(x: Column, p: float = 2) -> Column:
    return _root(_mean(x, lambda v: _power(v, p)), p)


@register("array_norm", "abs-mean")
def array_abs_mean(x: Column) -> Column:
    return _mean(x, F.abs)


@register("array_norm", "quadratic-mean")
def array_quadratic_mean(x: Column) -> Column:
    return array_p_mean(x, 2)


#: Norm behind each distance.
DISTANCES = {
    "minkowski": "p-norm",
    "manhattan": "1-norm",
    "euclid": "euclid",
    "chebyshev": "maximum",
    "p-mean": "p-mean",
    "abs-mean": "abs-mean",
    "quadratic-mean": "quadratic-mean",
}

for _name, _norm in DISTANCES.items():
    register("vector_distance", _name)(lambda x, y, _norm=_norm, **kw: registry.get("vector_norm", _norm)(x - y, **kw))
    register("array_distance", _name)(lambda x, y, _norm=_norm, **kw: array_length(difference(x, y), _norm, **kw))


def difference(x: Column, y: Column) -> Column:
    """Elementwise x - y; arrays of different size raise."""
    same = F.zip_with(x, y, lambda a, b: a.cast("double") - b.cast("double"))
    return F.when(x.isNull() | y.isNull(), F.lit(None)).when(F.size(x) == F.size(y), same).otherwise(F.raise_error(F.lit("arrays differ in size")))


def norms() -> list[str]:
    return registry.names("vector_norm")


def length(x: Column, norm: str = "euclid", **kwargs: float) -> Column:
    """Aggregate: norm of a column over the rows of each group."""
    return registry.get("vector_norm", norm)(x, **kwargs)


def array_length(x: Column, norm: str = "euclid", **kwargs: float) -> Column:
    """Scalar: norm of an array column."""
    return registry.get("array_norm", norm)(x, **kwargs)


def distances() -> list[str]:
    return registry.names("vector_distance")


def distance(x: Column, y: Column, name: str = "euclid", **kwargs: float) -> Column:
    return registry.get("vector_distance", name)(x, y, **kwargs)


def array_distance(x: Column, y: Column, name: str = "euclid", **kwargs: float) -> Column:
    return registry.get("array_distance", name)(x, y, **kwargs)
