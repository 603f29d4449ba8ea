"""Sigmoid, bell and soft-step curves as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions import registry
from lumenframe.functions.registry import register

#: Fixed values of the scaled hyperbolic tangent and its derivative.
TANH_SCALE, TANH_SLOPE, TANH_DERIVATIVE = 1.7159, 0.6666, 1.14382


def _even(n: int) -> None:
    if n % 2:
        raise ValueError("the exponent of a Hill curve must be even")


@register("sigmoid", "logistic")
def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


@register("sigmoid", "tanh")
def tanh(x: Column) -> Column:
    return F.tanh(x)


@register("sigmoid", "lecun")
def lecun(x: Column) -> Column:
    return TANH_SCALE * F.tanh(TANH_SLOPE * x)


@register("sigmoid", "elliot")
def elliot(x: Column) -> Column:
    return x / (1 + F.abs(x))


@register("sigmoid", "hill")
def hill(x: Column, n: int = 2) -> Column:
    _even(n)
    return x / F.pow(1 + F.pow(x, n), F.lit(1 / n))


@register("sigmoid", "arctan")
def arctan(x: Column) -> Column:
    return F.atan(x)


@register("bell", "gauss")
def gauss(x: Column, mu: float = 0.0, sigma: float = 1.0) -> Column:
    z = (x - mu) / sigma
    return F.exp(-z * z / 2) / (sigma * math.sqrt(2 * math.pi))


@register("bell", "d_logistic")
def d_logistic(x: Column) -> Column:
    return logistic(x) * (1 - logistic(x))


@register("bell", "d_elliot")
def d_elliot(x: Column) -> Column:
    return 1 / F.pow(1 + F.abs(x), 2)


@register("bell", "d_hill")
def d_hill(x: Column, n: int = 2) -> Column:
    _even(n)
    return F.pow(1 + F.pow(x, n), F.lit(-(n + 1) / n))


@register("bell", "d_tanh_lecun")
def d_tanh_lecun(x: Column) -> Column:
    return TANH_DERIVATIVE / F.pow(F.cosh(TANH_SLOPE * x), 2)


@register("bell", "d_tanh")
def d_tanh(x: Column) -> Column:
    return 1 - F.pow(F.tanh(x), 2)


@register("bell", "d_arctan")
def d_arctan(x: Column) -> Column:
    return 1 / (1 + x * x)


@register("softstep", "dialogistic")
def dialogistic(x: Column, scale: float | Column = 1.0, sigma: float = 10.0) -> Column:
    """Two logistic steps at -scale/2 and scale/2, weighted with |x| and brought to 1 at x = scale."""
    s, k = scale if isinstance(scale, Column) else F.lit(float(scale)), max(1e-6, sigma)
    return F.abs(x) * (logistic(k * (x - s / 2)) + logistic(k * (x + s / 2)) - 1) / F.abs(logistic(k * s / 2) + logistic(k * 3 * s / 2) - 1)


@register("softstep", "softstep")
def softstep(x: Column, scale: float = 1.0, sigma: float = 10.0) -> Column:
    return F.tanh(dialogistic(x, scale, sigma)) / math.tanh(scale)


@register("softstep", "multi_logistic")
def multi_logistic(x: Column, scale: float = 1.0, sigma: float = 10.0) -> Column:
    """A staircase of logistic steps of width `scale`; the identity if scale or sigma is 0."""
    if not scale or not sigma:
        return x
    y = x / scale
    low, m = F.floor(y), 2 / (1 / (1 + math.exp(-sigma))) - 1
    step = logistic(sigma * (2 * (y - low) - 1)) / m
    return scale * (low + step)


def sigmoids() -> list[str]:
    return registry.names("sigmoid")


def sigmoid(x: Column, name: str = "logistic", **kwargs: float) -> Column:
    return registry.get("sigmoid", name)(x, **kwargs)


def bells() -> list[str]:
    return registry.names("bell")


def bell(x: Column, name: str = "gauss", **kwargs: float) -> Column:
    return registry.get("bell", name)(x, **kwargs)


def softsteps() -> list[str]:
    return registry.names("softstep")
