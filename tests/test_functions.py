"""Curves by known sums, axioms of norms and distances, errors, and the registry."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe.functions import curves, matrices, regress, registry, vectors

#: Sums of each curve over 0, 0.5, 1 and -1.
SUMS = {
    "logistic": 2.122459, "tanh": 0.462117, "lecun": 0.551632, "elliot": 0.333333, "hill": 0.447213, "arctan": 0.463647, "gauss": 1.234949, "d_logistic": 0.878227,
    "d_elliot": 1.944444, "d_hill": 2.422648, "d_tanh_lecun": 3.680217, "d_tanh": 2.626396, "d_arctan": 2.8, "dialogistic": 0.251661, "softstep": 0.323637, "multi_logistic": 0.500091,
}


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame([(0.0,), (0.5,), (1.0,), (-1.0,)], "x double")


def build(name):
    for category in ("sigmoid", "bell", "softstep"):
        if name in registry.names(category):
            return registry.get(category, name)
    raise AssertionError(name)


def test_curve_sums(grid):
    row = grid.agg(*(F.sum(build(n)(F.col("x"))).alias(n) for n in SUMS)).first()
    assert {n: row[n] for n in SUMS} == pytest.approx(SUMS, abs=1e-4)


def test_every_curve_has_a_sum():
    assert set(curves.sigmoids()) | set(curves.bells()) | set(curves.softsteps()) == set(SUMS)


def test_sigmoids_rise_and_bells_peak_at_zero(spark):
    df = spark.range(0, 41).select(((F.col("id") - 20) / 2).alias("x"))
    cols = [curves.sigmoid(F.col("x"), n).alias(n) for n in curves.sigmoids()] + [curves.bell(F.col("x"), n).alias(n) for n in curves.bells()]
    table = df.select("x", *cols).toPandas().sort_values("x")
    for n in curves.sigmoids():
        assert (np.diff(table[n]) >= 0).all(), n
    for n in curves.bells():
        assert table.loc[table[n].idxmax(), "x"] == 0, n
        assert (table[n] >= 0).all()


def test_odd_hill_and_unknown_names_raise():
    with pytest.raises(ValueError):
        curves.hill(F.lit(1.0), 3)
    with pytest.raises(ValueError):
        curves.sigmoid(F.lit(1.0), "no such curve")
    with pytest.raises(ValueError):
        registry.register("sigmoid", "tanh")(None)


def test_multi_logistic_is_identity_without_scale(spark):
    assert spark.range(1).select(curves.multi_logistic(F.lit(0.3), 0.0)).first()[0] == 0.3


numbers = st.lists(st.floats(-5, 5), min_size=1, max_size=6)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(x=numbers, a=st.floats(-3, 3))
def test_array_norm_axioms(spark, x, a):
    y = x[::-1]
    df = spark.createDataFrame([(x, y, [a * v for v in x], [u + v for u, v in zip(x, y, strict=True)], [0.0] * len(x))], "x array<double>, y array<double>, ax array<double>, s array<double>, z array<double>")
    names = registry.names("array_norm")
    row = df.select(*(vectors.array_length(F.col(c), n).alias(f"{n} {c}") for n in names for c in ("x", "y", "ax", "s", "z"))).first()
    for n in names:
        assert row[f"{n} z"] == 0
        assert row[f"{n} x"] >= 0
        assert row[f"{n} ax"] == pytest.approx(abs(a) * row[f"{n} x"], abs=1e-9)
        assert row[f"{n} s"] <= row[f"{n} x"] + row[f"{n} y"] + 1e-9


@pytest.mark.parametrize("name", vectors.DISTANCES)
def test_distances_agree_with_numpy_and_each_other(spark, name):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=7), rng.normal(size=7)
    d = np.abs(x - y)
    want = {
        "minkowski": (d**3).sum() ** (1 / 3), "manhattan": d.sum(), "euclid": math.sqrt((d**2).sum()), "chebyshev": d.max(),
        "p-mean": (d**3).mean() ** (1 / 3), "abs-mean": d.mean(), "quadratic-mean": math.sqrt((d**2).mean()),
    }[name]
    kw = {"p": 3} if name in ("minkowski", "p-mean") else {}
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    arrays = spark.createDataFrame([(x.tolist(), y.tolist())], "x array<double>, y array<double>")
    assert rows.agg(vectors.distance(F.col("x"), F.col("y"), name, **kw)).first()[0] == pytest.approx(want)
    assert arrays.select(vectors.array_distance(F.col("x"), F.col("y"), name, **kw)).first()[0] == pytest.approx(want)
    assert arrays.select(vectors.array_distance(F.col("y"), F.col("x"), name, **kw)).first()[0] == pytest.approx(want)


def test_edges_of_array_norms(spark):
    df = spark.createDataFrame([([],), ([1.0, None],), (None,)], "x array<double>")
    assert [r[0] for r in df.select(vectors.array_length(F.col("x"), "euclid")).collect()] == [0.0, None, None]
    assert df.select(vectors.array_length(F.col("x"), "abs-mean")).first()[0] is None
    two = spark.createDataFrame([([1.0], [1.0, 2.0])], "x array<double>, y array<double>")
    with pytest.raises(Exception, match="differ in size"):
        two.select(vectors.array_distance(F.col("x"), F.col("y"))).collect()


def test_matrix_norms(spark):
    a = np.arange(6, dtype=float).reshape(2, 3) - 2
    cells = spark.createDataFrame([(0, i, j, float(a[i, j])) for i in range(2) for j in range(3)], "k int, i int, j int, value double")
    assert matrices.norm(cells, ["k"]).first()["norm"] == pytest.approx(np.linalg.norm(a))
    for p in (1, 2, 3):
        for q in (1, 2, 3):
            want = ((np.abs(a) ** p).sum(axis=0) ** (q / p)).sum() ** (1 / q)
            assert matrices.norm(cells, ["k"], "pq-norm", p=p, q=q).first()["norm"] == pytest.approx(want)
    assert matrices.distance(cells, cells, ["k"]).first()["distance"] == 0
    with pytest.raises(ValueError):
        matrices.frobenius_norm(cells, ["k"], ("i", "i"))


def test_errors(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 1.0)], "x double, y double")
    row = df.agg(*(regress.error(F.col("x"), F.col("y"), n).alias(n) for n in regress.errors())).first().asDict()
    assert row == pytest.approx({"sad": 3, "rss": 5, "mse": 2.5, "mae": 1.5, "rmse": math.sqrt(2.5)})
