"""Covariance, correlation, principal components, histograms and rank slices.

Matrices leave as long tables (src, tgt, value). All pairs of a matrix come from one aggregate over one scan; only the
d x d matrix of a decomposition reaches the driver. Nulls are left out pairwise, as in SQL.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.registry import register


def _pairs(df: DataFrame, columns: list[str], f) -> DataFrame:
    """One row per ordered pair of columns. The aggregate holds the upper triangle only."""
    upper = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*(f(a, b).alias(f"v{k}") for k, (a, b) in enumerate(upper)))
    cells = []
    for k, (a, b) in enumerate(upper):
        for s, t in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(s).alias("src"), F.lit(t).alias("tgt"), F.col(f"v{k}").alias("value")))
    return row.select(F.inline(F.array(*cells)))


@register("statistic", "covariance")
def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sample covariance of all pairs."""
    return _pairs(df, columns, lambda a, b: F.covar_samp(a, b))


@register("statistic", "correlation")
def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of all pairs."""
    return _pairs(df, columns, lambda a, b: F.corr(a, b))


def to_matrix(cells: DataFrame, columns: list[str]) -> np.ndarray:
    """The d x d matrix of a long table over these columns."""
    at = {c: i for i, c in enumerate(columns)}
    out = np.full((len(columns), len(columns)), np.nan)
    for src, tgt, value in cells.select("src", "tgt", "value").collect():  # d * d rows
        out[at[src], at[tgt]] = value
    return out


def components(df: DataFrame, columns: list[str], k: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (d x k) of the covariance, by falling absolute eigenvalue; k is at most d.

    The component of a vector with the largest magnitude is positive.
    """
    values, vectors = np.linalg.eigh(to_matrix(covariance(df, columns), columns))
    order = np.argsort(-np.abs(values), kind="stable")[: min(k, len(columns))]
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values[order], vectors * np.where(signs == 0, 1, signs)


def _linear(columns: list[str], weights: np.ndarray) -> Column:
    total: Column = F.lit(0.0)
    for c, w in zip(columns, weights, strict=True):
        total = total + F.col(c) * float(w)
    return total


@register("statistic", "pca-sample")
def pca_sample(df: DataFrame, columns: list[str], k: int = 2, embed: bool = False) -> DataFrame:
    """Projection of the (uncentred) columns on k components: pc1... or, embedded, back in the space of the columns."""
    _, p = components(df, columns, k)
    others = [c for c in df.columns if c not in columns]
    if embed:
        back = p @ p.T
        return df.select(*others, *(_linear(columns, back[:, j]).alias(c) for j, c in enumerate(columns)))
    return df.select(*others, *(_linear(columns, p[:, j]).alias(f"pc{j + 1}") for j in range(p.shape[1])))


def _k_covariance(df: DataFrame, columns: list[str], k: int) -> np.ndarray:
    _, p = components(df, columns, k)
    project = p @ p.T
    return project @ to_matrix(covariance(df, columns), columns) @ project


def from_matrix(spark, matrix: np.ndarray, columns: list[str]) -> DataFrame:
    cells = [(a, b, float(matrix[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return spark.createDataFrame(cells, "src string, tgt string, value double")


@register("statistic", "k-covariance")
def k_covariance(df: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """Covariance of the embedded projection, in closed form."""
    return from_matrix(df.sparkSession, _k_covariance(df, columns, k), columns)


@register("statistic", "k-correlation")
def k_correlation(df: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    c = _k_covariance(df, columns, k)
    spread = np.sqrt(np.diag(c))
    return from_matrix(df.sparkSession, c / np.outer(spread, spread), columns)


@register("statistic", "histogram")
def histogram(df: DataFrame, value: Column, bins: int = 100) -> DataFrame:
    """(bin, lo, hi, n) of equal-width bins between the extremes; the last bin includes the maximum.

    Only bins with values are listed. Nulls are left out.
    """
    rows = df.select(value.cast("double").alias("x")).where("x IS NOT NULL")
    ends = rows.agg(F.min("x").alias("a"), F.max("x").alias("b"))  # one row: its broadcast is 16 bytes
    width = (F.col("b") - F.col("a")) / bins
    at = F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col("x") - F.col("a")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("long")
    counted = rows.join(F.broadcast(ends), how="cross").groupBy(at.alias("bin"), "a", "b").agg(F.count("*").alias("n"))
    return counted.select("bin", (F.col("a") + F.col("bin") * width).alias("lo"), (F.col("a") + (F.col("bin") + 1) * width).alias("hi"), "n")


#: Buckets that a range of values is cut into, and rows of a range whose values are counted one by one.
BUCKETS, FEW = 1024, 4096


@dataclass(frozen=True)
class Ranked:
    """A value at a rank, with the lowest rank and the number of the rows that have it."""

    rank: int
    value: float
    first: int
    held: int


def _pairs_of(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns))
    return df.select(F.inline(cells)).where("x IS NOT NULL")


def select_ranks(df: DataFrame, columns: list[str], wanted: Callable[[int], list[int]]) -> dict[str, tuple[int, list[Ranked]]]:
    """For each column its number of values, and what stands at the ranks (from 0) that `wanted` gives for that number.

    No column is sorted or shuffled. A scan counts the values of all ranges that hold a wanted rank in BUCKETS buckets of
    equal width, each with its extremes; the bucket with the rank is the next range, until it holds FEW rows, whose
    values are counted. Infinite values and NaN come before and after all others, and are counted in the first scan.
    """
    order = F.expr("CASE WHEN x = -double('inf') THEN 0 WHEN isnan(x) THEN 3 WHEN x = double('inf') THEN 2 ELSE 1 END")
    kinds = _pairs_of(df, columns).groupBy("name", order.alias("kind")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    totals: dict[str, int] = {c: 0 for c in columns}
    found: dict[str, list[Ranked]] = {c: [] for c in columns}
    open_ranges: list[tuple[str, float, float, int, int, list[int]]] = []  # name, least, largest, first rank, rows, ranks

    def put(name: str, lo: float, hi: float, first: int, n: int, ranks: list[int]) -> None:
        inside = [r for r in ranks if first <= r < first + n]
        if inside and (lo == hi or lo != lo):
            found[name] += [Ranked(r, lo, first, n) for r in inside]
        elif inside:
            open_ranges.append((name, lo, hi, first, n, inside))

    for c in columns:
        own = sorted((r for r in kinds if r["name"] == c), key=lambda r: r["kind"])
        totals[c] = sum(r["n"] for r in own)
        ranks, first = (sorted(set(wanted(totals[c]))) if own else []), 0
        for r in own:
            put(c, r["lo"], r["hi"], first, r["n"], ranks)
            first += r["n"]
    while open_ranges:
        asked, open_ranges = open_ranges, []
        table = df.sparkSession.createDataFrame([(k, a[0], a[1], a[2], a[4] <= FEW) for k, a in enumerate(asked)], "k int, name string, lo double, hi double, few boolean")
        rows = _pairs_of(df, sorted({a[0] for a in asked})).join(F.broadcast(table), "name").where("x BETWEEN lo AND hi AND NOT isnan(x)")  # a row for each wanted rank at most
        at = F.least(F.floor((F.col("x") / 4 - F.col("lo") / 4) / (F.col("hi") / 4 - F.col("lo") / 4) * BUCKETS), F.lit(BUCKETS - 1))
        counts = rows.groupBy("k", F.when(~F.col("few"), at).alias("bucket"), F.when(F.col("few"), F.col("x")).alias("v")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        by_range: dict[int, list] = {}
        for r in counts:
            by_range.setdefault(r["k"], []).append(r)
        for k, (name, _, _, first, _, ranks) in enumerate(asked):
            for r in sorted(by_range[k], key=lambda r: r["lo"]):
                put(name, r["lo"], r["hi"], first, r["n"], ranks)
                first += r["n"]
    return {c: (totals[c], sorted(found[c], key=lambda r: r.rank)) for c in columns}


def _slice_means(df: DataFrame, ends: dict[str, tuple[int, int, Ranked, Ranked]]) -> dict[str, float]:
    """Mean of the sorted values with ranks from lo to before hi of each column; ends has what stands at lo and hi - 1."""
    if not ends:
        return {}
    cells = []
    for c, (_, _, a, b) in ends.items():
        x = F.col(f"`{c}`").cast("double")
        within = (x > a.value) & (x < b.value)
        cells.append(F.struct(F.lit(c).alias("name"), F.coalesce(F.sum(F.when(within, x)), F.lit(0.0)).alias("total")))
    sums = {r["name"]: r["total"] for r in df.agg(F.array(*cells).alias("m")).select(F.inline("m")).collect()}
    out = {}
    for c, (lo, hi, a, b) in ends.items():
        if a.first == b.first:
            out[c] = a.value
        else:
            out[c] = (sums[c] + a.value * (a.first + a.held - lo) + b.value * (hi - b.first)) / (hi - lo)
    return out


def _means_between(df: DataFrame, columns: list[str], bounds: Callable[[int], tuple[int, int]], value: str) -> DataFrame:
    """(name, value): means of the sorted values in the ranks that `bounds` gives for the number of values."""
    found = select_ranks(df, columns, lambda n: [bounds(n)[0], bounds(n)[1] - 1])
    ends = {}
    for c, (n, ranked) in found.items():
        if ranked:
            lo, hi = bounds(n)
            at = {r.rank: r for r in ranked}
            ends[c] = (lo, hi, at[lo], at[hi - 1])
    return df.sparkSession.createDataFrame(list(_slice_means(df, ends).items()), f"name string, {value} double")


@register("statistic", "rank-quantile")
def rank_quantile(df: DataFrame, columns: list[str], p: float = 0.5) -> DataFrame:
    """(name, threshold): mean of the sorted values with rank in [r - h, r + h), r = int((1 - p) n), h = int(0.1 p n).

    A slice without rows (h = 0) takes the value of rank r; ranks beyond the ends are left out. Ties need no order:
    equal values weigh by how many of their ranks lie in the slice.
    """

    def bounds(n: int) -> tuple[int, int]:
        r, h = math.floor((1 - p) * n), math.floor(0.1 * p * n)
        lo, hi = (r - h, r + h) if h > 0 else (r, r + 1)
        lo = min(max(lo, 0), n - 1)
        return lo, max(min(hi, n), lo + 1)

    return _means_between(df, columns, bounds, "threshold")


@register("statistic", "representatives")
def representatives(df: DataFrame, columns: list[str], points: int = 10) -> DataFrame:
    """(name, point, x): the value of each sorted column at index int((point + .5) * int(n / points))."""
    at = lambda n: [math.floor((k + 0.5) * math.floor(n / points)) for k in range(points)]
    rows = []
    for c, (n, ranked) in select_ranks(df, columns, at).items():
        value = {r.rank: r.value for r in ranked}
        rows += [(c, k, value[r]) for k, r in enumerate(at(n)) if r in value]
    return df.sparkSession.createDataFrame(rows, "name string, point int, x double")


@register("statistic", "top-mean")
def top_mean(df: DataFrame, columns: list[str], fraction: float) -> DataFrame:
    """(name, value): mean of the values of rank int((1 - fraction) n) and above."""
    return _means_between(df, columns, lambda n: (min(math.floor((1 - fraction) * n), n - 1), n), "value")


@register("statistic", "relation-statistics")
def relation_statistics(cells: DataFrame) -> DataFrame:
    """max, min, mean and population deviation over the pairs of different units."""
    return cells.where("src <> tgt").agg(F.max("value").alias("max"), F.min("value").alias("min"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


@register("statistic", "column-moments")
def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, mean, std, var, lo, hi): population moments and extremes of every column, in one scan."""
    cells = [F.struct(F.lit(c).alias("name"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.var_pop(c).alias("var"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")) for c in columns]
    return df.agg(F.array(*cells).alias("m")).select(F.inline("m"))


@register("predicate", "binary")
def test_binary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(ok): whether all values are 0 or 1; true for no rows."""
    return df.agg(F.coalesce(F.bool_and(_all([F.col(c).isin(0, 1) for c in columns])), F.lit(True)).alias("ok"))


@register("predicate", "gauss")
def test_gauss(df: DataFrame, columns: list[str], mu: float = 0.0, sigma: float = 1.0, delta: float = 0.05) -> DataFrame:
    """(ok): whether every column has mean mu and population deviation sigma, up to delta."""
    near = [(F.abs(F.avg(c) - mu) < delta) & (F.abs(F.stddev_pop(c) - sigma) < delta) for c in columns]
    return df.agg(F.coalesce(_all(near), F.lit(False)).alias("ok"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
