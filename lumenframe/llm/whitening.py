"""Whitening of embeddings from a compensated covariance.

Entries become whole numbers x, so counts, sums and squared deviations are exact. The covariance is of centred rows:
every task takes the mean (held in two doubles) off its rows and adds up their outer products in double-double, with
error-free sums and products; high and low parts are merged across tasks in the same arithmetic, in one stream for each
row of the matrix. The matrix, a model parameter of d x d numbers, is solved on the driver by `numpy.linalg.eigh`
(reduction to tridiagonal form, then divide and conquer), and two refinement steps in extended precision against high
and low parts make the vectors as exact as doubles are.

Defined cases: vectors that are null or hold a null, NaN or infinite entry are left out, as are those with an entry
whose x leaves +-2**52 (no double tells its neighbours apart) and those whose length is not the most frequent one (of
equally frequent lengths the longest); null and repeated ids keep a row each; components without variance cannot be
scaled and are left out, so one vector, equal vectors or an empty table give no rows; a deviation beyond 64 bits is
null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import materialize

SCALE, SHIFT = 64, 1_000_000
LARGEST = 2**52
#: Rows whose products are summed in a tree before they are added to the totals.
BLOCK = 256
PART = "i int, high array<double>, low array<double>, n long"

Pair = tuple[np.ndarray, np.ndarray]

# ---------------------------------------------------------------- double-double arithmetic


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b as the rounded sum and its error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a: np.ndarray) -> Pair:
    """a as a sum of two numbers of 26 bits."""
    c = a * 134217729.0
    high = c - (c - a)
    return high, a - high


def add(a: Pair, b: Pair) -> Pair:
    s, e = two_sum(a[0], b[0])
    e = e + (a[1] + b[1])
    high = s + e
    return high, e - (high - s)


def total(a: Pair) -> Pair:
    """Sum over the first axis, halving it."""
    high, low = a
    while len(high) > 1:
        if len(high) % 2:
            high, low = (np.concatenate((x, np.zeros_like(x[:1]))) for x in (high, low))
        m = len(high) // 2
        high, low = add((high[:m], low[:m]), (high[m:], low[m:]))
    return high[0], low[0]


def centred(x: np.ndarray, mean: Pair) -> Pair:
    """x less the mean."""
    high, error = two_sum(x, -mean[0])
    return two_sum(high, error - mean[1])


class Outer:
    """Sums of the upper triangle of outer products of rows."""

    def __init__(self, d: int):
        self.n, self.parts = 0, [(np.zeros(d - i), np.zeros(d - i)) for i in range(d)]

    def put(self, rows: Pair) -> None:
        self.n += len(rows[0])
        for at in range(0, len(rows[0]), BLOCK):
            y, z = rows[0][at : at + BLOCK], rows[1][at : at + BLOCK]
            h, k = halves(y)
            for i in range(y.shape[1]):
                a, ah, ak, az = (v[:, i : i + 1] for v in (y, h, k, z))
                b, bh, bk, bz = (v[:, i:] for v in (y, h, k, z))
                p = a * b
                e = ((ah * bh - p) + ah * bk + ak * bh) + ak * bk
                e += a * bz + az * b
                self.parts[i] = add(self.parts[i], total((p, e)))


def _matrix(batch: pa.RecordBatch, column: str, d: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _as_rows(parts: list[tuple[int, Pair, int]]) -> pa.RecordBatch:
    arrays = lambda k: pa.array([p[k].tolist() for _, p, _ in parts], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in parts], pa.int32()), arrays(0), arrays(1), pa.array([n for _, _, n in parts], pa.int64())], names=["i", "high", "low", "n"])


def _outer(batches: Iterator[pa.RecordBatch], d: int, mean: Pair) -> Iterator[pa.RecordBatch]:
    made = Outer(d)
    for batch in batches:
        made.put(centred(_matrix(batch, "v", d).astype(np.float64), mean))
    if made.n:
        yield _as_rows([(i, p, made.n) for i, p in enumerate(made.parts)])


def _plain(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    made, n = (np.zeros(d), np.zeros(d)), 0
    for batch in batches:
        v = _matrix(batch, "v", d).astype(np.float64)
        if len(v):
            made, n = add(made, total((v, np.zeros_like(v)))), n + len(v)
    if n:
        yield _as_rows([(0, made, n)])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of equal i follow each other; one of them is held at a time."""
    held: tuple[int, Pair, int] | None = None
    for batch in batches:
        for i, high, low, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            part = (np.array(high), np.array(low))
            if held and held[0] == i:
                held = (i, add(held[1], part), held[2] + n)
            else:
                if held:
                    yield _as_rows([held])
                held = (i, part, n)
    if held:
        yield _as_rows([held])


def _merged(parts: DataFrame) -> list:
    """Sums of the parts of all tasks, by i: d rows at most."""
    return parts.repartition("i").sortWithinPartitions("i", "high", "low").mapInArrow(_merge, PART).orderBy("i").collect()


def mean_of(rows: DataFrame, d: int) -> tuple[Pair, int]:
    """Mean of the arrays `v`, in two doubles, and their number."""
    made = _merged(rows.select("v").mapInArrow(lambda b: _plain(b, d), PART))
    if not made:
        return (np.zeros(d), np.zeros(d)), 0
    n = made[0]["n"]
    exact = [(Fraction(h) + Fraction(k)) / n for h, k in zip(made[0]["high"], made[0]["low"], strict=True)]
    return two_doubles(exact), n


def two_doubles(exact: list[Fraction]) -> Pair:
    high = np.array([float(x) for x in exact])
    return high, np.array([float(x - Fraction(h)) for x, h in zip(exact, high.tolist(), strict=True)])


def covariance(rows: DataFrame, d: int, mean: Pair) -> Pair:
    """Covariance (divisor n) of the arrays `v` around a mean, in two doubles."""
    high, low = np.zeros((d, d)), np.zeros((d, d))
    for r in _merged(rows.select("v").mapInArrow(lambda b: _outer(b, d, mean), PART)):
        i, n = r["i"], r["n"]
        for j, x in enumerate(zip(r["high"], r["low"], strict=True), i):
            q = (Fraction(x[0]) + Fraction(x[1])) / n
            high[i, j] = high[j, i] = float(q)
            low[i, j] = low[j, i] = float(q - Fraction(high[i, j]))
    return high, low


# ---------------------------------------------------------------- eigenvectors


def components(cov: Pair) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors as columns; the largest entry of each is positive."""
    a = cov[0].astype(np.longdouble) + cov[1].astype(np.longdouble)
    values, start = np.linalg.eigh(cov[0])
    x = start.astype(np.longdouble)
    one = np.eye(len(x), dtype=np.longdouble)
    for _ in range(2):
        r = one - x.T @ x
        s = x.T @ a @ x
        value = np.diag(s) / (1 - np.diag(r))
        gap = value[None, :] - value[:, None]
        near = np.abs(gap) <= 1e-13 * np.abs(value).max(initial=0)
        x = x + x @ np.where(near, r / 2, (s + value[None, :] * r) / np.where(near, 1, gap))
    x = x @ (3 * one - x.T @ x) / 2  # vectors of equal eigenvalues at right angles
    value = np.diag(x.T @ a @ x) / np.diag(x.T @ x)
    order = np.argsort(-value, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    x = x * np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(x))])
    return value[order].astype(np.float64), x.astype(np.float64)


# ---------------------------------------------------------------- whitening


@dataclass
class Whitener:
    """Exact sums of x over n rows, and the components that are kept."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray


def whole_vectors(df: DataFrame, vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """The usable rows of df with x as the array of longs `v`, and its length."""
    v, c = F.col(vector_col), "cast(c as double)"
    fine = F.expr(f"`{vector_col}` is not null and size(`{vector_col}`) > 0 and forall(`{vector_col}`, c -> coalesce(abs({c} * {SCALE}) < {LARGEST}D - {SHIFT}D, false) and not isnan({c}))")
    rows = df.where(fine)
    most = rows.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = most["d"] if most else 0
    return rows.where(F.size(v) == d).withColumn("v", F.expr(f"transform(`{vector_col}`, c -> floor({c} * {SCALE}) + {SHIFT}L)")), d


def _sums(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
    for batch in batches:
        x = _matrix(batch, "v", d)
        n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(high), pa.array(low), pa.array([n] * d, pa.int64())], names=["i", "high", "low", "n"])


def exact_sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of the arrays of longs `v`, and the exact sum of each entry."""
    parts = rows.select("v").mapInArrow(lambda b: _sums(b, d), "i int, high long, low long, n long")
    made = parts.groupBy("i").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n"))).orderBy("i").collect()
    return (int(made[0]["n"]) if made else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in made]


def fit(rows: DataFrame, d: int, most: int = 32) -> Whitener:
    """The components of the covariance of x, at most `most`, from rows of whole_vectors."""
    n, sums = exact_sums(rows, d) if d else (0, [])
    if not n:
        return Whitener(0, sums, np.zeros(0), np.zeros((d, 0)), np.zeros(0))
    cov = covariance(rows, d, two_doubles([Fraction(s, n) for s in sums]))
    values, vectors = components(cov)
    kept = np.flatnonzero(values > 1e-13 * values[0])[:most] if values[0] > 0 else np.zeros(0, np.int64)
    return Whitener(n, sums, values[kept], vectors[:, kept], values[kept] / max(np.trace(cov[0]), 1e-300))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """x less its mean, rounded once, and the sum of (n x - sums)**2, exact."""
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    q = n * x - np.array(sums, dtype=np.int64) if largest < 2**62 else n * x.astype(object) - np.array(sums, dtype=object)
    size = int(np.abs(q).max(initial=0))
    square = ((q if size * size * x.shape[1] < 2**63 else q.astype(object)) ** 2).sum(axis=1)
    return (q / n).astype(np.float64), [int(s) if s < 2**63 else None for s in square.tolist()]


def _whiten(batches: Iterator[pa.RecordBatch], w: Whitener) -> Iterator[pa.RecordBatch]:
    turn = w.vectors / np.sqrt(w.values)
    for batch in batches:
        x = _matrix(batch, "x", len(w.sums))
        for at in range(0, len(x), 4096):
            y, deviation = _deviations(x[at : at + 4096], w.n, w.sums)
            made = y @ turn
            arrays = pa.ListArray.from_arrays(np.arange(0, made.size + 1, made.shape[1], dtype=np.int32), made.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(y)), pa.array(deviation, pa.int64()), arrays], names=["vec_id", "deviation", "v"])


def whiten(rows: DataFrame, w: Whitener, id_col: str = "vec_id") -> DataFrame:
    """(vec_id, deviation, v): v holds the whitened components of each row."""
    schema = "vec_id long, deviation long, v array<double>"
    if not len(w.values):
        return rows.sparkSession.createDataFrame([], schema)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col("v").alias("x")).mapInArrow(lambda b: _whiten(b, w), schema)


def identity_error(whitened: DataFrame, k: int) -> float:
    """Largest entry of the covariance of the whitened rows less the identity, without sign."""
    mean, _ = mean_of(whitened, k)
    return float(np.abs(covariance(whitened, k, mean)[0] - np.eye(k)).max(initial=0))


def whitening(df: DataFrame, most: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of all usable rows; fitted on all of them."""
    rows, d = whole_vectors(df)
    w = fit(rows, d, most)
    k = len(w.values)
    made = whiten(rows, w)
    if k:
        made = materialize(made, "whitened")
    error = identity_error(made, k) if k else 0.0
    share = F.array(*(F.lit(float(x)) for x in w.explained)) if k else F.array().cast("array<double>")
    out = made.select("vec_id", "deviation", F.posexplode("v").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")
    )
