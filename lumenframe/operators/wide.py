"""Covariance and principal components of wide rows, held as an array column.

Tasks multiply batches of centred rows with numpy; what leaves a task are blocks of its sums, which are merged by block in
two steps, so that no task gets the blocks of all others at once. Nothing is planned per pair of columns: thousands
of columns are one scan. For a few components of very many columns no d x d matrix is made at all.

Rows with a null, NaN or infinite entry, or of another length than the first row's, are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.registry import register

#: Columns of a block, and first-step merges for each block.
BLOCK, MERGES = 512, 16
_PART = "row int, col int, n long, high int, wide int, cells binary"


def as_rows(df: DataFrame, columns: list[str] | None = None, vector: Column | str | None = None) -> tuple[DataFrame, int]:
    """(v) with the usable rows as arrays of doubles, and their length."""
    v = F.col(vector) if isinstance(vector, str) else vector
    made = F.array(*(F.col(f"`{c}`").cast("double") for c in columns)) if columns is not None else v.cast("array<double>")
    rows = df.select(made.alias("v")).where("v is not null and size(v) > 0 and forall(v, x -> coalesce(abs(x) < double('inf'), false) and not isnan(x))")
    d = len(columns) if columns is not None else (rows.select(F.size("v")).first() or [0])[0]
    return rows.where(F.size("v") == d), d


def _batches(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _cells(row: int, col: int, n: int, cells: np.ndarray) -> pa.RecordBatch:
    values = (row, col, n, *cells.shape, np.ascontiguousarray(cells).tobytes())
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds, strict=True)], names=["row", "col", "n", "high", "wide", "cells"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of a block follow each other; one block is held at a time."""
    held = None
    for batch in batches:
        for r in batch.to_pylist():
            cells = np.frombuffer(r["cells"]).reshape(r["high"], r["wide"])
            if held and held[:2] == (r["row"], r["col"]):
                held = (*held[:2], held[2] + r["n"], held[3] + cells)
            else:
                if held:
                    yield _cells(*held)
                held = (r["row"], r["col"], r["n"], cells)
    if held:
        yield _cells(*held)


def _summed(parts: DataFrame) -> list:
    """The sums of the blocks of all tasks: at most the whole matrix, a model parameter."""
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("cells"), F.lit(MERGES)))
    once = salted.repartition("row", "col", "salt").sortWithinPartitions("row", "col", "salt").drop("salt").mapInArrow(_merge, _PART)
    return once.repartition("row", "col").sortWithinPartitions("row", "col").mapInArrow(_merge, _PART).collect()


def _scan(rows: DataFrame, d: int, put: Callable[[dict, np.ndarray], None]) -> tuple[dict[tuple[int, int], np.ndarray], int]:
    """Sums by block that `put` adds up from the rows of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        n = 0
        for x in _batches(batches, d):
            put(sums, x)
            n += len(x)
        for (row, col), cells in sums.items():
            yield _cells(row, col, n, cells)

    found = _summed(rows.mapInArrow(run, _PART))
    return {(r["row"], r["col"]): np.frombuffer(r["cells"]).reshape(r["high"], r["wide"]) for r in found}, (found[0]["n"] if found else 0)


def mean(rows: DataFrame, d: int) -> tuple[np.ndarray, int]:
    def put(sums: dict, x: np.ndarray) -> None:
        sums[0, 0] = sums.get((0, 0), 0) + x.sum(axis=0, keepdims=True)

    found, n = _scan(rows, d, put)
    return (found[0, 0][0] / n if n else np.zeros(d)), n


def covariance_matrix(rows: DataFrame, d: int) -> tuple[np.ndarray, int]:
    """Sample covariance (divisor n - 1) of the arrays, and the number of rows."""
    centre, n = mean(rows, d)

    def put(sums: dict, x: np.ndarray) -> None:
        y = x - centre
        for i in range(0, d, BLOCK):
            for j in range(i, d, BLOCK):
                sums[i, j] = sums.get((i, j), 0) + y[:, i : i + BLOCK].T @ y[:, j : j + BLOCK]

    found, n = _scan(rows, d, put)
    out = np.full((d, d), np.nan)
    for (i, j), cells in found.items():
        out[i : i + cells.shape[0], j : j + cells.shape[1]] = cells
        out[j : j + cells.shape[1], i : i + cells.shape[0]] = cells.T
    return out / max(n - 1, 1) if n > 1 else np.full((d, d), np.nan), n


@register("statistic", "wide-covariance")
def wide_covariance(df: DataFrame, columns: list[str] | None = None, vector: Column | str | None = None) -> DataFrame:
    """(src, tgt, value) of all pairs of columns, or of places of a vector, by their numbers from 0."""
    rows, d = as_rows(df, columns, vector)
    matrix, _ = covariance_matrix(rows, d)
    table = df.sparkSession.createDataFrame([(i, matrix[i].tolist()) for i in range(d)], "src int, cells array<double>")
    return table.select("src", F.posexplode("cells").alias("tgt", "value"))


def leading_components(rows: DataFrame, d: int, k: int, spare: int = 10, turns: int = 6, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of the covariance and their unit vectors (d x k), by a randomised range finder.

    A random block of k + spare vectors is multiplied by the covariance a few times, each a scan that sends
    d x (k + spare) numbers from a task, and made orthogonal in between; the covariance within its span is solved on the
    driver. The entry of largest magnitude of a vector is positive.
    """
    centre, n = mean(rows, d)
    wide = min(k + spare, d)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, wide)))[0]

    def times(q: np.ndarray) -> np.ndarray:
        def put(sums: dict, x: np.ndarray) -> None:
            y = x - centre
            z = y @ q
            for i in range(0, d, BLOCK):
                sums[i, 0] = sums.get((i, 0), 0) + y[:, i : i + BLOCK].T @ z

        found, _ = _scan(rows, d, put)
        return np.concatenate([found[i, 0] for i in range(0, d, BLOCK)]) / max(n - 1, 1)

    if n < 2:
        return np.zeros(0), np.zeros((d, 0))
    made = times(q)
    for _ in range(0 if wide == d else turns):
        q = np.linalg.qr(made)[0]
        made = times(q)
    inner = q.T @ made
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-values)[: min(k, d)]
    vectors = q @ turn[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values[order], vectors * np.where(signs == 0, 1, signs)


@register("statistic", "wide-pca")
def wide_pca(df: DataFrame, k: int, vector: str, keep: list[str] | None = None, **options: int) -> DataFrame:
    """The kept columns and `pc`, the centred vector on the k leading components; null where the vector is not usable."""
    rows, d = as_rows(df, vector=vector)
    centre, _ = mean(rows, d)
    _, vectors = leading_components(rows, d, k, **options)
    shift = centre @ vectors

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("__v")
            usable = column.is_valid()
            made = [None] * batch.num_rows
            x = column.filter(usable).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) if d else np.zeros((0, 0))
            for at, row in zip(np.flatnonzero(usable.to_numpy(zero_copy_only=False)), x @ vectors - shift if len(x) else (), strict=True):
                made[at] = row.tolist()
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(made, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "pc"])

    fine = F.expr(f"size(`{vector}`) = {d} and forall(`{vector}`, x -> coalesce(abs(double(x)) < double('inf'), false) and not isnan(double(x)))")
    kept = df.select(*(keep if keep is not None else [c for c in df.columns if c != vector]), F.when(fine, F.col(vector).cast("array<double>")).alias("__v"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(project, f"{schema}, pc array<double>" if schema else "pc array<double>")
