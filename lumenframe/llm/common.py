"""Helpers that the operators of this subpackage share: row ids, hashing, and from the library storage and graph components."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators.components import connected_components as connected_components
from lumenframe.storage import discard as discard
from lumenframe.storage import materialize as materialize
from lumenframe.storage import scratch_path as scratch_path

U64 = np.uint64
MASK64 = (1 << 64) - 1


# ---------------------------------------------------------------- storage


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---------------------------------------------------------------- columns


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until it is no column of df: helper columns must not meet those of a caller."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batch, rows: int = 512, size: int = 8 << 20, column: str = "text"):
    """Cut an Arrow batch so that a slice holds at most `rows` rows and, single rows aside, `size` bytes of text."""
    lengths = batch.column(column)
    ends = np.cumsum([len(x) if x is not None else 0 for x in lengths.to_pylist()]) if batch.num_rows else []
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = min(start + rows, int(np.searchsorted(ends, before + size, side="right")))
        stop = max(stop, start + 1)
        yield batch.slice(start, stop - start)
        start = stop


# ---------------------------------------------------------------- vectorised hashing


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift, multiply)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, U64(base), dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class SpanHasher:
    """64-bit hashes of arbitrary byte spans of a buffer, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            powers = _powers(_BASE, len(data))
            self.prefix = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(BYTE_CODES[data] * powers[:-1], out=self.prefix[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            undo = _powers(_INVERSE, len(self.prefix) - 1)
            spans = (self.prefix[stop] - self.prefix[start]) * undo[start]
            return mix64(spans + (stop - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


#: Longer words are hashed one by one: sums modulo 2**64 tell some long strings of two letters not apart.
_LONG_WORD = 128


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of words."""
    out = SpanHasher(data)(start, stop)
    for k in np.flatnonzero(stop - start > _LONG_WORD):
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : stop[k]].tobytes(), digest_size=8).digest(), "little")
    return out


#: ASCII white space: space, and 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal runs of bytes that are not ASCII white space."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
