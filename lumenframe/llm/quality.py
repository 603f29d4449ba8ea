"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from whole texts inside Spark tasks. Trees are grown level by level on binned statistics of a
bounded sample of labelled rows (`SAMPLE_ROWS`, the smallest hashes of their ids, the same at every table size); they
are flattened into complete-tree arrays, and all trees of a batch of rows are walked with numpy index arithmetic.

Defined cases: null and empty texts have all statistics 0 and get a score; a table without labels gives every row the
score 0.5; several labels for an id count as so many rows; null and repeated ids keep a row each; texts of any length
are measured whole; equal texts have equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import SpanHasher, crc_mod, slices, word_spans

SAMPLE_ROWS = 20_000
BINS = 64
FEATURES = (
    "log_bytes log_words mean_word long_words short_words upper digits punctuation symbols bars spaces line_breaks high_bytes "
    "distinct_words repeated_lines mean_line words_per_line ends_stop upper_words top_word repeated_pairs bangs sentence_rate letter_entropy symbol_words max_word"
).split()
_LINES = re.compile(rb"\n")


def _lut(members: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


UPPER, LOWER, DIGIT = _lut(bytes(range(65, 91))), _lut(bytes(range(97, 123))), _lut(b"0123456789")
PUNCTUATION, SYMBOL = _lut(b".,;:?'\"()-"), _lut(b"#$%&*+/<=>@[\\]^_`{}~")


def statistics(text: str | None) -> np.ndarray:
    """The FEATURES of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(len(FEATURES))
    if not raw.strip():
        return out
    data = np.frombuffer(raw, dtype=np.uint8)
    n = len(data)
    start, stop = word_spans(data)
    words = max(1, len(start))
    size = stop - start
    by_byte = np.bincount(data, minlength=256)
    share = lambda lut: by_byte[lut].sum() / n
    hashes = SpanHasher(data)(start, stop)
    _, times = np.unique(hashes, return_counts=True)
    pairs = np.unique(hashes[1:] ^ (hashes[:-1] * np.uint64(3))) if words > 1 else hashes
    lines = [x for x in _LINES.split(raw) if x.strip()]
    letters = np.bincount(data | 32, minlength=256)[97:123]
    p = letters[letters > 0] / max(1, letters.sum())
    capital = np.add.reduceat(UPPER[data], start) if len(start) else np.zeros(1)
    odd = np.add.reduceat(SYMBOL[data], start) if len(start) else np.zeros(1)
    out[:] = (
        np.log1p(n), np.log1p(words), size.mean(), (size > 12).mean(), (size <= 3).mean(), share(UPPER), share(DIGIT), share(PUNCTUATION), share(SYMBOL), by_byte[124] / n,
        by_byte[32] / n, by_byte[10] / n, by_byte[128:].sum() / n, len(times) / words, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        np.log1p(words / max(1, len(lines))), sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines)), (capital > 1).mean(), times.max() / words,
        1 - len(pairs) / max(1, words - 1) if words > 1 else 0, by_byte[33] / n, by_byte[46] / words, -(p * np.log2(p)).sum(), (odd > 0).mean(), np.log1p(size.max()),
    )
    return out


class Trees:
    """Boosted complete binary trees of one depth as arrays: feature and cut by inner node, value by leaf."""

    def __init__(self, edges: list[np.ndarray], depth: int, base: float):
        self.edges, self.depth, self.base = edges, depth, base
        self.feature: np.ndarray = np.zeros((0, 2**depth - 1), dtype=np.int32)
        self.cut: np.ndarray = np.zeros((0, 2**depth - 1), dtype=np.int32)
        self.value: np.ndarray = np.zeros((0, 2**depth))

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.int32)

    def add(self, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> None:
        self.feature = np.vstack([self.feature, feature])
        self.cut = np.vstack([self.cut, cut])
        self.value = np.vstack([self.value, value])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: every row walks every tree, one level at a time."""
        binned = self.bins(x)
        total = np.full(len(x), self.base)
        if len(self.value):
            tree = np.arange(len(self.value))[None, :]
            at = np.zeros((len(x), len(self.value)), dtype=np.int64)
            rows = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                at = 2 * at + 1 + (binned[rows, self.feature[tree, at]] > self.cut[tree, at])
            total = total + self.value[tree, at - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.15, ridge: float = 1.0, least: int = 8) -> Trees:
    """Newton boosting on the logistic loss; a split's gain comes from per-bin sums of gradients and curvatures."""
    if not len(y) or y.min() == y.max():
        return Trees([np.zeros(0)] * len(FEATURES), depth, 0.0 if not len(y) else (4.0 if y[0] else -4.0))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    model = Trees(edges, depth, float(np.log(y.mean() / (1 - y.mean()))))
    binned = model.bins(x)
    d, flat = x.shape[1], binned + np.arange(x.shape[1]) * BINS
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, curve = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), dtype=np.int64)
        feature, cut = np.zeros(2**depth - 1, dtype=np.int32), np.full(2**depth - 1, BINS, dtype=np.int32)
        for level in range(depth):
            nodes, first = 2**level, 2**level - 1
            key = ((node - first)[:, None] * (d * BINS) + flat).ravel()
            hist = [np.bincount(key, np.repeat(w, d), nodes * d * BINS).reshape(nodes, d, BINS).cumsum(axis=2) for w in (grad, curve, np.ones(len(y)))]
            g, h, c = hist
            total = [z[:, :, -1:] for z in hist]
            gain = g**2 / (h + ridge) + (total[0] - g) ** 2 / (total[1] - h + ridge) - total[0] ** 2 / (total[1] + ridge)
            gain[(c < least) | (total[2] - c < least)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            good = gain.reshape(nodes, -1).max(axis=1) > 1e-6
            feature[first : first + nodes] = best // BINS
            cut[first : first + nodes] = np.where(good, best % BINS, BINS)
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - (2**depth - 1)
        value = -rate * np.bincount(leaf, grad, 2**depth) / (np.bincount(leaf, curve, 2**depth) + ridge)
        model.add(feature, cut, value)
        margin = margin + value[leaf]
    return model


def _statistics_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            stats = [statistics(t) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([s.tolist() for s in stats], pa.list_(pa.float64())), part.column(1)], names=["stats", "label"])


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, label_col: str = "quality") -> Trees:
    """Trees from the labelled rows given, at most `sample_rows` of them; (sample_rows x statistics) numbers reach the driver."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "label")
    made = rows.mapInArrow(_statistics_rows, "stats array<double>, label int").toPandas()
    x = np.array(made.stats.tolist(), dtype=float).reshape(len(made), len(FEATURES))
    y = (made.label.to_numpy() > 0).astype(float)
    order = np.lexsort((*x.T, y))  # the same trees whatever the order of arrival
    return fit_trees(x[order], y[order])


def _score_rows(batches: Iterator[pa.RecordBatch], model: Trees, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            score = model.score(np.array([statistics(t) for t in part.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def score_quality(docs: DataFrame, model: Trees, threshold: float = 0.3, held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    flag = F.lit(False) if held_out is None else held_out
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", flag.alias("held_out"))
    return rows.mapInArrow(lambda b: _score_rows(b, model, threshold), "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from four fifths of the labelled rows, by crc32 of the id, and score all rows."""
    return score_quality(docs, fit_quality(docs, labels.where(crc_mod("doc_id", 5) != 0)), held_out=crc_mod("doc_id", 5) == 0)
