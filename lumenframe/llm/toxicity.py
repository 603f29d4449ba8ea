"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word is the sum of three rows of hashed tables: two for the word, one for its first four bytes. Filters of several
widths run over the words of a text, each takes its maximum over the whole text, and a logistic layer weighs the maxima.

All labelled rows given take part, with their whole texts. Their hashed words are dealt by hash to shards of about
`SHARD_ROWS` rows and written once. Spark tasks count in how many texts of each label a word stands, which begins the
embeddings; then, in each of `ROUNDS` rounds, every shard trains the network on its rows with numpy, from where the last
round ended, and the network moves by the mean of what the shards moved it (a row of a table by the mean of those that moved
it). These moves are whole multiples of 2**-20, so that their sums do not depend on the order of arrival; a shard has the
same rows in the same order however the tables are cut. The driver has the network only, never a text.

Thresholds are calibrated by language on those rows, a quarter by hash of their words, that do not train; tasks count
their logits, in steps of 1 / `STEP`, and all are counted. The language is told from function words in the text itself,
never from a column. Scores are moved so that each language's threshold is `THRESHOLD`, which keeps their order within
a language. Texts are scored in Spark tasks, in blocks of words.

Defined cases: null and empty texts, and texts without a word, are scored as a text of no words; without a row of label
1 every score is 0, without one of label 0 it is 1; several labels for an id count as so many rows; null and repeated
ids keep a row each; equal texts have equal scores; labels without a document are not used; an empty table gives no
rows; other columns are ignored. Texts of any length are learned from and scored whole.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import U64, SpanHasher, crc_mod, discard, materialize, slices

#: Labelled rows of a shard, rounds over all of them, and passes of a shard over its rows in a round (more where all rows are few).
SHARD_ROWS, ROUNDS, PASSES, MOST_PASSES = 4_096, 2, 2, 40
#: Steps that training is to make one after the other, as far as passes allow, and rows of a step.
STEPS, SIZE = 300, 64
#: Labels, two numbers each, that are sent to the tasks; beyond, the join is by shuffle.
BROADCAST_ROWS = 1_000_000
#: Moves of weights are summed in units of 2**-20, logits counted in units of 1 / STEP.
UNIT, STEP = float(1 << 20), 256
THRESHOLD = 0.3
BUCKETS, DIMENSIONS, WIDTHS, FILTERS = 1 << 16, 16, (1, 2, 3), 16
#: Empty places after each text, so that no filter reaches into the next one; their embedding is 0.
GAP = max(WIDTHS) - 1
#: Places whose filters are computed at once.
BLOCK = 1 << 14
#: Frequent function words that tell a language.
FUNCTION_WORDS = {
    "en": "the of and to is that for with this was are have",
    "de": "der die und das den von mit ist auf nicht ein eine",
    "fr": "le les des est dans pour une du au et sur pas",
    "es": "el los las por con una se su y lo como más",
    "it": "il che di della gli per non è sono nel",
    "pt": "os uma do da não com em ao na",
    "nl": "het een van dat niet zijn voor op te",
}
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def hashed_words(text: str | None) -> np.ndarray:
    """(words, 3): the places of each word of a text in the three tables."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "replace"), dtype=np.uint8)
    edges = np.diff(_WORD[data].view(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    spans = SpanHasher(data)
    whole, head = spans(start, stop), spans(start, np.minimum(stop, start + 4))
    return np.stack([whole % U64(BUCKETS), (whole >> U64(32)) % U64(BUCKETS), head % U64(BUCKETS)], axis=1).astype(np.int32)


def _language_table() -> np.ndarray:
    """Number of the language whose function word stands at a place of the first table; 0 for none."""
    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    for k, words in enumerate(FUNCTION_WORDS.values()):
        out[hashed_words(words)[:, 0]] = k + 1
    return out


LANGUAGE = _language_table()


class Batch:
    """Texts one after the other, with empty places between them."""

    def __init__(self, texts: list[np.ndarray]):
        lengths = np.array([max(1, len(t)) + GAP for t in texts], dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(lengths)))
        self.ids = np.full((self.start[-1] + GAP, 3), BUCKETS, dtype=np.int32)
        for at, t in zip(self.start, texts, strict=False):
            self.ids[at : at + len(t)] = t
        self.text = np.repeat(np.arange(len(texts)), lengths)

    def languages(self) -> np.ndarray:
        """The language with the most function words of each text, 0 for none; ties go to the first."""
        k = len(FUNCTION_WORDS) + 1
        found = LANGUAGE[self.ids[: len(self.text), 0]]
        counts = np.bincount(self.text * k + found, minlength=(len(self.start) - 1) * k).reshape(-1, k)
        counts[:, 0] = 0
        return counts.argmax(axis=1)


class Net:
    """Tables, filters by width, and a logistic layer on their maxima; after calibration, a threshold by language."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tables = [rng.normal(0, 0.01, (BUCKETS + 1, DIMENSIONS)).astype(np.float32) for _ in range(3)]
        for t in self.tables:
            t[BUCKETS] = 0
        self.filters = [rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.zeros(1, dtype=np.float32)
        self.constant: float | None = None
        self.cut = np.zeros(len(FUNCTION_WORDS) + 1)

    def freeze(self) -> None:
        """Round all weights to multiples of 2**-12: sums of their products are then exact in doubles, in any order.

        So a text's score does not depend on the texts that are scored along with it.
        """
        whole = lambda a: np.round(a.astype(np.float64) * 4096) / 4096
        self.tables = [whole(t).astype(np.float32) for t in self.tables]
        self.filters, self.bias = [whole(f) for f in self.filters], [whole(b) for b in self.bias]
        self.out, self.base = whole(self.out), whole(self.base)

    def embed(self, ids: np.ndarray) -> np.ndarray:
        return self.tables[0][ids[:, 0]] + self.tables[1][ids[:, 1]] + self.tables[2][ids[:, 2]]

    def pooled(self, batch: Batch, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(texts, filters): the maximum of each filter over a text and, if asked for, the first place that has it."""
        texts, m = len(batch.start) - 1, len(WIDTHS) * FILTERS
        kind = self.out.dtype
        best = np.full((texts, m), -np.inf, dtype=kind)
        where = np.zeros((texts, m), dtype=np.int64) if places else None
        for low in range(0, len(batch.text), BLOCK):
            high = min(low + BLOCK, len(batch.text))
            x = self.embed(batch.ids[low : high + GAP]).astype(kind, copy=False)
            z = np.empty((high - low, m), dtype=kind)
            for k, f in enumerate(self.filters):
                part = x[: high - low] @ f[0] + self.bias[k]
                for j in range(1, len(f)):
                    part += x[j : high - low + j] @ f[j]
                z[:, k * FILTERS : (k + 1) * FILTERS] = part
            z[batch.ids[low:high, 0] == BUCKETS] = np.concatenate(self.bias)  # nothing begins at an empty place
            first, last = batch.text[low], batch.text[high - 1]
            at = np.maximum(batch.start[first : last + 1] - low, 0)
            top = np.maximum.reduceat(z, at, axis=0)
            better = top > best[first : last + 1]
            if where is not None:
                r, c = np.nonzero(z == np.repeat(top, np.diff(np.append(at, high - low)), axis=0))
                r, c = r[::-1], c[::-1]
                place = np.zeros_like(top, dtype=np.int64)
                place[batch.text[low + r] - first, c] = low + r
                where[first : last + 1] = np.where(better, place, where[first : last + 1])
            best[first : last + 1] = np.where(better, top, best[first : last + 1])
        return best, where

    def logits(self, batch: Batch) -> np.ndarray:
        best, _ = self.pooled(batch)
        hidden = np.round(np.maximum(best, 0) * 2.0**16) / 2.0**16
        return (hidden @ self.out + self.base[0]).astype(np.float64)

    def score(self, batch: Batch) -> np.ndarray:
        """Score of each text, with the threshold of its language at THRESHOLD."""
        if self.constant is not None:
            return np.full(len(batch.start) - 1, self.constant)
        moved = self.logits(batch) - self.cut[batch.languages()] + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(moved, -40, 40)))


class _Steps:
    """Adagrad for an array, in whole or in some of its rows."""

    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate, self.seen = value, rate, np.full(value.shape, 1e-6, dtype=np.float32)

    def __call__(self, gradient: np.ndarray) -> None:
        self.seen += gradient**2
        self.value -= self.rate * gradient / np.sqrt(self.seen)

    def rows(self, at: np.ndarray, gradient: np.ndarray) -> None:
        rows, place = np.unique(at, return_inverse=True)
        sums = np.stack([np.bincount(place, gradient[:, j], len(rows)) for j in range(gradient.shape[1])], axis=1).astype(np.float32)
        sums[rows == BUCKETS] = 0  # the empty place stays 0
        self.seen[rows] += sums**2
        self.value[rows] -= self.rate * sums / np.sqrt(self.seen[rows])


def log_odds(net: Net, held: np.ndarray, totals: np.ndarray) -> None:
    """Start the first dimension of the tables with how much oftener texts of label 1 hold a word; held is (label, table, place)."""
    for k, table in enumerate(net.tables):
        h = held[:, k]
        odds = np.log((h[1] + 0.5) / (max(1, totals[1]) + 1)) - np.log((h[0] + 0.5) / (max(1, totals[0]) + 1))
        table[:BUCKETS, 0] = np.clip(odds, -4, 4) * (h.sum(axis=0) >= 3) / 8


class Trainer:
    """A copy of a network, moved by Adagrad steps; what it moved by comes as rows of whole numbers."""

    def __init__(self, net: Net, rate: float, seed: int):
        self.begin, self.net, self.rng = net, copy.deepcopy(net), np.random.default_rng(seed)
        self.tables, self.filters, self.bias = ([_Steps(v, rate) for v in values] for values in (self.net.tables, self.net.filters, self.net.bias))
        self.out, self.base = _Steps(self.net.out, rate), _Steps(self.net.base, rate)

    def fit(self, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, passes: int) -> None:
        for _ in range(passes):
            order = self.rng.permutation(len(y))
            for chosen in np.array_split(order, max(1, round(len(y) / SIZE))):
                if len(chosen):
                    self.step(Batch([texts[k] for k in chosen]), y[chosen].astype(np.float32), weight[chosen].astype(np.float32) / len(chosen))

    def step(self, batch: Batch, label: np.ndarray, weight: np.ndarray) -> None:
        net = self.net
        best, where = net.pooled(batch, places=True)
        hidden = np.maximum(best, 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.base[0], -30, 30)))
        wrong = (p - label) * weight
        back = (wrong[:, None] * net.out) * (best > 0)
        self.out(hidden.T @ wrong)
        self.base(np.array([wrong.sum()], dtype=np.float32))
        places, moves = [], []
        for k, f in enumerate(net.filters):
            own, at = back[:, k * FILTERS : (k + 1) * FILTERS], where[:, k * FILTERS : (k + 1) * FILTERS]
            gradient = np.empty_like(f)
            for j in range(len(f)):
                x = net.embed(batch.ids[(at + j).ravel()]).reshape(*at.shape, DIMENSIONS)
                gradient[j] = np.einsum("tf,tfd->df", own, x)
                places.append((at + j).ravel())
                moves.append((own[:, :, None] * f[j].T[None]).reshape(-1, DIMENSIONS))
            self.filters[k](gradient)
            self.bias[k](own.sum(axis=0))
        ids, moves = batch.ids[np.concatenate(places)], np.concatenate(moves)
        for k, t in enumerate(self.tables):
            t.rows(ids[:, k], moves)

    def moved(self) -> pa.RecordBatch:
        """(row, v0, v1, ...): the rows of the network's weights that moved, numbered as in weights_of."""
        before, after = weights_of(self.begin), weights_of(self.net)
        row = np.flatnonzero((before != after).any(axis=1))
        delta = np.round((after[row].astype(np.float64) - before[row]) * UNIT).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(row), *(pa.array(delta[:, j]) for j in range(DIMENSIONS))], names=["row", *MOVES])


MOVES = [f"v{j}" for j in range(DIMENSIONS)]


def weights_of(net: Net) -> np.ndarray:
    """All weights, in rows of DIMENSIONS: those of the tables, then all others one after the other."""
    rest = np.concatenate([a.ravel() for a in (*net.filters, *net.bias, net.out, net.base)])
    rest = np.pad(rest, (0, -len(rest) % DIMENSIONS)).reshape(-1, DIMENSIONS)
    return np.concatenate([*net.tables, rest.astype(np.float32)])


def set_weights(net: Net, weights: np.ndarray) -> None:
    """The inverse of weights_of."""
    for k in range(3):
        net.tables[k][:] = weights[k * (BUCKETS + 1) : (k + 1) * (BUCKETS + 1)]
    rest, at = weights[3 * (BUCKETS + 1) :].ravel(), 0
    for a in (*net.filters, *net.bias, net.out, net.base):
        a[...] = rest[at : at + a.size].reshape(a.shape)
        at += a.size


def best_cut(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the first gap between logits at which F1 is highest."""
    order = np.argsort(-logit, kind="stable")
    z, hit = logit[order], np.cumsum((weight * y)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + (weight * y).sum())
    f1[:-1][z[:-1] == z[1:]] = -1
    k = int(f1.argmax())
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1)


def calibrate(net: Net, lang: np.ndarray, logit: np.ndarray, y: np.ndarray, n: np.ndarray, least: int = 20) -> None:
    """Thresholds by language from n rows of each logit and label; one of all rows together where a label has under `least`."""
    if not n[y == 1].sum() or not n[y == 0].sum():
        return
    net.cut[:] = best_cut(logit, y, n)
    for k in range(len(net.cut)):
        own = lang == k
        if min(n[own & (y == 1)].sum(), n[own & (y == 0)].sum()) >= least:
            net.cut[k] = best_cut(logit[own], y[own], n[own])


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            words = [hashed_words(t).astype("<u2").tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words, pa.binary()), part.column("label")], names=["doc_id", "words", "label"])


def _words(part: pa.RecordBatch) -> list[np.ndarray]:
    """The hashed words of each row, at two bytes a place, since BUCKETS places have room in them."""
    return [np.frombuffer(w, dtype="<u2").reshape(-1, 3) for w in part.column("words").to_pylist()]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, label, n): texts of a label that hold a word; places of the tables one after the other, then one for all texts."""
    held = np.zeros((2, 3 * BUCKETS + 1), dtype=np.int64)
    for batch in batches:
        for part in slices(batch, column="words"):
            for w, label in zip(_words(part), part.column("label").to_pylist(), strict=True):
                held[label, np.unique(w + np.arange(3) * BUCKETS)] += 1
                held[label, -1] += 1
    label, place = np.nonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(label), pa.array(held[label, place])], names=["place", "label", "n"])


def _train_rows(batches: Iterator[pa.RecordBatch], net: Net, weights: np.ndarray, rate: float, passes: int) -> Iterator[pa.RecordBatch]:
    """What each shard moves the network by. Rows come shard by shard."""
    trainer, now = None, None
    for batch in batches:
        for part in slices(batch, rows=SHARD_ROWS, size=32 << 20, column="words"):
            shard, words, y = part.column("shard").to_numpy(), _words(part), part.column("label").to_numpy()
            for own in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
                if shard[own[0]] != now:
                    if trainer is not None:
                        yield trainer.moved()
                    now = shard[own[0]]
                    trainer = Trainer(net, rate, int(now))
                trainer.fit([words[k] for k in own], y[own], weights[y[own]], passes)
    if trainer is not None:
        yield trainer.moved()


def _count_logits(batches: Iterator[pa.RecordBatch], net: Net) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, size=2 << 20, column="words"):
            texts = Batch(_words(part))
            steps = np.round(np.clip(net.logits(texts), -40, 40) * STEP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(texts.languages()), pa.array(steps), part.column("label")], names=["lang", "steps", "label"])


def labelled_words(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> DataFrame:
    """(shard, label, held_back, words) of all labelled documents, written with the rows of a shard together and in a fixed order."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label_col) > 0).cast("int").alias("label")).where("doc_id is not null and label is not null")
    few = rows.count() <= BROADCAST_ROWS
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows) if few else rows, "doc_id")
    shards = max(1, -(-found.count() // SHARD_ROWS))
    made = found.mapInArrow(_hash_rows, "doc_id long, words binary, label int").withColumn("key", F.xxhash64("doc_id", "words"))
    made = made.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")).repartitionById(shards, "shard").sortWithinPartitions("shard", "key", "label")
    return materialize(made.select("shard", "label", (F.pmod(F.xxhash64("words"), F.lit(4)) == 0).alias("held_back"), "words"), "toxicity-words")


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", rounds: int = ROUNDS, rate: float = 0.05) -> Net:
    """A network learned from all labelled rows given."""
    rows = labelled_words(docs, labels, label_col)
    net = Net()
    totals = {(r["held_back"], r["label"]): r["n"] for r in rows.groupBy("held_back", "label").agg(F.count("*").alias("n")).collect()}
    if min(totals.get((True, c), 0) for c in (0, 1)) >= 20:
        training, calibrating = rows.where("not held_back"), rows.where("held_back")
    else:  # too few rows to hold some back
        training = calibrating = rows
        totals |= {(False, c): totals.get((False, c), 0) + totals.get((True, c), 0) for c in (0, 1)}
    totals = np.array([totals.get((False, c), 0) for c in (0, 1)])
    if not totals.all():
        net.constant = float(totals[1] > 0)
        discard(rows)
        return net
    found = training.select("label", "words").mapInArrow(_count_words, "place long, label long, n long").groupBy("place", "label").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros((2, 3 * BUCKETS + 1), dtype=np.int64)
    held[found.column("label").to_numpy(), found.column("place").to_numpy()] = found.column("n").to_numpy()
    log_odds(net, held[:, :-1].reshape(2, 3, BUCKETS), held[:, -1])
    weights = totals.sum() / (2 * totals)
    passes = int(np.clip(-(-STEPS * SIZE // (totals.sum() * rounds)), PASSES, MOST_PASSES))
    for k in range(rounds):
        work = partial(_train_rows, net=net, weights=weights, rate=rate / (1 + k), passes=passes)
        moves = training.select("shard", "label", "words").mapInArrow(work, "row long, " + ", ".join(f"{v} long" for v in MOVES))
        moves = moves.groupBy("row").agg(F.count("*").alias("n"), *(F.sum(v).alias(v) for v in MOVES)).toArrow()
        row, n = moves.column("row").to_numpy(), moves.column("n").to_numpy()
        mean = np.stack([moves.column(v).to_numpy() / n for v in MOVES], axis=1)
        weight = weights_of(net)
        weight[row] += np.round(mean) / UNIT
        set_weights(net, weight)
    net.freeze()
    found = calibrating.select("label", "words").mapInArrow(partial(_count_logits, net=net), "lang long, steps long, label int").groupBy("lang", "steps", "label").agg(F.count("*").alias("n"))
    found = {c: v.to_numpy() for c, v in zip(("lang", "steps", "label", "n"), found.orderBy("lang", "steps", "label").toArrow().columns, strict=True)}
    calibrate(net, found["lang"], found["steps"] / STEP, found["label"], found["n"])
    discard(rows)
    return net


def _score_rows(batches: Iterator[pa.RecordBatch], net: Net) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, size=2 << 20):
            score = net.score(Batch([hashed_words(t) for t in part.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def score_toxicity(docs: DataFrame, net: Net, held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    flag = F.lit(False) if held_out is None else held_out
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", flag.alias("held_out"))
    return rows.mapInArrow(lambda b: _score_rows(b, net), "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from three quarters of the labelled rows, by crc32 of the id, and score all rows."""
    return score_toxicity(docs, fit_toxicity(docs, labels.where(crc_mod("doc_id", 4) != 2)), held_out=crc_mod("doc_id", 4) == 2)
