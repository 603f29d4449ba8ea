"""Language identification with hyperdimensional profiles.

Every letter class has a random vector of signs. A trigram is the product (binding) of its letters' vectors, each
rolled by its place; a text is the sum (bundle) of its trigrams; a language is the bundle of the texts that carry its
label. A text gets the language whose prototype, less the mean of the prototypes, has the largest cosine with it.
Prototypes come from trigram counts that Spark sums per language, so all labelled rows count and only
(languages x trigram classes) numbers, a fixed bound per language, reach the driver.

Letters are case-folded; a to z have a class each, other letters share 36 classes by code point, and every run of
other characters is one gap. Defined cases: null texts and texts without a letter are `und` with score 0, as is every
text if no language was learned; ties go to the first language in alphabetical order; null and repeated ids keep a
row each; texts of any length are bundled whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import crc_mod, mix64, slices

DIMENSIONS = 1024
CLASSES = 64
UNKNOWN = "und"


def letter_vectors(dimensions: int = DIMENSIONS) -> np.ndarray:
    """One vector of +1 and -1 for each class, from a fixed hash."""
    grid = np.arange(CLASSES * dimensions, dtype=np.uint64) + np.uint64(0x1D)
    return np.where(mix64(grid) >> np.uint64(63), 1, -1).astype(np.int8).reshape(CLASSES, dimensions)


def letter_classes(text: str) -> np.ndarray:
    """Class of each letter, 0 for each run of anything else, with a gap at both ends."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    low = (points >= 97) & (points <= 122)
    out = np.where(low, points - 96, 0).astype(np.int64)
    for at in np.unique(points[points > 127]):
        if chr(at).isalpha():
            out[points == at] = 27 + int(at) % 37
    gap = out == 0
    return out[~(gap & np.concatenate(([False], gap[:-1])))]


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    c = letter_classes(text)
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], return_counts=True)


def trigram_vectors(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Bound vectors of trigram codes, as float32."""
    a, b, c = codes // CLASSES**2, codes // CLASSES % CLASSES, codes % CLASSES
    return (np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]).astype(np.float32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch):
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                codes, counts = trigram_counts(text)
                if lang not in total:
                    total[lang] = np.zeros(CLASSES**3, dtype=np.int64)
                total[lang][codes] += counts
    for lang, counts in total.items():
        codes = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts[codes])], names=["lang", "code", "n"])


class Profiles:
    """Prototypes: a unit row for each language, and the mean that is taken off both sides."""

    def __init__(self, languages: list[str], centred: np.ndarray):
        self.languages, self.centred = languages, centred

    @classmethod
    def of(cls, counts: dict[str, dict[int, int]], dimensions: int = DIMENSIONS) -> Profiles:
        letters = letter_vectors(dimensions)
        languages = sorted(counts)
        rows = []
        for lang in languages:
            codes = np.array(sorted(counts[lang]), dtype=np.int64)
            weights = np.array([counts[lang][int(c)] for c in codes], dtype=np.float64)
            bundle = np.zeros(dimensions)
            for at in range(0, len(codes), 4096):
                bundle += weights[at : at + 4096] @ trigram_vectors(codes[at : at + 4096], letters)
            rows.append(bundle / (np.linalg.norm(bundle) or 1.0))
        made = np.array(rows).reshape(len(rows), dimensions)
        if len(rows) > 1:
            made = made - made.mean(axis=0)
            made /= np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)
        return cls(languages, made.astype(np.float32))


def fit_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from all rows with a label and a text."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sums = rows.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[int, int]] = {}
    for lang, code, n in sums.toLocalIterator():  # at most CLASSES ** 3 rows for a language
        counts.setdefault(lang, {})[code] = n
    return Profiles.of(counts)


def _scores(texts: list[str | None], profiles: Profiles, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and cosine of each text."""
    found = [trigram_counts(t or "") for t in texts]
    codes = np.unique(np.concatenate([c for c, _ in found]))
    bundles = np.zeros((len(found), letters.shape[1]), dtype=np.float32)
    for at in range(0, len(codes), 4096):
        block = codes[at : at + 4096]
        weights = np.zeros((len(found), len(block)), dtype=np.float32)
        for k, (mine, counts) in enumerate(found):
            low, high = np.searchsorted(mine, [block[0], block[-1] + 1])
            weights[k, np.searchsorted(block, mine[low:high])] = counts[low:high]
        bundles += weights @ trigram_vectors(block, letters)
    norms = np.linalg.norm(bundles, axis=1)
    if not profiles.languages:
        return [UNKNOWN] * len(found), np.zeros(len(found))
    cosine = (bundles @ profiles.centred.T) / np.maximum(norms, 1e-9)[:, None]
    lettered = norms > 0
    lang = [profiles.languages[b] if u else UNKNOWN for b, u in zip(cosine.argmax(axis=1), lettered, strict=True)]
    return lang, np.where(lettered, np.clip(cosine.max(axis=1), 0, 1), 0.0).astype(np.float64)


def _predict(batches: Iterator[pa.RecordBatch], profiles: Profiles, letters: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, rows=128):
            lang, score = _scores(part.column(1).to_pylist(), profiles, letters)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])


def _filter(batches: Iterator[pa.RecordBatch], profiles: Profiles, letters: np.ndarray, column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, rows=128, column=column):
            texts = part.column(column).to_pylist()
            if profiles.languages:
                keep = [x != UNKNOWN for x in _scores(texts, profiles, letters)[0]]
            else:
                keep = [len(trigram_counts(x or "")[0]) > 0 for x in texts]
            yield part.filter(pa.array(keep, pa.bool_()))


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    letters = letter_vectors(profiles.centred.shape[1] if profiles.languages else DIMENSIONS)
    flag = F.lit(False) if held_out is None else held_out
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), flag.alias("held_out"))
    return rows.mapInArrow(lambda b: _predict(b, profiles, letters), "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from two thirds of the labelled rows, by crc32 of the id, and predict all rows."""
    fold = crc_mod("doc_id", 3) == 1
    return identify(docs, fit_profiles(docs.where(~fold)), held_out=fold)


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents, with all columns, for which a language is recognised; learned as in language_id, decided in one pass.

    Null texts and texts without a letter go. Where no row is labelled, nothing can be told of a text with letters: it
    stays. Ties go to the first language by name; repeated rows are decided alike; an empty table stays empty.
    """
    profiles = fit_profiles(docs.where(crc_mod("doc_id", 3) != 1))
    letters = letter_vectors(profiles.centred.shape[1] if profiles.languages else DIMENSIONS)
    return docs.mapInArrow(lambda b: _filter(b, profiles, letters, "text"), docs.schema)
