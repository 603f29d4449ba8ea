"""Phrase collocations: word sequences that occur together more often than their parts, for each language.

Texts are cut into pieces at punctuation and line ends, and pieces into words. All sequences of 1 to `max_words` words
become rows of a DataFrame (counted within a batch before they leave the task) that Spark aggregates by language and
phrase. The counts of both parts of every cut are joined to each candidate, scored in whole decimals; a candidate that a
phrase one word longer explains goes by an anti-join; ranks come from a window over the best of each share.

A phrase is no more frequent than any phrase inside it. So sequences of two words and more become rows only where both
of their parts may be candidates themselves: frequent phrases of one and of two words are marked in a bit map of fixed
size (`BITS`), whose false hits only make rows that the count removes. No candidate is lost, whatever the size.

Defined cases: null texts are empty; a null language is `und`, together with rows that say so; repeated rows count as
often as they stand; ties of score and count are ranked by the phrase in UTF-8 byte order; a table without a candidate
gives no rows; other columns are ignored. Texts are counted in slices of about `SLICE` bytes, a longer text in one
of its own; a word may have any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import U64, SpanHasher, discard, materialize, mix64

UNKNOWN = "und"
#: Bits of the map of frequent phrases, a power of two: 4 MiB, at any size of the corpus.
BITS = 1 << 25
#: Bytes of text whose sequences are counted at once.
SLICE = 2 << 20
#: Shares of a language's candidates that are ranked on their own before the last ranking.
SHARES = 64
_BLANK, _CUT = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09]] = True
_CUT[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
COUNTS = "lang string, words int, phrase string, n long"


class Words:
    """The words of some texts in one buffer, each followed by one space. A null text has no words."""

    def __init__(self, texts: pa.StringArray):
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        data = np.insert(_LOWER[raw], offsets[1:] - offsets[0], 10)  # a line end after each text
        cut = _CUT[data]
        inside = ~(cut | _BLANK[data])
        edges = np.diff(inside.view(np.int8), prepend=0)
        start, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        piece = np.cumsum(cut, dtype=np.int32)[start]
        keep = inside.copy()
        keep[stop] = True
        data[stop] = 32
        self.buffer = data[keep]
        self.offsets = np.concatenate(([0], np.cumsum(stop - start + 1)))
        #: Whether a word and the next are in one piece.
        self.joined = np.concatenate((piece[1:] == piece[:-1], [False])) if len(start) else np.zeros(0, bool)
        column = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(self.offsets.astype(np.int64)), pa.py_buffer(self.buffer)).dictionary_encode()
        #: Number of each word among the different words.
        self.code = column.indices.to_numpy().astype(np.int64)
        self.different = len(column.dictionary)

    def phrases(self, first: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and bytes of the phrases of so many words that begin at these words."""
        start, stop = self.offsets[first], self.offsets[first + words] - 1
        offsets = np.concatenate(([0], np.cumsum(stop - start)))
        out = np.empty(offsets[-1], dtype=np.uint8)
        for k in range(0, len(first), 1 << 15):  # a few at a time: places take eight times the room of bytes
            ends = offsets[k : k + (1 << 15) + 1]
            out[ends[0] : ends[-1]] = self.buffer[np.arange(ends[0], ends[-1]) + np.repeat(start[k : k + (1 << 15)] - ends[:-1], np.diff(ends))]
        return offsets, out


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each key its number among the different keys; for each number its first place and its count."""
    code = pa.array(keys).dictionary_encode().indices.to_numpy()
    count = np.bincount(code)
    first = np.empty(len(count), dtype=np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return code, first, count


def _marks(lang: str, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each phrase in the map of frequent phrases."""
    salt = SpanHasher(np.frombuffer(lang.encode("utf-8", "replace"), dtype=np.uint8))
    own = salt(np.zeros(1, np.int64), np.array([len(salt.prefix) - 1]))
    h = mix64(SpanHasher(data)(offsets[:-1], offsets[1:]) ^ own)
    return (h % U64(BITS)).astype(np.int64), ((h >> U64(32)) % U64(BITS)).astype(np.int64)


def _marked(lang: str, offsets: np.ndarray, data: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    a, b = _marks(lang, offsets, data)
    return ((frequent[a >> 6] >> (a & 63).astype(U64)) & (frequent[b >> 6] >> (b & 63).astype(U64)) & U64(1)).astype(bool)


def _rows(lang: str, words: int, offsets: np.ndarray, data: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    phrase = pa.LargeStringArray.from_buffers(len(count), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
    same = pa.DictionaryArray.from_arrays(np.zeros(len(count), np.int32), pa.array([lang])).cast(pa.string())
    return pa.RecordBatch.from_arrays([same, pa.array(np.full(len(count), words, np.int32)), phrase, pa.array(count.astype(np.int64))], names=["lang", "words", "phrase", "n"])


def _sequences(lang: str, texts: pa.StringArray, level: int, most: int, maps: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Counts of the sequences of a level: of one word, of two, or of three and more."""
    w = Words(texts)
    if not len(w.code):
        return
    first = np.empty(w.different, dtype=np.int64)
    first[w.code[::-1]] = np.arange(len(w.code))[::-1]
    spelled = w.phrases(first, 1)
    if level == 1:
        yield _rows(lang, 1, *spelled, np.bincount(w.code, minlength=w.different))
        return
    ok = _marked(lang, *spelled, maps[0])[w.code]
    at = np.flatnonzero(ok[:-1] & ok[1:] & w.joined[:-1])
    code, first, count = _numbered(w.code[at] * w.different + w.code[at + 1])
    spelled = w.phrases(at[first], 2)
    if level == 2:
        yield _rows(lang, 2, *spelled, count)
        return
    ok = _marked(lang, *spelled, maps[1])[code]
    for words in range(3, most + 1):  # each sequence by the numbers of the two that it overlaps
        at, code = at[ok], code[ok]
        follows = np.flatnonzero(np.diff(at) == 1)
        at, keys = at[follows], code[follows] * (code.max(initial=0) + 1) + code[follows + 1]
        code, first, count = _numbered(keys)
        ok = np.ones(len(at), dtype=bool)
        yield _rows(lang, words, *w.phrases(at[first], words), count)


def _count(batches: Iterator[pa.RecordBatch], level: int, most: int, maps: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
            part = batch.slice(at, stop - at)
            for lang in part.column(0).unique().to_pylist():
                yield from _sequences(lang, part.column(1).filter(pc.equal(part.column(0), lang)), level, most, maps)
            pa.default_memory_pool().release_unused()
            at = stop


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the bit map that the phrases of a task set."""
    found = np.zeros(BITS // 64, dtype=np.uint64)
    for batch in batches:
        for lang in batch.column(0).unique().to_pylist():
            phrases = batch.filter(pc.equal(batch.column(0), lang)).column(1).cast(pa.large_string()).to_pylist()
            raw = [p.encode() for p in phrases]
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in raw])))
            for a in _marks(lang, offsets, np.frombuffer(b"".join(raw), dtype=np.uint8)):
                np.bitwise_or.at(found, a >> 6, U64(1) << (a & 63).astype(U64))
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at].view(np.int64))], names=["at", "bits"])


def _bit_map(counts: DataFrame) -> np.ndarray:
    """The map of these phrases: at most BITS / 64 numbers reach the driver, whatever their number."""
    made = counts.select("lang", "phrase").mapInArrow(_bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, dtype=np.uint64)
    out[made.column("at").to_numpy()] = made.column("bits").to_numpy().view(np.uint64)
    return out


def phrase_counts(docs: DataFrame, max_words: int = 4, least: int = 30, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, n) of all phrases of 1 to max_words words that occur `least` times or more in a language, and (lang, n) of all words.

    The texts are read once for single words, once for pairs and once for all longer phrases.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))

    def level(k: int, maps: list[np.ndarray]) -> DataFrame:
        made = rows.mapInArrow(lambda b: _count(b, k, max_words, maps), COUNTS)
        return made.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))

    single = materialize(level(1, []), "words")
    total = single.groupBy("lang").agg(F.sum("n").alias("n"))
    found, maps = [single.where(F.col("n") >= least)], []
    for k in range(2, min(max_words, 3) + 1):
        maps = [*maps, _bit_map(found[-1])]
        found.append(materialize(level(k, maps).where(F.col("n") >= least), f"phrases-{k}"))
    out = materialize(reduce(DataFrame.unionByName, found), "phrases")
    total = materialize(total, "totals")
    discard(single, *found[1:])
    return out, total


def _first(words: Column, k: Column) -> Column:
    return F.array_join(F.slice(words, 1, k), " ")


def collocations(docs: DataFrame, max_words: int = 4, least: int = 30, covered: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of 2 to max_words words of each language.

    score is 2000000 a / (l + r), floored, at the cut that makes it least (of such cuts the first), where a, l and r are
    the counts of the phrase and of the parts before and after the cut. A phrase inside a longer one goes if the longer
    one makes at least `covered` hundredths of its occurrences; one word longer is enough to look at, since the
    phrase between the two is no rarer than the longer one.
    """
    counts, total = phrase_counts(docs, max_words, least)
    candidates = counts.where("words >= 2").withColumnRenamed("n", "a").withColumn("__w", F.split("phrase", " "))
    cuts = candidates.select("lang", "phrase", "a", "__w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _first(F.col("__w"), F.col("k")).alias("head"), F.array_join(F.slice("__w", F.col("k") + 1, F.size("__w")), " ").alias("tail"))
    known = counts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    cuts = cuts.join(known, ["lang", "head"]).join(known.select("lang", F.col("head").alias("tail"), F.col("l").alias("r")), ["lang", "tail"])
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumn("score", F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("best"))
    longer = candidates.where("words > 2").select(
        "lang", F.col("a").alias("f"), F.explode(F.array_distinct(F.array(_first(F.col("__w"), F.col("words") - 1), F.array_join(F.slice("__w", 2, F.size("__w")), " ")))).alias("phrase")
    )
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    left = best.select("lang", "phrase", "best.a", "best.l", "best.r", "best.score")
    explained = left.join(longer, ["lang", "phrase"]).where(whole("f") * 100 >= whole("a") * covered).select("lang", "phrase")
    left = left.join(explained, ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    left = left.withColumn("__share", share).withColumn("__at", F.row_number().over(Window.partitionBy("lang", "__share").orderBy(*order))).where(F.col("__at") <= top)
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
