"""BPE encoding by dynamic programming over prefixes, and decoding.

Encoding a word with ranked merges leaves, for every prefix, exactly one possible last token. It is found without
merging: among the vocabulary entries that end at this place (all suffix matches, from an automaton with suffix links
over the vocabulary) it is the one that can stand after the last token of the prefix in front of it. Two tokens can
stand side by side if no merge would have joined a part at the right edge of the first to a part at the left edge of
the second before both parts had been taken up into larger ones. Back-pointers from the end of the word then give the
ids. Words are looked up first; the program runs on new words only.

Decoding looks up the spelling of each id and joins spellings with a space, as the library does for a vocabulary
without a decoder; the digests of decoded texts come from the ids that were emitted, not from the words.

Defined cases: null text counts as empty and has no ids; special tokens spelt out in a text become their ids, as in
the library; null and repeated doc_ids keep a row each; texts and words of any length are encoded whole; other columns are ignored; an empty table gives no rows. In
decoding, null ids are an empty text, and ids outside the vocabulary are left out, as the library does.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import slices
from lumenframe.llm.subword import vocabulary_path

#: A character at the end of a word is a symbol of its own; it is shifted to this private area.
FINAL = 0xF0000
CHUNK = re.compile("[ \n\t\r]+")
#: The vocabulary's own cut into pre-tokens, for lower-case ASCII.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


class MergeTable:
    """Ranks and parents of the merges of one vocabulary, and which tokens may be neighbours."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = {}
        self.spelling: dict[int, str] = {}
        for spelt, i in model["vocab"].items():
            units = self.units(spelt[: -len(self.suffix)]) if self.suffix and spelt.endswith(self.suffix) and len(spelt) > len(self.suffix) else spelt
            self.ids[units] = i
            self.spelling[i] = spelt
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            joined = self._id(a + b)
            self.rank[self._id(a), self._id(b)] = r
            self.parts.setdefault(joined, (self._id(a), self._id(b), r))
        self._edges: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self.matches = ahocorasick.Automaton()
        for units, i in self.ids.items():
            if len(units) == 1 or self._own(i):
                self.matches.add_word(units, (len(units), i))
        self.matches.make_automaton()

    def units(self, word: str) -> str:
        return word[:-1] + chr(FINAL + ord(word[-1])) if self.suffix else word

    def _id(self, spelt: str) -> int:
        if self.suffix and spelt.endswith(self.suffix) and len(spelt) > len(self.suffix):
            return self.ids[self.units(spelt[: -len(self.suffix)])]
        return self.ids[spelt]

    def _own(self, i: int) -> bool:
        """Whether the token is what its own spelling encodes to: its two parts are so and can't be joined otherwise."""
        if i not in self.parts:
            return False
        a, b, r = self.parts[i]
        return self.fits(a, b, r)

    def _edge(self, i: int, right: bool) -> list[tuple[int, float]]:
        """The parts along an edge of a token, from the whole inwards, each with the rank at which it was taken up."""
        key = (i, right)
        if key not in self._edges:
            out, until, at = [], float("inf"), i
            while True:
                out.append((at, until))
                if at not in self.parts:
                    break
                a, b, until = self.parts[at]
                at = b if right else a
            self._edges[key] = out
        return self._edges[key]

    def fits(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether a and b stay apart through all merges of a rank below `before`."""
        key = (a, b)
        if before == float("inf") and key in self._fits:
            return self._fits[key]
        ok = True
        for x, x_until in self._edge(a, True):
            for y, y_until in self._edge(b, False):
                r = self.rank.get((x, y))
                # equal ranks go left to right: a merge inside `a` comes first, one inside `b` comes later
                if r is not None and r < before and r < x_until and r <= y_until:
                    ok = False
        if before == float("inf"):
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            self._fits[key] = ok
        return ok

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token, given in the vocabulary's characters."""
        units = self.units(word)
        if (whole := self.ids.get(units)) is not None and len(units) == 1:
            return [whole]
        n = len(units)
        last: list[int] = [-1] * (n + 1)
        width: list[int] = [0] * (n + 1)
        for end, (size, token) in self.matches.iter(units):
            stop = end + 1
            if last[stop] >= 0:
                continue
            start = stop - size
            if start == 0 or (last[start] >= 0 and self.fits(last[start], token)):
                last[stop], width[stop] = token, size
        if last[n] < 0:
            raise ValueError("the vocabulary lacks a character of the text, or tokens that its merges make")
        out, at = [], n
        while at:
            out.append(last[at])
            at -= width[at]
        return out[::-1]


class ChunkEncoder:
    """Ids and decoded spelling of the chunks between plain white space, remembered within the worker.

    Normalisation and the cut into pre-tokens are the vocabulary's own; neither looks across white space.
    """

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.table = MergeTable(spec)
        self.library = Tokenizer.from_file(path)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        spelling = self.table.spelling | {i: t for t, i in self.specials.items()}
        self.spelt = np.full(max(spelling) + 1, None, dtype=object)
        for i, t in spelling.items():
            self.spelt[i] = t

    def _word(self, word: str) -> bytes:
        if (found := self.words.get(word)) is None:
            found = self.words[word] = b"".join(i.to_bytes(4, "little") for i in self.table.encode_word(word))
        return found

    def _chunk(self, chunk: str) -> bytes:
        made = []
        for part in self.special.split(chunk):
            if part in self.specials:
                made.append(self.specials[part].to_bytes(4, "little"))
            elif part:
                if part.isascii() and part.isprintable():
                    made += map(self._word, ASCII_WORDS.findall(part.lower()))
                    continue
                normal = self.library.normalizer.normalize_str(part)
                made += [self._word(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal) if w]
        return b"".join(made)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        chunks = [c for c in CHUNK.split(text) if c]
        known = self.known
        if len(known) > self.limit:
            known.clear()
        if len(self.words) > self.limit:
            self.words.clear()
        for c in set(chunks).difference(known):
            known[c] = self._chunk(c)
        return b"".join([known[c] for c in chunks])

    def decode(self, ids: bytes) -> str:
        """The text of ids as little-endian unsigned 32-bit integers."""
        at = np.frombuffer(ids, "<u4")
        found = self.spelt[at[at < len(self.spelt)]].tolist()
        return " ".join([t for t in found if t is not None])


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def _encode(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    vocabulary = encoder(path)
    for batch in batches:
        for part in slices(batch):
            rows = []
            for text in part.column(1).to_pylist():
                ids = vocabulary.encode(text or "")
                decoded = vocabulary.decode(ids)
                rows.append((len(ids) // 4, ids, decoded) if with_ids else (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            n, a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.binary() if with_ids else pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids" if with_ids else "ids_sha256", "decoded" if with_ids else "decoded_sha256"],
            )


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    decode = encoder(path).decode
    for batch in batches:
        for part in slices(batch, column="ids"):
            texts = [decode(ids or b"") for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def bpe_encode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers."""
    return _run(docs, tokenizer, id_col, text_col, True, "ids binary, decoded string")


def bpe_decode(encoded: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of ids as little-endian unsigned 32-bit integers."""
    path = tokenizer or vocabulary_path("word_bpe_49k.json")
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(lambda b: _decode(b, path), "doc_id long, text string")


def bpe_digests(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), without shipping ids out of the tasks."""
    return _run(docs, tokenizer, id_col, text_col, False, "ids_sha256 string, decoded_sha256 string")


def _run(docs: DataFrame, tokenizer: str | None, id_col: str, text_col: str, with_ids: bool, columns: str) -> DataFrame:
    path = tokenizer or vocabulary_path("word_bpe_49k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda b: _encode(b, path, with_ids), f"doc_id long, n_tokens long, {columns}")
