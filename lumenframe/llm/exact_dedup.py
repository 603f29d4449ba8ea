"""Exact deduplication by Grace hashing.

Each scan task collapses its own equal texts, so a text that fills a third of the table reaches the shuffle once per
task. The remaining distinct texts are shuffled by digest. Both passes run the same Grace join: rows go to one of 16
buckets by the next four digest bits, buckets spill to task-private files while memory is short, a bucket that is
still too large is partitioned again by the following bits, and a bucket that fits is resolved in an open-addressing
table whose slots are decided by comparing complete contents. Links back to the documents run over the unique id of
the row that stood for a text in its task, so no join key is hot.

Defined cases: null text counts as empty, and empty texts are equal. A null id sorts after all others; a group of
null ids has a null keep_id. Rows that repeat both id and text are one group, of which one row is kept. Texts of any
length are compared whole. Other columns of the input are ignored, whatever their names. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import materialize, slices

Row = tuple[bytes, bytes, Any]
FANOUT_BITS = 4
#: Bytes of (compressed) content that a task holds before buckets go to disk.
MEMORY = 48 << 20
WHITE = b" \t\n\x0b\x0c\r"


def normalise(text: str | None) -> bytes:
    """UTF-8 of the text with every run of ASCII white space replaced by one space."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    core = b" ".join(raw.split())
    if not core:
        return b" " if raw else b""
    return (b" " if raw[0] in WHITE else b"") + core + (b" " if raw[-1] in WHITE else b"")


class ContentTable:
    """Open addressing with linear probing; equal means equal digest and equal complete content."""

    def __init__(self, slots: int = 1024):
        self.slots = np.full(slots, -1, dtype=np.int64)
        self.entries: list[Row] = []
        self.size = 0

    def add(self, digest: bytes, content: bytes, tag: Any) -> Any:
        """The tag under which this content was first added."""
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while (k := int(self.slots[at])) >= 0:
            known = self.entries[k]
            if known[0] == digest and known[1] == content:
                return known[2]
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.entries.append((digest, content, tag))
        self.size += len(content)
        if 2 * len(self.entries) > len(self.slots):
            self._grow()
        return tag

    def _grow(self) -> None:
        slots = np.full(2 * len(self.slots), -1, dtype=np.int64)
        mask = len(slots) - 1
        for k, (digest, _, _) in enumerate(self.entries):
            at = int.from_bytes(digest[-8:], "little") & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = k
        self.slots = slots


def _bucket(digest: bytes, level: int) -> int:
    return (int.from_bytes(digest[:8], "big") >> (64 - FANOUT_BITS * (level + 1))) & ((1 << FANOUT_BITS) - 1)


def _read(path: str) -> Iterator[Row]:
    with open(path, "rb") as f:
        while True:
            try:
                yield from pickle.load(f)
            except EOFError:
                return


def grace_groups(rows: Iterable[Row], folder: str, memory: int = MEMORY, level: int = 0) -> Iterator[tuple[Row, Any]]:
    """(row, tag of the first equal row) for each row (digest, content, tag), in no particular order.

    Up to `memory` bytes of content stay in memory, whatever the number of rows; what is beyond is partitioned to
    files in `folder`, which are removed as they are read.
    """
    fan = 1 << FANOUT_BITS
    held: list[list[Row]] = [[] for _ in range(fan)]
    sizes, spilled, total = [0] * fan, [0] * fan, 0
    path = lambda b: os.path.join(folder, f"{level}-{b}")
    for row in rows:
        b = _bucket(row[0], level)
        held[b].append(row)
        sizes[b] += len(row[1]) + 120
        total += len(row[1]) + 120
        if total > memory:
            for b in sorted(range(fan), key=sizes.__getitem__, reverse=True)[: fan // 2]:
                if held[b]:
                    with open(path(b), "ab") as f:
                        pickle.dump(held[b], f, protocol=5)
                    spilled[b] += sizes[b]
                    total -= sizes[b]
                    held[b], sizes[b] = [], 0
    for b in range(fan):
        here = held[b]
        held[b] = []
        if spilled[b]:
            with open(path(b), "ab") as f:
                pickle.dump(here, f, protocol=5)
            here = _read(path(b))
            if spilled[b] + sizes[b] > memory and FANOUT_BITS * (level + 2) <= 64:
                with tempfile.TemporaryDirectory(dir=folder) as deeper:
                    yield from grace_groups(here, deeper, memory, level + 1)
                os.remove(path(b))
                continue
        table = ContentTable()
        for digest, content, tag in here:
            yield (digest, content, tag), table.add(digest, content, tag)
        if spilled[b]:
            os.remove(path(b))



def _local_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, row, rep, sha, content): rep is the row of this task with the same text, which alone has content."""
    base = TaskContext.get().partitionId() << 40
    squeeze = zstandard.ZstdCompressor(level=1)

    def rows() -> Iterator[Row]:
        n = base
        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    whole = normalise(text)
                    yield hashlib.sha256(whole).digest(), squeeze.compress(whole), (n, doc)
                    n += 1

    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("rep", pa.int64()), ("sha", pa.binary()), ("content", pa.binary())])
    with tempfile.TemporaryDirectory() as folder:
        out, size = [], 0
        for (digest, content, (n, doc)), (first, _) in grace_groups(rows(), folder):
            stands = n == first
            out.append((doc, n, first, digest, content if stands else None))
            size += len(content) if stands else 64
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _global_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rep, leader) of the representatives whose digests fall in this partition."""

    def rows() -> Iterator[Row]:
        for batch in batches:
            yield from zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(0).to_pylist(), strict=True)

    with tempfile.TemporaryDirectory() as folder:
        reps, leaders = [], []
        for (_, _, rep), leader in grace_groups(rows(), folder):
            reps.append(rep)
            leaders.append(leader)
        yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(leaders, pa.int64())], names=["rep", "leader"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialize(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
            _local_pass, "doc_id long, row long, rep long, sha binary, content binary"
        ),
        "exact-rows",
    )
    leaders = (
        rows.where("content is not null").select("rep", "sha", "content").repartition("sha").mapInArrow(_global_pass, "rep long, leader long")
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row"))
    local = rows.groupBy("rep").agg(F.count("*").alias("n"), first.alias("low")).join(leaders, "rep")
    # a leader has one row per scan task at most, so that neither the sum nor the join meets a hot key
    groups = local.groupBy("leader").agg(F.sum("n").alias("group_size"), F.min("low").alias("low"))
    of_rep = local.select("rep", "leader").join(groups, "leader").select("rep", "group_size", "low")
    return rows.select("doc_id", "row", "rep", "sha").join(of_rep, "rep").select(
        "doc_id",
        F.col("low.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("low.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
