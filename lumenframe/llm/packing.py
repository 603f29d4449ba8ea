"""Bounded-space online packing of token streams into fixed windows.

Every scan task keeps at most `open_windows` windows. Full windows are cut straight from long documents; what is left
of a document goes, whole, to the open window that it fills best, and when none has room the fullest window is
emitted. The windows still open at the end of the tasks are merged in bounded groups, best fit decreasing, from their
fill levels alone. Ids of sequences come from the task's number, so no counter is shared.

Defined cases: null and empty texts are one end-of-document id. A null doc_id is carried along. Rows that repeat an
id are packed as separate documents. Texts of any length are encoded whole and cut into as many windows as they fill. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import materialize, slices
from lumenframe.llm.subword import text_encoder, vocabulary_path

WINDOW = 1024
OPEN_WINDOWS = 64
#: Windows that one merging task gets; their number does not grow with the input.
MERGE_GROUP = 2048
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())]
)


class OpenWindows:
    """At most `limit` windows, ordered by fill; pieces are rows (doc, start, length, crc, doc_tokens)."""

    def __init__(self, window: int, limit: int):
        self.window, self.limit = window, limit
        self.fills: list[int] = []  # ascending, beside self.pieces
        self.pieces: list[list[tuple]] = []

    def place(self, piece: tuple) -> list[tuple] | None:
        """Put the piece into the fullest window with room; returns a window that had to go."""
        size, gone = piece[2], None
        k = bisect.bisect_right(self.fills, self.window - size) - 1
        if k >= 0:
            fill, held = self.fills.pop(k), self.pieces.pop(k)
        else:
            fill, held = 0, []
            if len(self.fills) >= self.limit:
                self.fills.pop()
                gone = self.pieces.pop()
        held.append(piece)
        at = bisect.bisect_right(self.fills, fill + size)
        self.fills.insert(at, fill + size)
        self.pieces.insert(at, held)
        return gone


def _pack_partition(batches: Iterator[pa.RecordBatch], path: str, window: int, limit: int) -> Iterator[pa.RecordBatch]:
    encode = text_encoder(path).encode
    next_id = TaskContext.get().partitionId() << 40
    spaces, out = OpenWindows(window, limit), []

    def emit(pieces: list[tuple], is_open: bool) -> None:
        nonlocal next_id
        offset = 0
        for piece in pieces:
            out.append((*piece, next_id, offset, is_open))
            offset += piece[2]
        next_id += 1

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), SCHEMA, strict=True)], schema=SCHEMA)
        out.clear()
        return made

    for whole in batches:
        for part in slices(whole, rows=256):
            docs = part.column(0).to_pylist()
            for doc, text in zip(docs, part.column(1).to_pylist(), strict=True):
                ids = encode(text or "").tobytes() + b"\0\0\0\0"
                total = len(ids) // 4
                for start in range(0, total, window):
                    cut = ids[4 * start : 4 * (start + window)]
                    piece = (doc, start, len(cut) // 4, zlib.crc32(cut), total)
                    if piece[2] == window:
                        emit([piece], False)
                    elif gone := spaces.place(piece):
                        emit(gone, False)
        if len(out) > 20_000:
            yield batch()
    for fill, pieces in zip(spaces.fills, spaces.pieces, strict=True):
        emit(pieces, fill < window)
    if out:
        yield batch()


def _merge(windows: pd.DataFrame, window: int) -> pd.DataFrame:
    """Best fit decreasing over (sequence_id, fill): the sequence that each window moves to, and where."""
    windows = windows.sort_values(["fill", "sequence_id"], ascending=[False, True])
    fills, ids, rows = [], [], []
    for seq, fill in zip(windows.sequence_id, windows.fill, strict=True):
        k = bisect.bisect_right(fills, window - fill) - 1
        at, target = (fills.pop(k), ids.pop(k)) if k >= 0 else (0, seq)
        rows.append((seq, target, at))
        k = bisect.bisect_right(fills, at + fill)
        fills.insert(k, at + fill)
        ids.insert(k, target)
    return pd.DataFrame(rows, columns=["sequence_id", "target", "shift"])


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer or vocabulary_path("byte_bpe_50k.json")
    pieces = materialize(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
            lambda batches: _pack_partition(batches, path, window, open_windows),
            "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean",
        ),
        "pieces",
    )
    windows = pieces.where("open").groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    groups = max(1, -(-windows.count() // MERGE_GROUP))
    moved = windows.groupBy(F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).alias("part")).applyInPandas(
        lambda pdf: _merge(pdf, window), "sequence_id long, target long, shift long"
    )
    merged = pieces.where("open").join(moved, "sequence_id")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return pieces.where("not open").select(*columns, "sequence_id", "offset").unionByName(
        merged.select(*columns, F.col("target").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
    )
