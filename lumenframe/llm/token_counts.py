"""Token counts by a separator scan over flat, unindexed token files.

A token file is a stream of fixed-width ids in which every document ends with the end-of-document id; nothing says
where documents lie. Files are read as numbered blocks that ignore document boundaries. Each block is searched with
one vectorised comparison. A document that spans blocks is stitched by a prefix scan (running sums and a running
maximum over one small row per block), which gives each block the number of documents before it and the place of the
last separator before it.

Defined cases: an empty document has 0 tokens; ids after the last separator of a file are a document with
`terminated` false; an empty file has no documents. In count_tokens a null text counts as empty, null and repeated
doc_ids keep a row each, the separator's own spelling in a text is ordinary text, other columns are ignored, texts of
any length are encoded whole (`subword`), and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import materialize, slices
from lumenframe.llm.subword import text_encoder, vocabulary_path

END = 50256
BLOCK_TOKENS = 1 << 19
BLOCKS = "file_id long, block_no long, payload binary"
SCANNED = "file_id long, block_no long, n_tokens long, n_ends long, head long, tail long, inner array<int>"


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (file_id, block_no, payload) of flat token files on any file system that Spark reads.

    file_id is a hash of the file's path. One file is one task's input, so token files are expected as shards.
    """
    step = width * block_tokens

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer()
                for at in range(0, data.size, step):
                    block = data.slice(at, min(step, data.size - at)).to_pybytes()
                    yield pa.RecordBatch.from_arrays([pa.array([file_id]), pa.array([at // step]), pa.array([block], pa.binary())], names=["file_id", "block_no", "payload"])

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("file_id"), "content").mapInArrow(cut, BLOCKS)


def _scan(batches: Iterator[pa.RecordBatch], width: int, end: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file_id, block_no, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            ids = np.frombuffer(payload.as_buffer(), dtype=f"<u{width}")
            ends = np.flatnonzero(ids == end)
            n = len(ends)
            rows.append((file_id, block_no, len(ids), n, int(ends[0]) if n else None, int(len(ids) - 1 - ends[-1]) if n else None, (np.diff(ends) - 1).astype(np.int32) if n else []))
        if rows:
            kinds = [pa.int64()] * 6 + [pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file_id", "block_no", "n_tokens", "n_ends", "head", "tail", "inner"])


def scan_separators(blocks: DataFrame, width: int = 2, end: int = END) -> DataFrame:
    """(file_id, ordinal, n_tokens, terminated) for each document of the token files."""
    scanned = materialize(blocks.select("file_id", "block_no", "payload").mapInArrow(lambda b: _scan(b, width, end), SCANNED), "token-blocks")
    order = Window.partitionBy("file_id").orderBy("block_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # one small row per block: the counts lie in arrays only where documents end inside a block
    at = scanned.select("file_id", "block_no", "n_tokens", "n_ends", "head", "tail").withColumn("base", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    at = at.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    at = at.withColumn("last_end", F.expr("CASE WHEN n_ends > 0 THEN first_token + n_tokens - tail - 1 END"))
    at = at.withColumn("carry", F.col("first_token") - 1 - F.coalesce(F.max("last_end").over(before), F.lit(-1)))
    at = at.withColumn("final", F.lead("block_no").over(order).isNull())
    ends = F.lit(True).alias("terminated")
    heads = at.where("n_ends > 0").select("file_id", F.col("base").alias("ordinal"), (F.col("carry") + F.col("head")).alias("n_tokens"), ends)
    inner = (
        scanned.where("n_ends > 1").select("file_id", "block_no", "inner")
        .join(at.select("file_id", "block_no", "base"), ["file_id", "block_no"])
        .select("file_id", "base", F.posexplode("inner").alias("k", "n"))
        .select("file_id", (F.col("base") + 1 + F.col("k")).alias("ordinal"), F.col("n").cast("long").alias("n_tokens"), ends)
    )
    rest = F.expr("CASE WHEN n_ends > 0 THEN tail ELSE carry + n_tokens END")
    tails = at.where("final").select("file_id", (F.col("base") + F.col("n_ends")).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("terminated")).where("n_tokens > 0")
    return heads.unionByName(inner).unionByName(tails)


def _tokenise(batches: Iterator[pa.RecordBatch], path: str, block_tokens: int) -> Iterator[pa.RecordBatch]:
    """This task's documents as the blocks of one token file, and their order in it."""
    encode = text_encoder(path, literal_specials=True).encode
    file_id, ordinal, block_no, held, size = TaskContext.get().partitionId(), 0, 0, [], 0
    schema = pa.schema([("file_id", pa.int64()), ("block_no", pa.int64()), ("payload", pa.binary()), ("first", pa.int64()), ("docs", pa.list_(pa.int64()))])
    end, docs, first = np.array([END], dtype="<u2").tobytes(), [], 0

    def row(payload: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((file_id, block_no, payload, first, docs), schema, strict=True)], schema=schema)

    for batch in batches:
        for part in slices(batch, rows=256):
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                stream = encode(text or "").astype("<u2").tobytes() + end
                held.append(stream)
                size += len(stream)
                docs.append(doc)
                ordinal += 1
                while size >= 2 * block_tokens:
                    data = b"".join(held)
                    yield row(data[: 2 * block_tokens])
                    held, size = [data[2 * block_tokens :]], size - 2 * block_tokens
                    block_no, docs, first = block_no + 1, [], ordinal
    if size or docs:
        yield row(b"".join(held))


def write_token_blocks(docs: DataFrame, tokenizer: str | None = None, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Token files of a table (doc_id, text), one per scan task, as blocks; and which document is which of its file."""
    path = tokenizer or vocabulary_path("byte_bpe_50k.json")
    made = materialize(
        docs.mapInArrow(lambda b: _tokenise(b, path, block_tokens), f"{BLOCKS}, first long, docs array<long>"), "token-files"
    )
    order = made.select("file_id", "first", F.posexplode("docs").alias("k", "doc_id")).select("file_id", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    return made.select("file_id", "block_no", "payload"), order


def count_tokens(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens): writes the documents as token files, scans these for separators, and counts."""
    blocks, order = write_token_blocks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), tokenizer)
    return order.join(scan_separators(blocks), ["file_id", "ordinal"]).select("doc_id", "n_tokens")
