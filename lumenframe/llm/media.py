"""Media columns with content-defined chunking.

A payload is stored as a media file (8-bit mono PCM in a WAV container). A gear hash rolls over the file; a chunk ends
where the hash's upper bits are zero, within a least and a largest size, so that equal passages give equal chunks
wherever they stand. Digests of all chunks are counted by Spark; of chunks that occur more than once, the first place
owns the bytes and all others refer to the digest. The store is one table: a row per document with its ordered chunk
list, the bytes that only it has, and the shared chunks that it owns. Reading joins references to shared chunks by
digest, puts the chunks in order, verifies every digest and the whole file, and decodes the samples.

Payload bytes move once (compressed, with each document's chunk list) and are written once. Defined cases: null texts
count as empty; payloads are padded with zeros to a positive multiple of 64; null and repeated ids keep a row each;
payloads of any length up to 4 GiB, the limit of a WAV file, are chunked whole; an empty table gives no rows; other
columns are ignored. A stored file that fails its digest raises.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import BYTE_CODES, discard, materialize, slices

ALIGN = 64
LEAST, LARGEST = 256, 8192
#: Chunks end, on average, every 2 ** AVERAGE_BITS bytes after the least size.
AVERAGE_BITS = 10
RATE = 8000
GEAR = (BYTE_CODES >> np.uint64(32)).astype(np.uint32)
RIFF = struct.Struct("<4sI4s4sIHHIIHH4sI")
STORED = "k1 long, k2 int, doc_id long, n_bytes long, media_sha256 string, lengths array<int>, digests array<binary>, shared_at array<int>, own binary, shared array<struct<digest:binary,bytes:binary>>"


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(ALIGN, -(-len(raw) // ALIGN) * ALIGN) - len(raw)), len(raw)


def encode_wav(payload: bytes) -> bytes:
    """Unsigned 8-bit mono samples behind a 44-byte header; the payload's length must be even."""
    n = len(payload)
    return RIFF.pack(b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def decode_wav(media: bytes) -> bytes:
    head = RIFF.unpack_from(media)
    if head[0] != b"RIFF" or head[2] != b"WAVE" or head[10] != 8 or head[12] != len(media) - RIFF.size:
        raise ValueError("not an 8-bit mono WAV file of this size")
    return media[RIFF.size :]


def cuts(media: bytes) -> list[int]:
    """End offsets of the chunks."""
    data = np.frombuffer(media, dtype=np.uint8)
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):  # a window of 32 bytes
        h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
    ends, last = [], 0
    for at in np.flatnonzero(h >> np.uint32(32 - AVERAGE_BITS) == 0) + 1:
        while at - last > LARGEST:
            last += LARGEST
            ends.append(last)
        if at - last >= LEAST:
            ends.append(int(at))
            last = int(at)
    while len(media) - last > LARGEST:
        last += LARGEST
        ends.append(last)
    if last < len(media):
        ends.append(len(media))
    return ends


def chunks(media: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of the chunks in order."""
    view, start, out = memoryview(media), 0, []
    for end in cuts(media):
        piece = bytes(view[start:end])
        out.append((hashlib.blake2b(piece, digest_size=16).digest(), piece))
        start = end
    return out


def feature(payload: bytes) -> str:
    """Length, sum, energy, largest and zero crossings of the samples about their middle value."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"n={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};peak={int(np.abs(x).max())};zc={crossings}"


def _list_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            of, ks, digests = [], [], []
            for i, text in enumerate(part.column(2).to_pylist()):
                found = chunks(encode_wav(payload_of(text)[0]))
                of += [i] * len(found)
                ks += range(len(found))
                digests += [d for d, _ in found]
            pick = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pick), part.column(1).take(pick), pa.array(ks, pa.int32()), pa.array(digests, pa.binary())], names=["k1", "k2", "k", "digest"])


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=9)
    for batch in batches:
        for part in slices(batch):
            packed = [squeeze.compress((t or "").encode("utf-8", "surrogatepass")) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(packed, pa.binary())], names=["k1", "k2", "doc_id", "packed"])


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = []
            for packed, seen in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                payload, n = payload_of(expand.decompress(packed).decode("utf-8", "surrogatepass"))
                media = encode_wav(payload)
                found = chunks(media)
                owner = {x["k"]: x["owner"] for x in seen or ()}
                mine = b"".join(piece for k, (_, piece) in enumerate(found) if k not in owner)
                held = {d: piece for k, (d, piece) in enumerate(found) if owner.get(k)}
                rows.append((n, hashlib.sha256(media).hexdigest(), [len(p) for _, p in found], [d for d, _ in found], sorted(owner), mine, [{"digest": d, "bytes": p} for d, p in held.items()]))
            kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.binary())]))]
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], names=["k1", "k2", "doc_id", "n_bytes", "media_sha256", "lengths", "digests", "shared_at", "own", "shared"])


def _load(batches: Iterator[pa.RecordBatch], with_media: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, rows = batch.slice(at, 256), []
            for lengths, digests, shared_at, own, got, sha in zip(*(part.column(c).to_pylist() for c in ("lengths", "digests", "shared_at", "own", "got", "media_sha256")), strict=True):
                mine, found, start = own, {x["k"]: x["bytes"] for x in got or ()}, 0
                shared, pieces = set(shared_at), []
                for k, size in enumerate(lengths):
                    if k in shared:
                        piece = found[k]
                    else:
                        piece, start = mine[start : start + size], start + size
                    if hashlib.blake2b(piece, digest_size=16).digest() != digests[k]:
                        raise ValueError("a stored chunk does not match its digest")
                    pieces.append(piece)
                media = b"".join(pieces)
                if hashlib.sha256(media).hexdigest() != sha:
                    raise ValueError("a stored file does not match its digest")
                payload = decode_wav(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(media), feature(payload), media if with_media else None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            made = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes"), *made[:4], part.column("media_sha256"), *made[4:]],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"],
                )


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chunk store of the documents' payloads as a table in the shared folder (columns: STORED)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.xxhash64(F.col(id_col), text).alias("k1"), F.hash(text, F.col(id_col)).alias("k2"), text.alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    listed = materialize(rows.select("k1", "k2", "text").mapInArrow(_list_chunks, "k1 long, k2 int, k int, digest binary"), "chunk-lists")
    place = F.struct("k1", "k2", "k")
    shared = listed.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("low")).where("n > 1").select("digest", "low")
    shared = materialize(shared, "shared-chunks")
    seen = listed.join(shared, "digest").groupBy("k1", "k2").agg(F.collect_set(F.struct("k", (place == F.col("low")).alias("owner"))).alias("seen"))
    seen = materialize(seen, "chunks-seen")  # joined by sort and merge whatever its size, as it is a share of all documents
    discard(listed, shared)
    packed = rows.mapInArrow(_compress, "k1 long, k2 int, doc_id long, packed binary")
    store = materialize(packed.join(seen.hint("merge"), ["k1", "k2"], "left").select("k1", "k2", "doc_id", "packed", "seen").mapInArrow(_store, STORED), "media-store", level=9)
    discard(seen)
    return store


def load_media(store: DataFrame, with_media: bool = True) -> DataFrame:
    """Read, verify and decode every stored file; with_media adds the files themselves."""
    pool = store.select(F.explode("shared").alias("s")).select("s.digest", "s.bytes").dropDuplicates(["digest"])
    refs = store.where("size(shared_at) > 0").select("k1", "k2", F.explode("shared_at").alias("k"), "digests").select("k1", "k2", "k", F.expr("get(digests, k)").alias("digest")).distinct()
    got = refs.join(pool, "digest").groupBy("k1", "k2").agg(F.collect_list(F.struct("k", "bytes")).alias("got"))
    columns = ["doc_id", "n_bytes", "media_sha256", "lengths", "digests", "shared_at", "own", "got"]
    nothing = F.lit(None).cast("array<struct<k:int,bytes:binary>>")
    alone = store.where("size(shared_at) = 0").withColumn("got", nothing).select(columns)
    joined = store.where("size(shared_at) > 0").join(got, ["k1", "k2"]).select(columns)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary"
    load = lambda df: df.mapInArrow(lambda b: _load(b, with_media), schema)
    out = load(alone).unionByName(load(joined))
    return out if with_media else out.drop("media")
