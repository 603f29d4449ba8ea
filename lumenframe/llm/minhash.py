"""MinHash near-deduplication of word shingles with multiplicities, by BagMinHash signatures.

A document is a bag of five-word shingles. Weights are counts, discretised to the integers; level 1 and the dyadic
intervals (1, 2], (2, 4], (4, 8], ... above it carry a Poisson process each, whose rate is the interval's length and
whose points fall on a uniform level inside it. A shingle with count w takes the points on levels up to w, so two
documents share exactly the points of their common weight. Each point also falls on a uniform slot; a slot keeps its
earliest point. Two slots agree with probability sum(min) / sum(max): the weighted Jaccard similarity, without bias.
Points are drawn in order of time, and a process stops once it is later than all slots of its document.

Signatures are cut into bands. Equal bags are one node from the start. A member of a band bucket is first compared with
one pivot: the least member that it shares most of its buckets with. What is left to compare are the members of one
bucket that lie in different components. In buckets of up to SMALL members these pairs are listed. In larger ones, which
hold many versions of one text, the largest component is set apart: every other member is compared with all of that
component, and then with the other members that are not of it. Both are done block by block inside tasks, which give
back a spanning forest of the links found and no other pair, so that no row stands for a pair of a large bucket. Every
link is decided by the exact multiset overlap of two texts, and at the end every two members of a bucket have been
compared or are of one class. Comparisons in tasks do grow with the square of a bucket whose members stay below the
threshold; rows and shuffled bytes grow with members times blocks.

Two texts at the threshold share a band with a probability of 0.99995; listed pairs are also passed over where their
signatures agree on less than SCREEN, seven deviations below the threshold.

Defined cases: words are runs of characters other than ASCII white space, lower-cased. A text of one to four words is
one shingle. Null, empty and blank texts have the empty bag and are one class. Texts are read whole, whatever their
length. A class is named by its smallest doc_id; null ids sort last, and a class of null ids alone is named by a
negative number of its own. Rows that repeat an id are nodes of their own. Other columns are ignored (or passed through
by drop_near_duplicates, whatever their names). An empty table gives an empty result.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import connected_components, discard, materialize, mix64, slices, unused, word_hashes, word_spans

U = np.uint64
SHINGLE = 5
THRESHOLD = 0.8
SLOTS = 128
BANDS, BAND_SLOTS = 25, 5
#: A pair whose signatures agree on fewer slots than this share is over seven deviations from the threshold.
SCREEN = 0.55
#: In buckets up to this size pairs are listed.
SMALL = 16
#: Members of a block in larger ones, and bytes of their compressed texts.
BLOCK, BLOCK_BYTES = 256, 2 << 20
_STEP = U(0x9E3779B97F4A7C15)


def shingle_bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count) of every distinct shingle of each text, ordered by number and hash."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    begin = np.cumsum([0, *(len(r) + 1 for r in raw)])
    start, stop = word_spans(data)
    words = word_hashes(data, start, stop)
    doc = np.searchsorted(begin, start, side="right") - 1
    per = np.bincount(doc, minlength=len(raw))
    first = np.concatenate(([0], np.cumsum(per)))[:-1]
    with np.errstate(over="ignore"):
        if len(words) >= SHINGLE:
            n = len(words) - SHINGLE + 1
            joined = np.zeros(n, dtype=np.uint64)
            for j in range(SHINGLE):
                joined = mix64(joined * _STEP + words[j : j + n])
            whole = doc[:n] == doc[SHINGLE - 1 :]
            of, hashes = doc[:n][whole], joined[whole]
        else:
            of, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        short = np.flatnonzero((per > 0) & (per < SHINGLE))
        if len(short):
            joined = np.full(len(short), U(77), dtype=np.uint64)
            for j in range(SHINGLE - 1):
                has = per[short] > j
                joined = np.where(has, mix64(joined * _STEP + words[np.minimum(first[short] + j, len(words) - 1)]), joined)
            of, hashes = np.concatenate((of, short)), np.concatenate((hashes, joined))
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    fresh = np.ones(len(of), dtype=bool)
    fresh[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(fresh)
    return of[at], hashes[at], np.diff(np.concatenate((at, [len(of)])))


def bag_signatures(of: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """(n, SLOTS) earliest times; infinite where the bag is empty."""
    signature = np.full(n * SLOTS, np.inf)
    # the processes that a shingle takes part in: level 1, then one per dyadic interval that starts below its count
    upper = np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64)
    which = np.repeat(np.arange(len(of)), upper + 1)
    node = np.arange(len(which)) - np.repeat(np.cumsum(upper + 1) - (upper + 1), upper + 1)
    low = np.where(node > 0, 1 << np.maximum(node - 1, 0), 0)
    span = np.where(node > 0, low, 1)
    with np.errstate(over="ignore"):
        key = mix64(hashes[which] + node.astype(np.uint64) * U(0xD1342543DE82EF95))
        doc, weight, time = of[which], counts[which], np.zeros(len(which))
        step = 0
        while len(key):
            step += 1
            draw = mix64(key + U(step) * _STEP)
            time = time - np.log(((draw >> U(11)).astype(np.float64) + 1) * 2.0**-53) / span
            taken = np.ones(len(key), dtype=bool)
            if (wide := span > 1).any():
                level = low + 1 + (mix64(draw + U(0xA5)) >> U(20)).astype(np.int64) % span
                taken = ~wide | (level <= weight)
            np.minimum.at(signature, (doc * SLOTS + (draw & U(SLOTS - 1)).astype(np.int64))[taken], time[taken])
            latest = signature.reshape(n, SLOTS).max(axis=1)
            live = time < latest[doc]
            key, doc, weight, time, low, span = (x[live] for x in (key, doc, weight, time, low, span))
    return signature.reshape(n, SLOTS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    bits = signature[:, : BANDS * BAND_SLOTS].copy().view(np.uint64).reshape(-1, BANDS, BAND_SLOTS)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP, bits.shape[:2])
        for j in range(BAND_SLOTS):
            key = mix64(key * U(3) + bits[:, :, j])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for part in slices(batch, rows=4096, size=6 << 20):
            n = part.num_rows
            texts = part.column(1).to_pylist()
            of, hashes, counts = shingle_bags(texts)
            signature = bag_signatures(of, hashes, counts, n)
            with np.errstate(over="ignore"):
                both = np.zeros((n, 2), dtype=np.uint64)
                for k, salt in enumerate((U(0x51), U(0x7F4A7C15))):
                    np.add.at(both[:, k], of, mix64(mix64(hashes + salt) + counts.astype(np.uint64) * _STEP))
            full = np.bincount(of, minlength=n) > 0
            keys = band_keys(signature)
            prints = (mix64(signature.view(np.uint64)) >> U(48)).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(2), part.column(3), pa.array(np.arange(row, row + n)), pa.array([x.tobytes() for x in both], pa.binary()),
                    pa.array([k.tolist() if f else [] for k, f in zip(keys, full, strict=True)], pa.list_(pa.int64())), pa.array([x.tobytes() for x in prints], pa.binary()),
                    pa.array([squeeze.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.binary()),
                ],
                names=["doc_id", "k1", "k2", "row", "bag", "bands", "prints", "packed"],
            )
            row += n


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype="<u2").reshape(-1, SLOTS) for k in (2, 3))
            near = (a == b).mean(axis=1) >= SCREEN
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near)) for k in (0, 1)], names=["a", "b"])


def bag_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """sum(min) / sum(max) of two bags (hashes ascending, counts); 1 for two empty ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - common
    return common / total if total else 1.0


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    bags: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()
    held = 0
    expand = zstandard.ZstdDecompressor()

    def bag(row: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
        nonlocal held
        if row not in bags:
            _, hashes, counts = shingle_bags([expand.decompress(packed).decode("utf-8", "surrogatepass")])
            bags[row] = (hashes, counts)
            held += len(hashes)
            while held > 2_000_000 and len(bags) > 1:
                held -= len(bags.popitem(last=False)[1][0])
        return bags[row]

    for batch in batches:
        a, b, x, y = (batch.column(k).to_pylist() for k in range(4))
        near = [bag_similarity(bag(i, s), bag(j, t)) for i, j, s, t in zip(a, b, x, y, strict=True)]
        keep = pa.array([s >= threshold for s in near], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(near, pa.float64()).filter(keep)], names=["a", "b", "similarity"])


def _find(up: dict[int, int], x: int) -> int:
    while up.setdefault(x, x) != x:
        up[x] = x = up[up[x]]
    return x


def _join_blocks(table: pa.Table, threshold: float) -> pa.Table:
    """Links between two blocks, as a spanning forest over the components of their members.

    Rows (key, i, j, mine, rep, component, packed, bands): in block i and in block j, or in one block where i = j. Where
    bands are given, pairs that also share a band below the key are passed over: they meet there.
    """
    key, mine, rep, component, packed, bands = (table.column(c).to_pylist() for c in ("key", "mine", "rep", "component", "packed", "bands"))
    expand = zstandard.ZstdDecompressor()
    of, hashes, counts = shingle_bags([expand.decompress(x).decode("utf-8", "surrogatepass") for x in packed])
    cut = np.searchsorted(of, np.arange(len(rep) + 1))
    total = np.bincount(of, weights=counts, minlength=len(rep))
    same = table.column("i")[0].as_py() == table.column("j")[0].as_py() and all(mine)
    left = [k for k in range(len(rep)) if mine[k]]
    right = np.array(left if same else [k for k in range(len(rep)) if not mine[k]], dtype=np.int64)
    inside = np.isin(of, right)
    order = np.argsort(hashes[inside], kind="stable")
    pool, pool_of, pool_counts = hashes[inside][order], of[inside][order], counts[inside][order]
    up: dict[int, int] = {}
    out: list[tuple[int, int, float]] = []
    around = {component[y] for y in right}
    for x in left:
        root = _find(up, component[x])
        if all(_find(up, c) == root for c in around):
            continue
        h, c = hashes[cut[x] : cut[x + 1]], counts[cut[x] : cut[x + 1]]
        low, high = np.searchsorted(pool, h, "left"), np.searchsorted(pool, h, "right")
        many = high - low
        at = np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        common = np.bincount(pool_of[at], weights=np.minimum(np.repeat(c, many), pool_counts[at]), minlength=len(rep))
        similarity = common / np.maximum(total[x] + total - common, 1)
        for y in right[similarity[right] >= threshold]:
            if (same and y <= x) or (a := _find(up, component[x])) == (b := _find(up, component[y])):
                continue
            if bands[x] and min(set(bands[x]) & set(bands[y]), default=key[0]) < key[0]:
                continue
            up[max(a, b)] = min(a, b)
            out.append((min(rep[x], rep[y]), max(rep[x], rep[y]), float(similarity[y])))
    kinds = [pa.int64(), pa.int64(), pa.float64()]
    return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["a", "b", "similarity"])


def _links(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs of rows that reach the threshold, written to the shared folder."""
    prints = texts.select("row", "prints")
    near = materialize(
        pairs.join(prints.select(F.col("row").alias("a"), F.col("prints").alias("x")), "a")
        .join(prints.select(F.col("row").alias("b"), F.col("prints").alias("y")), "b")
        .select("a", "b", "x", "y").mapInArrow(_screen, "a long, b long"),
        "near-pairs",
    )
    text = texts.select("row", "packed")
    both = near.hint("merge").join(text.select(F.col("row").alias("a"), F.col("packed").alias("x")), "a").join(text.select(F.col("row").alias("b"), F.col("packed").alias("y")), "b")
    links = materialize(both.select("a", "b", "x", "y").mapInArrow(lambda it: _verify(it, threshold), "a long, b long, similarity double"), "links")
    discard(near)
    return links


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows (with rep and packed) with the number of blocks of their key and the block that each is dealt to."""
    blocks = rows.groupBy(key).agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("packed")) / BLOCK_BYTES)).cast("int").alias("blocks"), F.count("*").alias("held"))
    return rows.join(materialize(blocks, "blocks"), key).withColumn("block", F.pmod(F.xxhash64("rep", key), "blocks").cast("int"))


def _crowded_links(placed: DataFrame, opened: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links between components in buckets of more than SMALL members: with a bucket's major component, and past it.

    placed: (bucket, rep, size, component); opened: (bucket, major) of the buckets with more than one component.
    """
    text = texts.select(F.col("row").alias("rep"), "packed", "bands")
    past = materialize(placed.where(F.col("size") > SMALL).join(opened, "bucket").where("component <> major"), "past-major")
    asks = past.select("rep", "component", "major").distinct().join(text.drop("bands"), "rep")
    asks = materialize(_dealt(asks, "major"), "asks")
    sizes = asks.select("major", F.col("blocks").alias("asked")).distinct()
    held = placed.select("rep", "component").distinct().join(sizes.select(F.col("major").alias("component")).distinct(), "component", "left_semi")
    held = held.withColumn("major", F.col("component")).join(text.drop("bands"), "rep")
    held = materialize(_dealt(held, "major").join(sizes, "major"), "majors")
    nothing = F.array().cast("array<bigint>").alias("bands")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks_rows = asks.join(held.select("major", F.col("blocks").alias("n")).distinct(), "major").select(
        F.lit(0).alias("kind"), F.col("major").alias("key"), F.col("block").alias("i"), span("n").alias("j"), F.lit(True).alias("mine"), "rep", "component", "packed", nothing
    )
    held_rows = held.select(F.lit(0).alias("kind"), F.col("major").alias("key"), span("asked").alias("i"), F.col("block").alias("j"), F.lit(False).alias("mine"), "rep", "component", "packed", nothing)
    rest = materialize(_dealt(past.select("bucket", "rep", "component").join(text, "rep"), "bucket").where("held > 1"), "past-blocks")
    x = F.col("x")
    rest_rows = rest.withColumn("x", span("blocks")).select(
        F.lit(1).alias("kind"), F.col("bucket").alias("key"), F.least("block", x).alias("i"), F.greatest("block", x).alias("j"), (F.col("block") <= x).alias("mine"), "rep", "component", "packed", "bands"
    )
    rows = asks_rows.unionByName(held_rows).unionByName(rest_rows)
    links = rows.groupBy("kind", "key", "i", "j").applyInArrow(lambda t: _join_blocks(t, threshold), "a long, b long, similarity double")
    links = materialize(links, "crowded-links")
    discard(past, asks, held, rest)
    return links


def _row_keys(doc_id: Column, text: Column) -> tuple[Column, Column]:
    return F.xxhash64(doc_id, text).alias("k1"), F.hash(text, doc_id).alias("k2")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept (true for one row of each class).

    k1 and k2, hashes of id and text, come along to find a row again where ids repeat.
    """
    signed = materialize(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *_row_keys(F.col(id_col), F.col(text_col))).mapInArrow(
            _sign, "doc_id long, k1 long, k2 int, row long, bag binary, bands array<long>, prints binary, packed binary"
        ),
        "signatures",
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row"))
    bags = materialize(signed.groupBy("bag").agg(F.min("row").alias("rep"), first.alias("low"), F.count("*").alias("n")), "bags")
    in_bands = signed.select("row", "bands").join(bags.select(F.col("rep").alias("row")), "row", "left_semi").select(F.col("row").alias("rep"), F.explode("bands").alias("bucket"))
    sizes = materialize(in_bands.groupBy("bucket").agg(F.count("*").alias("size"), F.min("rep").alias("pivot")).where("size > 1"), "bucket-sizes")
    members = materialize(in_bands.join(sizes, "bucket"), "buckets")
    # by sort and merge whatever the size, as the members are a share of all documents
    texts = materialize(signed.select("row", "prints", "packed", "bands").join(members.select(F.col("rep").alias("row")).distinct().hint("merge"), "row", "left_semi"), "bucket-texts")

    # one pivot for each member
    met = members.where("rep <> pivot").groupBy("rep", "pivot").agg(F.count("*").alias("n"))
    pivots = met.groupBy("rep").agg(F.max(F.struct("n", (-F.col("pivot")).alias("p"))).alias("best"))
    links = _links(pivots.select((-F.col("best.p")).alias("a"), F.col("rep").alias("b")), texts, threshold)
    found = connected_components(links)
    placed = members.select("bucket", "rep", "size").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = materialize(placed, "placed")

    # buckets in which components meet
    kinds = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    opened = kinds.groupBy("bucket").agg(F.count("*").alias("kinds"), F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("most")).where("kinds > 1")
    opened = materialize(opened.select("bucket", (-F.col("most.c")).alias("major")), "open-buckets")
    small = materialize(placed.where(F.col("size") <= SMALL).join(opened, "bucket").select("bucket", "rep", "component"), "small-buckets")
    x, y = small.alias("x"), small.alias("y")
    across = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component")))
    listed = _links(across.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct(), texts, threshold)
    crowded = _crowded_links(placed, opened, texts, threshold)
    edges = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(listed.select("a", "b")).unionByName(crowded.select("a", "b"))
    settled = connected_components(edges)
    discard(sizes, members, texts, links, found, placed, opened, small, listed, crowded)

    component = bags.join(settled.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    classes = materialize(component.groupBy("component").agg(F.sum("n").alias("class_size"), F.min("low").alias("low")), "classes")
    of_bag = materialize(component.select("bag", "component").join(classes, "component").select("bag", "class_size", "low"), "bag-classes")
    name = F.coalesce(F.col("low.doc_id"), -1 - F.col("low.row"))
    out = signed.select("doc_id", "k1", "k2", "row", "bag").join(of_bag, "bag").select("doc_id", name.alias("class_id"), "class_size", (F.col("row") == F.col("low.row")).alias("kept"), "k1", "k2")
    out = materialize(out, "near-duplicates")
    discard(signed, bags, settled, classes, of_bag)
    return out


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, with all its columns. Needs columns doc_id and text."""
    names = unused(docs, "k1", "k2")
    kept = near_duplicates(docs, threshold).where("kept").select(F.col("k1").alias(names[0]), F.col("k2").alias(names[1]))
    rows = docs.withColumns(dict(zip(names, _row_keys(docs["doc_id"], docs["text"]), strict=True))).join(kept, names, "left_semi")
    # rows that repeat id and text are told apart by nothing: one of them stays
    return rows.dropDuplicates(names).select([F.col(f"`{c}`") for c in docs.columns])
