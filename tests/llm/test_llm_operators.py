"""The ten operators against brute force, exact round trips or held-out labels, on small and odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import tempfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenframe.llm import bpe, exact_dedup, language_id, line_dedup, media, minhash, packing, quality, substring_dedup, token_counts
from lumenframe.llm.common import connected_components
from lumenframe.llm.subword import vocabulary_path

ODD = [None, "", " ", "\n\n", "a", "a", "Ünïcode  Çá va?", "x<|endoftext|>y", "日本語 テキスト", "don't WE'LL 1234", "  two  spaces\t\n", "🙂 👍🏽 é", "word " * 3000, "aaaa" * 2000]


def words(rng, n):
    return [rng.choice("alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike".split()) + str(rng.randrange(60)) for _ in range(n)]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def union_find(pairs, nodes):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        up[max(find(a), find(b), key=repr)] = min(find(a), find(b), key=repr)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1100)]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    linked = {n for e in edges if e[0] != e[1] for n in e}
    want = union_find([], linked)
    up = dict(want)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and up[a] != up[b]:
                up[a] = up[b] = min(up[a], up[b])
                changed = True
    assert got == up
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 9: exact dedup


def test_exact_dedup(make):
    texts = [*ODD, "a\n b", "a b", "a \t b", " a b", None, "a"]
    ids = [100 - k for k in range(len(texts))]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(make(texts, ids)).collect()}
    normal = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in zip(ids, texts, strict=True)}
    for i, t in normal.items():
        same = [j for j, u in normal.items() if u == t]
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (min(same), len(same), i == min(same), hashlib.sha256(t.encode()).hexdigest())


def test_exact_dedup_ties_nulls_and_empty(make):
    got = exact_dedup.exact_dedup(make(["x", "x", "x", "y", "y"], [5, 5, None, None, None]))
    assert rows(got.where("kept"), "doc_id", "keep_id", "group_size") == [(5, 5, 3), (None, None, 2)]
    assert exact_dedup.exact_dedup(make(["x"]).limit(0)).count() == 0


def test_grace_join_spills_and_recurses():
    rng = random.Random(0)
    contents = [f"text {rng.randrange(200)} ".encode() * 40 for _ in range(3000)] + [b"hot" * 100] * 1500
    with tempfile.TemporaryDirectory() as folder:
        got = list(exact_dedup.grace_groups(((hashlib.sha256(c).digest(), c, k) for k, c in enumerate(contents)), folder, memory=20_000))
    first = {}
    for k, c in enumerate(contents):
        first.setdefault(c, k)
    assert len(got) == len(contents)
    groups = {}
    for (_, c, _), leader in got:
        groups.setdefault(c, set()).add(leader)
    assert groups.keys() == first.keys() and all(len(g) == 1 for g in groups.values())


def test_digest_collisions_are_told_apart():
    same = b"\0" * 32
    with tempfile.TemporaryDirectory() as folder:
        got = {c: leader for (_, c, _), leader in exact_dedup.grace_groups([(same, b"a", 0), (same, b"b", 1), (same, b"a", 2)], folder)}
    assert got == {b"a": 0, b"b": 1}


# ---------------------------------------------------------------- 2, 7, 8: tokens


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))


def test_token_counts(make, byte_bpe):
    byte_bpe.encode_special_tokens = True
    want = [(k, len(byte_bpe.encode(t or "", add_special_tokens=False).ids)) for k, t in enumerate(ODD)]
    byte_bpe.encode_special_tokens = False
    assert rows(token_counts.count_tokens(make(ODD)), "doc_id", "n_tokens") == sorted(want, key=repr)
    assert token_counts.count_tokens(make(ODD).limit(0)).count() == 0


def test_separator_scan_of_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    want = []
    for name in range(3):
        lengths = rng.integers(0, 400, size=60)
        lengths[3] = 5000  # spans many blocks
        stream = np.concatenate([np.append(rng.integers(0, 900, size=n), token_counts.END) for n in lengths]).astype("<u2")
        tail = name * 7
        stream.tofile(tmp_path / f"{name}.bin")
        if tail:
            with open(tmp_path / f"{name}.bin", "ab") as f:
                np.zeros(tail, "<u2").tofile(f)
        want += [(int(n), True) for n in lengths] + ([(tail, False)] if tail else [])
    (tmp_path / "empty.bin").touch()
    blocks = token_counts.read_token_files(spark, f"{tmp_path}/*.bin", block_tokens=256)
    got = token_counts.scan_separators(blocks)
    assert rows(got, "n_tokens", "terminated") == sorted(want, key=repr)
    assert got.groupBy("file_id").agg(F.max("ordinal").alias("m"), F.count("*").alias("n")).where("m + 1 <> n").count() == 0


def test_packing(make, byte_bpe):
    texts = ODD + [" ".join(words(random.Random(k), 40 + 37 * k % 900)) for k in range(80)]
    got = packing.pack(make(texts), window=256, open_windows=8).toPandas()
    ids = {k: [*byte_bpe.encode(t or "", add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}
    for k, pieces in got.sort_values("start").groupby("doc_id"):
        at = 0
        for p in pieces.itertuples():
            cut = ids[k][p.start : p.start + p.length]
            assert p.start == at and p.doc_tokens == len(ids[k]) and p.ids_crc32 == zlib.crc32(np.array(cut, "<u4").tobytes())
            at += p.length
        assert at == len(ids[k])
    assert set(got.doc_id) == set(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 256
    assert got.sequence_id.nunique() * 256 < 1.15 * got.length.sum() + 3 * 256
    assert packing.pack(make(texts).limit(0)).count() == 0


def test_bpe(make):
    t = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    rng = random.Random(4)
    texts = [*ODD, "İstanbul ΟΔΟΣ Σ ǅ", "́a é ́", "a\x85b\x1cc d", "".join(rng.choice("abcdefghij' .é") for _ in range(3000))]
    got = {r["doc_id"]: r for r in bpe.bpe_encode(make(texts)).collect()}
    digests = {r["doc_id"]: r for r in bpe.bpe_digests(make(texts)).collect()}
    for k, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert np.frombuffer(got[k]["ids"], "<u4").tolist() == ids and got[k]["decoded"] == decoded
        assert digests[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert digests[k]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest() and digests[k]["n_tokens"] == len(ids)
    assert bpe.bpe_digests(make(texts).limit(0)).count() == 0
    back = {r["doc_id"]: r["text"] for r in bpe.bpe_decode(bpe.bpe_encode(make(texts))).collect()}
    assert back == {k: r["decoded"] for k, r in got.items()}


def test_bpe_decode_of_any_ids(spark):
    t = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    rng = random.Random(5)
    size = t.get_vocab_size()
    made = [[rng.randrange(size) for _ in range(50)] for _ in range(20)] + [[], [size + 7, 3, 1 << 31], [0, size - 1, size - 2]]
    rows = [(k, np.array(ids, "<u4").tobytes()) for k, ids in enumerate(made)] + [(None, None), (3, np.array([5], "<u4").tobytes())]
    df = spark.createDataFrame([(k, ids, "x") for k, ids in rows], "doc_id long, ids binary, text string")
    got = [(r["doc_id"], r["text"]) for r in bpe.bpe_decode(df).collect()]
    want = [(k, t.decode(ids, skip_special_tokens=False)) for k, ids in enumerate(made)] + [(None, ""), (3, t.decode([5], skip_special_tokens=False))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.bpe_decode(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 1: lines


def edit_distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        before = row
    return before[-1]


def mutate(rng, text, most):
    x = list(text)
    for _ in range(rng.randint(0, most)):
        i, kind = rng.randrange(len(x) or 1), rng.random()
        if kind < 0.3 or not x:
            x.insert(i, rng.choice("abcé"))
        elif kind < 0.6:
            del x[i]
        else:
            x[i] = rng.choice("abcé")
    return "".join(x)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        b = mutate(rng, a, 4)
        pairs.append(max((a, b), (b, a), key=lambda p: len(p[0])))
    df = spark.createDataFrame(pairs, "a string, b string").where(f"length(a) - length(b) <= {edits}")
    both = line_dedup._once(df, "a", "b", f"{line_dedup.characters('a', edits)} AS x", f"{line_dedup.characters('b', edits)} AS y")
    for r in both.select("a", "b", F.expr(line_dedup.banded_distance("x", "y", edits)).alias("d")).collect():
        d = edit_distance(r["a"], r["b"])
        assert r["d"] == d if d <= edits else r["d"] > edits


@pytest.mark.parametrize("crowd", [False, True])
def test_line_classes(make, crowd, monkeypatch):
    rng = random.Random(7)
    lines = []
    if crowd:  # all but the rarest keys go by blocks
        monkeypatch.setattr(line_dedup, "CROWD", 2)
        monkeypatch.setattr(line_dedup, "BLOCK", 5)
        base = "the one line of which there are many versions"
        lines += [mutate(rng, base, 2).strip() for _ in range(90)]
    for _ in range(60 if not crowd else 12):
        base = "".join(rng.choice("abcd efgh") for _ in range(rng.randint(22, 60))).strip()
        lines += [base, *(mutate(rng, base, 3).strip() for _ in range(3)), "short line", ""]
    docs = ["\n".join(lines[k : k + 4]) for k in range(0, len(lines), 4)]
    got = line_dedup.line_classes(make([*docs, None, ""])).collect()
    at = {(k, j): line.strip() for k, d in enumerate(docs) for j, line in enumerate(d.split("\n"))}
    distinct = sorted({v for v in at.values() if len(v) >= line_dedup.MIN_CHARS})
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if abs(len(a) - len(b)) <= 2 and edit_distance(a, b) <= 2]
    root = union_find(links, distinct)
    degree = Counter(n for e in links for n in e)
    classes = {}
    for place, line in sorted(at.items()):
        if line in root:
            classes.setdefault(root[line], []).append(place)
    seen, first = {}, {line: place for place, line in sorted(at.items(), reverse=True)}
    for r in got:
        place = (r["doc_id"], r["line_no"])
        line = at.get(place, "")
        if line not in root:
            assert r["class_id"] is None and r["kept"]
            continue
        members = classes[root[line]]
        stays = members[0] if len(line) >= line_dedup.NEAR_CHARS else first[line]
        assert r["class_size"] == len(members) and r["kept"] == (place == stays) and r["n_links"] == degree[line]
        assert seen.setdefault(root[line], r["class_id"]) == r["class_id"]
    assert len(set(seen.values())) == len(classes)
    cut = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(make(docs)).collect()}
    kept = {(r["doc_id"], r["line_no"]) for r in got if r["kept"]}
    assert cut == {k: "\n".join(x for j, x in enumerate(d.split("\n")) if (k, j) in kept) for k, d in enumerate(docs)}
    assert line_dedup.line_classes(make(docs).limit(0)).count() == 0


def test_lines_look_under_few_keys_and_meet_where_cuts_change(spark):
    rng, pairs = random.Random(3), []
    lengths = [n for at in (16, 32, 64, 128, 256, 512, 576) for n in range(at - 2, at + 4)] + [100, 300, 700]
    for n in lengths:
        for kinds in ("s", "ss", "i", "ii", "is", "si"):
            a = "".join(rng.choice("abcdefgé") for _ in range(n))
            b = list(a)
            for kind in kinds:
                at = rng.randrange(len(b))
                b[at : at + (kind == "s")] = "x"
            pairs.append((a, "".join(b)))
        middle = a[: n // 6] + "x" + a[n // 6 : n - 2] + a[n - 1 :]  # the same length, and only the middle stays
        pairs.append((a[::-1], middle[::-1]))
    lines = sorted({line for pair in pairs for line in pair})
    keys = {r["line"]: r for r in line_dedup.keyed_lines(spark.createDataFrame([(line,) for line in lines], "line string")).collect()}
    under = {line: set(r["under"]) for line, r in keys.items()}
    asked = {line: under[line] | {k for k in r["further"] if k is not None} for line, r in keys.items()}
    for a, b in pairs:
        for x, y in ((a, b), (b, a)):
            assert len(x) < len(y) or asked[x] & under[y], (len(x), len(y))
    # with each length by itself all of them looked under 12
    assert max(len(k) for line, k in asked.items() if len(line) > 16) <= 9 and all(len(asked[line]) <= 5 for line in lines if len(line) in (100, 300))
    nodes = line_dedup.keyed_lines(spark.createDataFrame([(line,) for line in lines], "line string")).withColumnRenamed("hash", "id").localCheckpoint()
    linked = {frozenset((r["a"], r["b"])) for r in line_dedup.similar_lines(nodes).collect()}
    ids = {r["line"]: r["id"] for r in nodes.select("line", "id").collect()}
    assert linked >= {frozenset((ids[a], ids[b])) for a, b in pairs}


def test_only_marked_lines_are_shuffled(make, spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcd é𝄞") for _ in range(n)).strip() for n in (3, 5, 17, 19, 40, 64, 129, 600) for _ in range(6)]
    texts += [mutate(rng, text, 2) for text in texts] + ["tabs\tand\r", "tabs and"]
    nodes = line_dedup.keyed_lines(spark.createDataFrame([(x,) for x in sorted(set(texts))], "line string")).withColumnRenamed("hash", "id").localCheckpoint()
    ids = nodes.select("id").where("id % 8 = 0").localCheckpoint()
    many = nodes.select("id", "line").unionByName(spark.range(20000).select(F.xxhash64("id").alias("id"), F.lit("x").alias("line")))
    marked = [r["id"] for r in line_dedup._marked(many, ids).collect()]
    assert {r["id"] for r in ids.collect()} <= set(marked) and len(marked) < ids.count() + 50
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    monkeypatch.setattr(line_dedup, "CROWD", 8)
    plain = rows(line_dedup.line_classes(make(texts)))
    monkeypatch.setattr(line_dedup, "BROADCAST_IDS", 0)
    assert rows(line_dedup.line_classes(make(texts))) == plain


def test_line_ids_that_meet(spark, monkeypatch):
    lines = spark.createDataFrame([(f"line {k}",) for k in range(50)], "line string")
    plain = line_dedup.F.xxhash64
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c: F.pmod(plain(*c), F.lit(200)) if len(c) == 1 else plain(*c))
    ids = [r["id"] for r in lines.select(line_dedup._distinct_ids(lines).alias("id")).collect()]
    assert len(set(ids)) == 50 and any(0 <= i < 200 for i in ids) and any(not 0 <= i < 200 for i in ids)


def test_short_lines(make):
    rng = random.Random(8)
    lines = ["".join(rng.choice("abcdé") for _ in range(rng.randint(0, 7))) for _ in range(300)] + ["x" * 19, "x" * 20, "x" * 21, "quite alone"]
    docs = ["\n".join(lines[k : k + 8]) for k in range(0, len(lines), 8)]
    at = {(k, j): line for k, d in enumerate(docs) for j, line in enumerate(d.split("\n"))}
    distinct = sorted(set(at.values()) - {""})
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if abs(len(a) - len(b)) <= 2 and edit_distance(a, b) <= 2]
    root, degree, sizes = union_find(links, distinct), Counter(n for e in links for n in e), Counter()
    for line in at.values():
        sizes[root.get(line)] += 1
    found = {(r["doc_id"], r["line_no"]): r for r in line_dedup.line_classes(make(docs)).collect()}
    assert set(found) == set(at)
    for place, line in at.items():
        r = found[place]
        if line:
            assert (r["n_links"], r["class_size"]) == (degree[line], sizes[root[line]])
        else:
            assert r["class_id"] is None and r["kept"]
    assert len({r["class_id"] for r in found.values()} - {None}) == len(set(root.values()))
    # of short lines, equal ones are cut from texts
    cut = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(make(docs)).collect()}
    first = {line: place for place, line in sorted(at.items(), reverse=True)}
    assert all(found[place]["kept"] == (first[line] == place) for place, line in at.items() if 0 < len(line) < line_dedup.NEAR_CHARS)
    assert cut == {k: "\n".join(x for j, x in enumerate(d.split("\n")) if found[k, j]["kept"]) for k, d in enumerate(docs)}
    every = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(make(docs), near_chars=1).collect()}
    by_class = {(r["doc_id"], r["line_no"]): r["kept"] for r in line_dedup.line_classes(make(docs), near_chars=1).collect()}
    assert every == {k: "\n".join(x for j, x in enumerate(d.split("\n")) if by_class[k, j]) for k, d in enumerate(docs)} and sum(by_class.values()) < sum(r["kept"] for r in found.values())


def test_lines_of_rows_without_ids_of_their_own(make):
    again = "a line that stands in four of these documents"
    texts = [f"{again}\nand one line only of the first", f"only the second has this one\n{again}"] * 2
    texts = [t if k < 2 else t.replace("only", "nothing but") for k, t in enumerate(texts)]
    out = [r["text"] for r in line_dedup.drop_repeated_lines(make(texts, ids=[None, None, 5, 5])).collect()]
    own = {line for t in texts for line in t.split("\n")} - {again}
    left = [line for t in out for line in t.split("\n")]
    assert len(out) == 4 and left.count(again) == 1 and set(left) - {again} == own
    same = [f"{again}\nthe first of two at one place", f"{again}\nthe other text, of the same length"]
    for ids in ([None, None], [3, 3]):
        left = [line for r in line_dedup.drop_repeated_lines(make(same, ids=ids)).collect() for line in r["text"].split("\n")]
        assert left.count(again) == 1 and len(left) == 3


# ---------------------------------------------------------------- 3: near-duplicates


def shingles(text):
    w = (text or "").lower().split()
    if not w:
        return Counter()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def jaccard(a, b):
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 1.0


def test_signatures_are_unbiased():
    rng = random.Random(3)
    w = words(rng, 400)
    texts = [" ".join(w), " ".join(w[:330] + words(rng, 70)), " ".join(w * 2), " ".join(w[:100] * 5)]
    of, hashes, counts = minhash.shingle_bags(texts)
    s = minhash.bag_signatures(of, hashes, counts, len(texts))
    assert np.isfinite(s).all()
    for i in range(4):
        for j in range(i):
            assert abs((s[i] == s[j]).mean() - jaccard(shingles(texts[i]), shingles(texts[j]))) < 0.13


@pytest.mark.parametrize("crowd", [False, True])
def test_near_duplicates(make, crowd, monkeypatch):
    rng = random.Random(11)
    texts = [None, "", " \n", "one two", "one  TWO", "one two three four five six"]
    for _ in range(12 if not crowd else 1):
        base = words(rng, 150)
        texts.append(" ".join(base))
        for _ in range(4 if not crowd else 70):
            x = list(base)
            for _ in range(rng.randint(0, 9)):
                x[rng.randrange(150)] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(x))
    if crowd:
        monkeypatch.setattr(minhash, "SMALL", 3)
        monkeypatch.setattr(minhash, "BLOCK", 9)
    got = minhash.near_duplicates(make(texts)).collect()
    bags = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(bags[i], bags[j]) >= minhash.THRESHOLD]
    up = list(range(len(texts)))
    for _ in range(len(texts)):
        for i, j in pairs:
            up[i] = up[j] = min(up[i], up[j])
    assert {r["doc_id"]: r["class_id"] for r in got} == dict(enumerate(up))
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) and r["class_size"] == up.count(r["class_id"]) for r in got)
    kept = minhash.drop_near_duplicates(make(texts))
    assert rows(kept, "doc_id") == sorted([(k,) for k in set(up)], key=repr)
    assert kept.columns == make(texts).columns


def test_near_duplicates_around_the_threshold(make, monkeypatch):
    """Versions that mostly are not near each other: all are compared, whatever the buckets."""
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(21)
    base = words(rng, 200)
    texts = []
    for _ in range(60):
        x = list(base)
        for _ in range(rng.randint(2, 8)):
            x[rng.randrange(200)] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(x))
    bags = [shingles(t) for t in texts]
    root = union_find([(i, j) for i in range(60) for j in range(i) if jaccard(bags[i], bags[j]) >= minhash.THRESHOLD], range(60))
    assert 1 < len(set(root.values())) < 60
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(make(texts)).collect()}
    missed = sum(got[i] != got[j] for i in range(60) for j in range(i) if root[i] == root[j])
    assert missed == 0 and all(root[i] == root[j] for i in range(60) for j in range(i) if got[i] == got[j])


def test_helper_columns_do_not_meet_those_of_the_caller(spark):
    names = ["k1", "k2", "id", "key", "gone", "cuts", "__k1", "__id"]
    text = "a line of many words that stands in two of these documents and has more than twenty words in all so that it is found"
    docs = spark.createDataFrame([(k, t, *range(8)) for k, t in enumerate((text, f"another\n{text}", text))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    for drop, n in ((minhash.drop_near_duplicates, 1), (line_dedup.drop_repeated_lines, 3), (substring_dedup.drop_repeats, 3)):
        out = drop(docs)
        assert out.columns == docs.columns and [tuple(r[c] for c in names) for r in out.collect()] == [tuple(range(8))] * n


def test_classes_without_ids_are_told_apart(make):
    got = minhash.near_duplicates(make(["q w e r t", "q w e r t", "z x c v b", "z x c v b"], [None] * 4)).collect()
    assert len({r["class_id"] for r in got}) == 2 and all(r["class_size"] == 2 and r["class_id"] < 0 for r in got)


def test_near_duplicates_of_nothing_and_repeats(make):
    assert minhash.near_duplicates(make(["x"]).limit(0)).count() == 0
    assert minhash.drop_near_duplicates(make(["same text here", "same text here"], [1, 1])).count() == 1
    assert rows(minhash.near_duplicates(make(["q w e r t", "q w e r t"], [None, 3])), "class_id", "class_size") == [(3, 2), (3, 2)]


# ---------------------------------------------------------------- 4, 10: models


def test_quality(make, spark):
    rng = random.Random(5)
    good = [" ".join(words(rng, rng.randint(30, 80))).capitalize() + "." for _ in range(300)]
    bad = [" ".join(x + rng.choice(["***", "###", "!!"]) for x in words(rng, rng.randint(30, 80))).upper() for _ in range(100)]
    texts = good + bad + [None, "", "x" * 100_000]
    labels = spark.createDataFrame([(k, int(k < 300), 0) for k in range(400)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(make(texts), labels).toPandas().set_index("doc_id")
    assert len(got) == len(texts) and got.score.between(0, 1).all()
    for k, r in got.iterrows():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
    out = got[got.held_out & (got.index < 400)]
    assert ((out.predicted == 1) == (out.index < 300)).mean() > 0.97
    none = quality.quality(make(texts[:3]), labels.limit(0)).toPandas()
    assert (none.score == 0.5).all()


def test_flat_trees_match_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, len(quality.FEATURES)))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = quality.fit_trees(x, y, rounds=20)
    b = m.bins(x)
    for row in range(0, 300, 29):
        total = m.base
        for t in range(len(m.value)):
            at = 0
            for _ in range(m.depth):
                at = 2 * at + 1 + int(b[row, m.feature[t, at]] > m.cut[t, at])
            total += m.value[t, at - (2**m.depth - 1)]
        assert m.score(x[row : row + 1])[0] == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((m.score(x) > 0.5) == y).mean() > 0.9


def test_lettered_texts_stay_without_labels(make):
    docs = make(["abc def", None, "", "123 !", "\u00e9t\u00e9"])
    assert sorted(r["text"] for r in language_id.keep_known(docs).collect()) == ["abc def", "\u00e9t\u00e9"]
    assert language_id.keep_known(docs.limit(0)).count() == 0


def test_language_id(make, sf_dir, spark):
    got = language_id.language_id(spark.read.parquet(f"{sf_dir}/documents.parquet")).toPandas()
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(both.doc_id, both.held_out, strict=True))
    assert (both.lang_pred == both.lang)[both.held_out].mean() > 0.95
    odd = language_id.language_id(make([*ODD, "plain english text with words"], langs=["en"] * 15)).collect()
    for r, t in zip(sorted(odd, key=lambda r: r["doc_id"]), [*ODD, "plain english"], strict=True):
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in language_id.language_id(make(["abc def", None])).collect()} == {"und"}
    kept = language_id.keep_known(make([*ODD, "plain"], langs=["en"] * 15))
    assert kept.count() == sum(any(c.isalpha() for c in t or "") for t in [*ODD, "plain"])


# ---------------------------------------------------------------- 5, 6: chunks


def test_media(make):
    rng = random.Random(9)
    base = " ".join(words(rng, 3000))
    texts = [*ODD, base, base, "new start " + base, base[5000:], base[:9000] + " changed " + base[9000:]]
    store = media.store_media(make(texts))
    got = {r["doc_id"]: r for r in media.load_media(store).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[k]
        assert r["media"] == media.encode_wav(payload) and r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["feature"] == media.feature(payload)
    held = store.selectExpr("sum(length(own)) + sum(aggregate(shared, 0, (a, x) -> a + length(x.bytes))) AS n").first()["n"]
    assert held < 0.75 * sum(r["media_bytes"] for r in got.values())
    assert media.load_media(media.store_media(make(texts).limit(0))).count() == 0
    assert media.load_media(media.store_media(make([base, base], [1, 1]))).count() == 2


def test_damaged_media_raises(make):
    store = media.store_media(make(["some text to store"])).withColumn("own", F.expr("cast(concat(own, 'x') as binary)"))
    store = store.withColumn("lengths", F.transform("lengths", lambda n: n + 1))
    with pytest.raises(Exception, match="does not match its digest"):
        media.load_media(store).collect()


def test_chunks_cover_and_resist_shifts():
    rng = random.Random(2)
    data = " ".join(words(rng, 4000)).encode()
    found = media.chunks(data)
    assert b"".join(p for _, p in found) == data and all(len(p) <= media.LARGEST for _, p in found)
    shifted = {d for d, _ in media.chunks(b"inserted " + data)}
    assert sum(d in shifted for d, _ in found) > 0.9 * len(found)


def test_repeated_passages(make):
    rng = random.Random(6)
    unique = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    texts, planted = [], []
    for k in range(40):
        passage = unique(55 + k)
        first, second = len(texts), len(texts) + 1
        texts += [" ".join(unique(60) + passage + unique(40)), " ".join(unique(33) + passage + unique(80))]
        planted.append((first, second, " ".join(passage)))
    clean = list(range(len(texts), len(texts) + 30))
    texts += [" ".join(unique(120)) for _ in clean]
    found = substring_dedup.repeated_spans(make(texts)).collect()
    assert not {r["doc_id"] for r in found} & set(clean)
    cut = {r["doc_id"] for r in found if not r["kept"]}
    kept = {r["doc_id"] for r in found if r["kept"]}
    assert sum(b in cut and a in kept for a, b, _ in planted) >= 39 and not cut & {a for a, _, _ in planted}
    for r in found:
        whole = texts[r["doc_id"]].encode()[r["start"] : r["stop"]].decode()
        assert any(whole in p for *_, p in planted) and len(whole.split()) == r["n_words"] >= substring_dedup.MIN_WORDS
    out = {r["doc_id"]: r for r in substring_dedup.drop_repeats(make(texts)).collect()}
    for k in clean:
        assert out[k]["text"] == texts[k]
    for r in found:
        if not r["kept"]:
            whole = texts[r["doc_id"]].encode()[r["start"] : r["stop"]].decode()
            assert whole not in out[r["doc_id"]]["text"] and out[r["doc_id"]]["n_chars"] == len(out[r["doc_id"]]["text"])
    assert substring_dedup.repeated_spans(make(ODD)).where("not kept AND doc_id < 12").count() == 0
    assert substring_dedup.drop_repeats(make(texts).limit(0)).count() == 0


def test_repeated_passages_of_any_script(make):
    rng = random.Random(14)
    zh = "".join(chr(0x4E00 + rng.randrange(4000)) for _ in range(3000))
    cycle = "again and " * 200
    morse = "a"
    for _ in range(11):
        morse += morse.translate(str.maketrans("ab", "ba"))
    plain = [f"w{k}" for k in range(60)]
    twins = [" ".join([*plain[:20], m, *plain[40:]]) for m in (morse, morse.translate(str.maketrans("ab", "ba")))]
    texts = ["007 began it all. " + zh, "另一个开头" + zh + " in room 11", cycle, *twins]
    out = {r["doc_id"]: r["text"] for r in substring_dedup.drop_repeats(make(texts)).collect()}
    assert out[0] == texts[0] and out[1].endswith(" in room 11") and len(out[1]) < 400
    assert len(out[2]) < 0.2 * len(cycle)
    assert out[3] == texts[3] and morse.translate(str.maketrans("ab", "ba"))[:200] in out[4]
    digits = [f"x{k}" for k in range(30)]
    texts = [" ".join(digits), "007 began 0 1 2 " + " ".join(digits) + " 11 of 20"]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.drop_repeats(make(texts)).collect()}[1]
    assert got.startswith("007 began 0 1 2 ") and got.endswith(" 11 of 20")


def test_repeated_passages_are_whole(make):
    rng = random.Random(12)
    few = "alpha bravo charlie delta echo foxtrot golf hotel india juliet".split()
    texts = [" ".join(rng.choice(few) for _ in range(100)) for _ in range(300)]  # nearly all runs of 3 words repeat, none of 20
    assert substring_dedup.repeated_spans(make(texts)).count() == 0
    split = [t.split() for t in texts]
    # passages side by side that come from two documents, a copy with other white space, and copies of a copy
    split.append(split[0][10:50] + split[1][30:70])
    split += [split[2], split[3][:60] + split[300][20:70], split[300]]
    texts = [" ".join(w[:50]) + ("\n\n" if k == 301 else " ") + " ".join(w[50:]) for k, w in enumerate(split)]
    found = substring_dedup.repeated_spans(make(texts)).collect()
    covered = {k: set() for k in range(300, 304)}
    for r in found:
        run = texts[r["doc_id"]].encode()[r["start"] : r["stop"]].decode().split()
        assert len(run) == r["n_words"] >= substring_dedup.MIN_WORDS
        if not r["kept"]:
            assert r["first_doc"] < r["doc_id"] and f" {' '.join(run)} " in f" {' '.join(split[r['first_doc']])} "
            before = len(texts[r["doc_id"]].encode()[: r["start"]].decode().split())
            covered[r["doc_id"]] |= set(range(before, before + len(run)))
    assert covered[301] == set(range(100)) and covered[303] == set(range(80))
    assert len(covered[300]) > 60 and len(covered[302]) > 85
    out = {r["doc_id"]: r["text"] for r in substring_dedup.drop_repeats(make(texts)).collect()}
    assert all(out[k] == texts[k] for k in range(300)) and out[301] == out[303] == ""
    for k in (300, 302):
        assert out[k].split() == [w for j, w in enumerate(split[k]) if j not in covered[k]]
