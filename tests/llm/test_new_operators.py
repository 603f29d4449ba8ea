"""Toxicity, whitening and collocations against plain versions, on small and odd inputs."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from lumenframe.llm import collocations, toxicity, whitening
from lumenframe.llm import queries as llm

# ---------------------------------------------------------------- 13: collocations


def plain_collocations(texts, langs, least, covered=80, top=2000, longest=4):
    count, total = {}, Counter()
    for text, lang in zip(texts, langs, strict=True):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            own = count.setdefault(lang or "und", Counter())
            total[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in count.items():
        found = []
        for p, a in own.items():
            if len(p) < 2 or a < least:
                continue
            cuts = [(2000000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(100 * f >= covered * a for q, f in own.items() if len(q) > len(p) and f >= least and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def as_rows(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def corpus(seed, docs=120):
    rng = random.Random(seed)
    vocab = ["New", "york", "city", "of", "the", "Ünïon", "a", "b", "über", "日本", "x.y", "o'clock", "WELL", "don't", "is"]
    texts = []
    for _ in range(docs):
        parts = [rng.choice(vocab + ["new York city"] * 3 + ["out of the blue"] * 2) + rng.choice([" ", "  ", "\t", " ", ". ", ",", "\n", "\x0b", "\r\n"]) for _ in range(rng.randrange(1, 120))]
        texts.append("".join(parts))
    return texts, [rng.choice(["en", "en", "de", None, "und"]) for _ in texts]


@pytest.mark.parametrize("least,top", [(30, 2000), (5, 2000), (3, 7)])
def test_collocations(make, least, top):
    texts, langs = corpus(least)
    texts += [None, "", " \t ", "..", "one"]
    langs += ["en", "fr", "fr", None, None]
    assert as_rows(collocations.collocations(make(texts, langs=langs), least=least, top=top)) == plain_collocations(texts, langs, least, top=top)


def test_collocations_slices_and_long_texts(make, monkeypatch):
    texts, langs = corpus(9, 60)
    monkeypatch.setattr(collocations, "SLICE", 500)
    long = ["word " * 60000 + " ".join(texts), " " * 2_000_000 + "a b", "z" * 2_000_000]
    got = as_rows(collocations.collocations(make(texts + long, langs=langs + ["en"] * 3), least=4))
    assert got == plain_collocations(texts + long, langs + ["en"] * 3, 4)


def test_collocations_repeats_and_empty(make):
    same = make(["a b c"] * 40, ids=[None] * 20 + [1] * 20, langs=["en"] * 40)
    assert as_rows(collocations.collocations(same)) == [("en", 1, "a b c", 40, 40, 40, 120, 1000000)]
    assert collocations.collocations(make(["a b"]).limit(0)).count() == 0
    assert collocations.collocations(make([None, "a b"])).count() == 0


def test_bit_map_has_no_misses():
    words = [f"w{k}é" for k in range(5000)]
    raw = [w.encode() for w in words]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    bits = np.zeros(collocations.BITS // 64, dtype=np.uint64)
    for at in collocations._marks("en", offsets, data):
        np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    assert collocations._marked("en", offsets, data, bits).all()
    assert not collocations._marked("de", offsets, data, bits).any()


def test_collocations_match_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = con.execute(llm.oracle_sql()["op13_collocations"])
    names = [c[0] for c in found.description]
    got = llm.queries()["op13_collocations"](spark, sf_dir)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(found.fetchall())


# ---------------------------------------------------------------- 12: whitening

VECTORS = "vec_id long, embedding array<float>, label int, v int, n string"


def vectors(spark, values, ids=None):
    return spark.createDataFrame([(k if ids is None else ids[k], v, 0, 1, "x") for k, v in enumerate(values)], VECTORS).repartition(3)


def test_error_free_sums_and_products():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=500) * 10.0 ** rng.integers(-8, 8, 500), rng.normal(size=500)
    s, e = whitening.two_sum(a, b)
    assert all(Fraction(x) + Fraction(y) == Fraction(p) + Fraction(q) for x, y, p, q in zip(a, b, s, e, strict=True))
    high, low = whitening.halves(a)
    assert (high + low == a).all()
    high, low = whitening.total((a, np.zeros(500)))
    exact = sum(map(Fraction, a.tolist()))
    assert abs(Fraction(float(high)) + Fraction(float(low)) - exact) <= abs(exact) * Fraction(1, 10**28) + Fraction(1, 10**20)


def test_whitening_against_exact_sums(spark):
    rng = np.random.default_rng(3)
    d, m = 5, 240
    x = (rng.normal(size=(m, d)) @ rng.normal(size=(d, d)) + 3).astype(np.float32)
    odd = [None, [1.0] * 4 + [float("nan")], [float("inf")] + [0.0] * 4, [None] + [0.0] * 4, [], [1.0, 2.0], [1e30] * 5]
    ids = [*range(m - 2), None, 0, *range(900, 900 + len(odd))]
    got = whitening.whitening(vectors(spark, [v.tolist() for v in x] + odd, ids)).toPandas()
    whole = [[math.floor(64 * float(c)) + 1000000 for c in v] for v in x]
    sums = [sum(c) for c in zip(*whole, strict=True)]
    assert len(got) == m * d and set(got.n) == {m}
    q = [[m * c - s for c, s in zip(v, sums, strict=True)] for v in whole]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in q), m**3)) for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    for k in range(1, d + 1):
        part = got[(got.component == k) & got.vec_id.notna() & (got.vec_id > 0)].set_index("vec_id").sort_index()
        want = np.array(q[1 : m - 2]) / m @ axes[:, k - 1] / np.sqrt(values[k - 1])
        w = part.whitened.to_numpy()
        assert np.allclose(w, want * np.sign(w @ want), atol=1e-9)
        assert part.deviation.tolist() == [sum(c * c for c in r) for r in q[1 : m - 2]]
        assert np.allclose(part.explained, values[k - 1] / np.trace(cov), rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    assert (got[got.vec_id == 0].groupby("component").size() == 2).all() and got.vec_id.isna().sum() == d


def test_vectors_are_exact_where_eigenvalues_are_close():
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    a = (turn * np.concatenate((np.full(6, 3.0) + np.arange(6) * 1e-6, np.arange(1, 7)))) @ turn.T
    a = (a + a.T) / 2
    values, axes = whitening.components((a, np.zeros_like(a)))
    wide = axes.astype(np.longdouble)
    assert np.abs(a @ wide - wide * values).max() < 2e-15 and np.abs(wide.T @ wide - np.eye(12)).max() < 1e-15
    assert (np.diff(values) <= 0).all()


def test_whitening_keeps_large_offsets_and_drops_flat_components(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(-3, 4, size=(400, 3)) / 64 + 2.0**17
    flat = np.concatenate([base, np.full((400, 1), 5.0)], axis=1)
    got = whitening.whitening(vectors(spark, flat.tolist())).toPandas()
    assert set(got.component) == {1, 2, 3} and got.identity_error[0] < 1e-10
    assert np.isclose(got.groupby("component").explained.first().sum(), 1)


@pytest.mark.parametrize("values", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 9, [None, []]])
def test_whitening_without_variance(spark, values):
    got = whitening.whitening(spark.createDataFrame([(k, v, 0, 1, "x") for k, v in enumerate(values)], VECTORS))
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_of_any_size():
    x = np.array([[2**45, 1], [0, 5]], dtype=np.int64)
    sums = [int(s) for s in x.sum(axis=0)]
    y, deviation = whitening._deviations(x, 2, sums)
    assert deviation == [None, None] and y[0, 1] == -2
    y, deviation = whitening._deviations(x % 1000, 2, [int(s) for s in (x % 1000).sum(axis=0)])
    assert deviation == [(2 * (2**45 % 1000) - 2**45 % 1000) ** 2 + 16] * 2


# ---------------------------------------------------------------- 11: toxicity

BAD = {"en": ["idiot", "moron", "trash"], "de": ["lowequark", "lowestrunz"], "fr": ["vequoi", "vequaire"]}
GOOD = {"en": "the of and to is that for with house tree road", "de": "der die und das den von mit ist haus baum weg", "fr": "le les des est dans pour une maison arbre rue"}


def labelled(n, seed=0):
    rng = random.Random(seed)
    texts, langs, toxic = [], [], []
    for _ in range(n):
        lang = rng.choice(["en", "en", "de", "fr"])
        words = [rng.choice(GOOD[lang].split() + [f"w{rng.randrange(400)}"]) for _ in range(rng.randrange(5, 200))]
        bad = rng.random() < 0.2
        for _ in range(rng.randrange(1, 4) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(BAD[lang]).upper() + rng.choice(["", "!", ","])
        texts.append(" ".join(words))
        langs.append(lang)
        toxic.append(int(bad))
    return texts, langs, toxic


@pytest.fixture(scope="module")
def sample():
    return labelled(1500)


def test_toxicity_on_held_out_rows(make, spark, sample):
    texts, langs, toxic = sample
    odd = [None, "", " ", "!!", "日本語", "word " * 300_000 + "IDIOT.", " " * 2_000_000 + "idiot", "\n" * 2_000_000, "q" * 2_000_000]
    docs = make(texts + odd + texts[:1], ids=[*range(len(texts) + len(odd)), None], langs=langs + ["en"] * len(odd) + ["xx"])
    labels = spark.createDataFrame([(k, 1, t) for k, t in enumerate(toxic)] + [(10**7, 1, 1), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(texts) + len(odd) + 1
    held = [k for k in range(len(texts)) if got[k]["held_out"]]
    assert 0.15 < len(held) / len(texts) < 0.35
    assert np.mean([got[k]["predicted"] == toxic[k] for k in held]) > 0.97
    n = len(texts)
    assert [got[n + k]["predicted"] for k in (0, 1, 2, 3, 7, 8)] == [0] * 6 and got[n + 5]["predicted"] == 1 and got[n + 6]["predicted"] == 1
    assert got[n]["score"] == got[n + 1]["score"] == got[n + 7]["score"]
    assert got[None]["score"] == got[0]["score"]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_scores_do_not_read_other_columns(make, spark, sample):
    texts, langs, toxic = sample
    texts, langs, toxic = texts[:300], langs[:300], toxic[:300]
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    score = lambda langs: {r["doc_id"]: r["score"] for r in toxicity.toxicity(make(texts, langs=langs), labels).collect()}
    assert score(langs) == score([None] * len(texts))


def test_toxicity_without_labels(make, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(make(["a b", None]), none).collect()} == {0.0}
    ones = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(make(["a b"] * 20), ones).collect()} == {1.0}
    assert toxicity.toxicity(make(["a"]).limit(0), none).count() == 0


def test_toxicity_learns_from_long_texts(make, spark):
    rng = random.Random(4)
    text = lambda bad: " ".join(rng.choices(GOOD["en"].split(), k=8_500 if bad else 40) + ["moron"] * bad)
    toxic = [k % 3 == 0 for k in range(150)]
    docs = make([text(t) for t in toxic] + ["the moron", "the house"])
    labels = spark.createDataFrame([(k, int(t)) for k, t in enumerate(toxic)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, labels).collect()}
    assert [got[k] for k in range(152)] == [int(t) for t in toxic] + [1, 0]


def test_toxicity_learns_from_all_rows(make, spark, sample, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 200)
    texts, _, toxic = sample
    labels = spark.createDataFrame([(k, t) for k, t in enumerate(toxic)] + [(10**7, 1), (7, 1 - toxic[7])], "doc_id long, toxic int")
    rows = toxicity.labelled_words(make(texts), labels).collect()
    assert sorted((r["words"], r["label"]) for r in rows) == sorted((toxicity.hashed_words(t).astype("<u2").tobytes(), y) for t, y in [*zip(texts, toxic), (texts[7], 1 - toxic[7])])
    sizes = Counter(r["shard"] for r in rows)
    assert len(sizes) == 8 and max(sizes.values()) < 300
    nets = [toxicity.fit_toxicity(make(texts).repartition(n), labels) for n in (1, 5)]
    assert np.array_equal(*(toxicity.weights_of(net) for net in nets)) and np.array_equal(*(net.cut for net in nets))
    batch = toxicity.Batch([toxicity.hashed_words(t) for t in texts])
    assert np.mean((nets[0].score(batch) >= toxicity.THRESHOLD) == np.array(toxic)) > 0.97


def test_pooling_is_that_of_a_plain_convolution(monkeypatch):
    rng = np.random.default_rng(2)
    net = toxicity.Net()
    for t in net.tables:
        t[: toxicity.BUCKETS] = rng.normal(size=(toxicity.BUCKETS, toxicity.DIMENSIONS))
    texts = [toxicity.hashed_words(" ".join(f"w{rng.integers(50)}" for _ in range(n))) for n in (0, 1, 2, 3, 40, 7)]
    batch = toxicity.Batch(texts)
    monkeypatch.setattr(toxicity, "BLOCK", 6)
    best, where = net.pooled(batch, places=True)
    for k, t in enumerate(texts):
        x = np.zeros((max(1, len(t)) + 2 * toxicity.GAP, toxicity.DIMENSIONS), dtype=np.float32)
        x[: len(t)] = net.embed(t)
        for w, f in enumerate(net.filters):
            z = np.stack([sum(x[i + j] @ f[j] for j in range(len(f))) + net.bias[w] for i in range(max(1, len(t)) + toxicity.GAP)])
            own = slice(w * toxicity.FILTERS, (w + 1) * toxicity.FILTERS)
            assert np.allclose(best[k, own], z.max(axis=0), atol=1e-4)
            assert np.allclose(z[where[k, own] - batch.start[k], np.arange(toxicity.FILTERS)], z.max(axis=0), atol=1e-4)


def test_thresholds_by_language():
    assert toxicity.best_cut(np.array([3.0, 1.0, 0.0, -1.0]), np.array([1, 1, 0, 0]), np.ones(4)) == 0.5
    words = [toxicity.hashed_words(t) for t in ("Der Baum ist auf dem Weg", "the house is on the road", "123 xyz", "", "le chat est dans une rue")]
    names = ["", *toxicity.FUNCTION_WORDS]
    assert [names[k] for k in toxicity.Batch(words).languages()] == ["de", "en", "", "", "fr"]


# ---------------------------------------------------------------- very long runs of one character

LONG = [" " * 2_000_000, "\n" * 2_000_000, "z" * 2_000_000, "a" + "\t" * 1_000_000 + "b c", "word " * 300_000]


def test_long_runs_in_token_operators(make):
    from tokenizers import Tokenizer

    from lumenframe.llm import bpe, packing, token_counts
    from lumenframe.llm.subword import vocabulary_path

    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in LONG]
    docs = make(LONG, ids=[1, 2, None, 2, 5])
    packed = packing.pack(docs).toPandas()
    assert packed.groupby("doc_id", dropna=False).length.sum().tolist() == [want[0] + 1, want[1] + want[3] + 2, want[4] + 1, want[2] + 1]
    counted = token_counts.count_tokens(docs)
    assert sorted(r["n_tokens"] for r in counted.collect()) == sorted(want)
    words = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    words.no_truncation()
    assert sorted(r["n_tokens"] for r in bpe.bpe_digests(docs).collect()) == sorted(len(words.encode(t, add_special_tokens=False).ids) for t in LONG)


def test_unknown_characters_are_an_error():
    from lumenframe.llm import bpe

    vocab = {"a": 0, "b</w>": 1, "b": 2, "a</w>": 3, "ab</w>": 4}
    table = bpe.MergeTable({"model": {"vocab": vocab, "merges": [["a", "b</w>"]], "end_of_word_suffix": "</w>"}, "added_tokens": []})
    assert table.encode_word("ab") == [4]
    with pytest.raises(ValueError, match="lacks"):
        table.encode_word("zb")


# ---------------------------------------------------------------- 6: recall of repeated passages


def runs_of(split, least=20):
    """Maximal runs (doc, lo, hi) of words that stand in an earlier document, and every run of `least` words with its first place."""
    seen, out = {}, []
    for k, w in enumerate(split):
        hit = [tuple(w[i : i + least]) in seen for i in range(len(w) - least + 1)]
        i = 0
        while i < len(hit):
            if hit[i]:
                j = i
                while j < len(hit) and hit[j]:
                    j += 1
                out.append((k, i, j - 1 + least))
                i = j
            i += 1
        for i in range(len(w) - least + 1):
            seen.setdefault(tuple(w[i : i + least]), k)
    return out


@pytest.mark.parametrize("size,share", [(20, 0.9), (24, 0.98), (30, 1.0)])
def test_recall_of_planted_passages(make, size, share):
    from lumenframe.llm import substring_dedup

    rng = random.Random(size)
    vocabulary = [f"w{k}" for k in range(300)]
    pick = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    split = []
    for _ in range(200):
        passage = pick(size)
        split += [pick(rng.randrange(20, 60)) + passage + pick(rng.randrange(20, 60)) for _ in range(2)]
    texts = [" ".join(w) for w in split]
    found = {}
    for r in substring_dedup.repeated_spans(make(texts)).where("not kept").collect():
        part = texts[r["doc_id"]].encode()[r["start"] : r["stop"]].decode()
        assert len(part.split()) == r["n_words"] >= 20 and r["first_doc"] < r["doc_id"]
        assert f" {part} " in f" {texts[r['first_doc']]} "
        found.setdefault(r["doc_id"], []).append((len(texts[r["doc_id"]].encode()[: r["start"]].decode().split()), r["n_words"]))
    want = runs_of(split)
    assert len(want) >= 199
    hit = sum(any(lo <= at and at + n <= hi + 1 or at <= lo and hi <= at + n for at, n in found.get(k, ())) for k, lo, hi in want)
    whole = sum(any(at <= lo and hi <= at + n for at, n in found.get(k, ())) for k, lo, hi in want)
    assert hit / len(want) >= share and whole >= hit - 2


def test_recall_on_the_small_tables(spark, sf_dir):
    from lumenframe.llm import substring_dedup

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    ids = sorted(texts)
    split = [re.findall(r"[^\x20\x09-\x0D]+", texts[k]) for k in ids]
    covered = {k: set() for k in range(len(ids))}
    place = {k: i for i, k in enumerate(ids)}
    for r in substring_dedup.repeated_spans(docs).where("not kept").collect():
        raw = texts[r["doc_id"]].encode()
        part = re.findall(r"[^\x20\x09-\x0D]+", raw[r["start"] : r["stop"]].decode())
        assert len(part) == r["n_words"] and f" {' '.join(part)} " in f" {' '.join(split[place[r['first_doc']]])} "
        at = len(re.findall(r"[^\x20\x09-\x0D]+", raw[: r["start"]].decode()))
        covered[place[r["doc_id"]]] |= set(range(at, at + len(part)))
    want = runs_of(split)
    found = sum(len(covered[k] & set(range(lo, hi))) >= 20 for k, lo, hi in want)
    assert want and found / len(want) >= 0.97


# ---------------------------------------------------------------- ids, lengths and empty tables in the earlier operators


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_null_and_repeated_ids(make, spark):
    from lumenframe.llm import bpe, language_id, packing, quality, token_counts

    texts = [f"the house number {k} is on the road and it is red" for k in range(6)] + [None]
    ids, langs = [None, None, 1, 1, 2, 2, 3], ["en"] * 7
    docs, plain = make(texts, ids=ids, langs=langs), make(texts, langs=langs)
    same = lambda got, want, *c: by_row(got, "doc_id", *c) == sorted([(ids[r[0]], *r[1:]) for r in by_row(want, "doc_id", *c)], key=repr)
    assert same(token_counts.count_tokens(docs), token_counts.count_tokens(plain), "n_tokens")
    assert same(bpe.bpe_digests(docs), bpe.bpe_digests(plain), "n_tokens", "ids_sha256", "decoded_sha256")
    assert same(packing.pack(docs), packing.pack(plain), "start", "length", "ids_crc32", "doc_tokens")
    profiles = language_id.fit_profiles(plain)
    assert same(language_id.identify(docs, profiles), language_id.identify(plain, profiles), "lang_pred", "score")
    trees = quality.fit_quality(plain, spark.createDataFrame([(k, k % 2) for k in range(7)], "doc_id long, quality int"))
    assert same(quality.score_quality(docs, trees), quality.score_quality(plain, trees), "score", "predicted")


def test_long_runs_in_all_operators(make, spark):
    from lumenframe.llm import exact_dedup, language_id, line_dedup, media, minhash, quality, substring_dedup

    long = [t[:100_000] for t in LONG]
    docs = make([*long, long[2]], ids=[1, 2, None, 2, 5, 6], langs=["en"] * 6)
    assert quality.quality(docs, spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int")).count() == 6
    assert [r["n_bytes"] for r in media.load_media(media.store_media(docs), with_media=False).orderBy("n_bytes").collect()] == sorted(len(t) for t in [*long, long[2]])
    found = exact_dedup.exact_dedup(docs)
    assert found.count() == 6 and found.where("group_size > 1").count() == 4  # blanks equal line ends
    assert language_id.language_id(docs).where("lang_pred <> 'und'").count() <= 4
    assert minhash.near_duplicates(docs).count() == 6
    assert substring_dedup.drop_repeats(docs).count() == 6
    assert line_dedup.drop_repeated_lines(docs).count() == 6


def test_empty_tables(make, spark):
    from lumenframe.llm import language_id, media, quality

    docs, labels = make(["a b"]).limit(0), spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality(docs, labels).count() == language_id.language_id(docs).count() == media.load_media(media.store_media(docs)).count() == 0


def test_pipeline_with_null_and_repeated_ids(make, spark):
    import corpus_pipeline

    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice("the of and to house road tree water stone light green is that for with".split()) + rng.choice(["", "", "s", "ly", str(rng.randrange(900))]) for _ in range(n))
    texts = [prose(150) for _ in range(8)] + [None, "", LONG[0][:50_000] + "a word", LONG[4][:50_000]]
    docs = make([*texts, *texts[:3]], ids=[None, None, 1, 1, 2, 2, None, 7, 8, 9, 10, None, 12, 1, 2], langs=["en"] * 15)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = corpus_pipeline.materialize(stage(spark, docs, ""), name)
        assert 0 < docs.count() <= before and docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name
    left = [r["text"] for r in docs.collect()]
    assert all(sum(t[:200] in x for x in left) == 1 for t in texts[:8])
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").selectExpr("count(distinct sequence_id) as n").first()["n"] > 0
