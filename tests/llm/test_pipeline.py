"""The pipeline's stages: columns, effects, odd rows and the result."""

from __future__ import annotations

import pytest

import corpus_pipeline
from lumenframe.llm import queries as llm


def test_stages_in_order(make, spark):
    clean = [" ".join(f"word{k}x{j} and more" for j in range(40)) for k in range(6)]
    texts = [*clean, None, "", "123 456", clean[0] + " tail", clean[1] + "\nOne more line that stands in two documents.", clean[2] + "\nOne more line that stands in two documents."]
    docs = make(texts, langs=["en"] * len(texts))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, ""), name)
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(kept["language"]) == set(range(len(texts))) - {6, 7, 8}
    assert sum("stands in two documents" in t for t in kept["lines"].values()) == 1
    assert set(range(6)) <= set(kept["near_duplicates"]) and 9 not in kept["near_duplicates"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").toPandas()
    assert set(packed.doc_id) == set(kept["substrings"])


def test_stages_take_empty_tables(make, spark):
    docs = make(["a b c"]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, ""), name)
        assert docs.count() == 0


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 100 and "sequence_id" in got.columns


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query_runs_on_the_small_tables(spark, sf_dir, name):
    assert llm.queries()[name](spark, sf_dir).count() > 0


def test_exact_dedup_matches_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = con.execute(llm.oracle_sql()["op9_exact_dedup"])
    names = [c[0] for c in found.description]
    got = llm.queries()["op9_exact_dedup"](spark, sf_dir)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(found.fetchall())
