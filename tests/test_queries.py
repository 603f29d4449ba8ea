"""Every query with an SQL equivalent gives its rows; streams give the batch's rows."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from lumenframe import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return str(v)[:26] if hasattr(v, "isoformat") else v


def same(df, found):
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted((tuple(cell(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(cell(r[names.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, db, name):
    same(core.queries()[name](spark, sf_dir), db.execute(core.oracle_sql()[name]))


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_other_queries_give_rows(spark, sf_dir, name):
    assert core.queries()[name](spark, sf_dir).count() > 0


def test_stream_scores_like_batch(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    from lumenframe.queries.models import SYSTEM
    from lumenframe.streaming import score

    spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(("i:a", "i:b", "i:c", "o:d")))).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = score.score(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), SYSTEM)
    q = stream.writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r["vec_id"]: r["expect o:d"] for r in score.score(batch, SYSTEM).collect()}
    assert {r["vec_id"]: r["expect o:d"] for r in spark.table("scored").collect()} == want
