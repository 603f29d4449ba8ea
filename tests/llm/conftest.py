from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, with ids from 0 unless given, and extra columns whose names operators use inside."""

    def build(texts, ids=None, langs=None):
        rows = [(k if ids is None else ids[k], t, None if langs is None else langs[k], "s", None if t is None else len(t), 7, b"x") for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS + ", row long, bag binary").repartition(3, "source") if len(rows) > 50 else spark.createDataFrame(rows, DOCS + ", row long, bag binary")

    return build
