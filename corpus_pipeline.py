"""Corpus pipeline: five stages that each apply one operator to all that the stage before kept.

Every stage but the last returns the columns of documents; the last returns packed pieces. Results between stages are
written to the shared folder as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import language_id, line_dedup, minhash, packing, substring_dedup
from lumenframe.llm.common import materialize, read_documents
from lumenframe.session import ship


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which no language is recognised: null texts and texts without a letter."""
    ship(spark)
    return language_id.keep_known(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut lines that repeat an earlier line, up to two edits; documents stay, if need be with an empty text."""
    ship(spark)
    return line_dedup.drop_repeated_lines(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    ship(spark)
    return minhash.drop_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that stand in an earlier document or place; documents stay, if need be with an empty text."""
    ship(spark)
    return substring_dedup.drop_repeats(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of all documents."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language", keep_known_language),
    ("lines", drop_repeated_lines),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("substrings", drop_repeated_passages),
    ("packing", pack_documents),
]
#: Tokenising and signatures have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents."""
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
