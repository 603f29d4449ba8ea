"""Intermediate results in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    It is set here only where none is named and all runs on one machine, as in tests.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"/tmp/checkpoints/lumenframe-{uuid.uuid4().hex}"
        sc.setCheckpointDir(named)
    return named


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path in its terms."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends if not before."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, found = hadoop_path(spark, path)
    fs.deleteOnExit(found)
    return path


#: Spark removes the shuffle files of a write once it has ended, instead of when its plan is collected as garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Write df to the shared folder and read it back: work that two branches use is done once and lineage is cut.

    level is that of the compression, which spans the rows of a page. Give the result to discard() when it has been used.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the folders that materialize wrote for these frames; nothing may read them any more."""
    for df in frames:
        if path := getattr(df, "_scratch", None):
            fs, found = hadoop_path(df.sparkSession, path)
            fs.delete(found, True)
