"""Workspaces: a folder with a configuration and typed subfolders, listed as a catalog and registered as views."""

from __future__ import annotations

import configparser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.sources import networks, tables
from lumenframe.sources.networks import read_text

#: The kinds of objects and their folders.
FOLDERS = {"dataset": "datasets", "network": "networks", "system": "systems", "model": "models", "script": "scripts"}
SYSTEM_TYPES = ("ini", "txt", "bundle")


def read_workspace_config(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    """Sections `workspace` (description, maintainer, email, startup_script) and `folders`."""
    config = configparser.ConfigParser(interpolation=None, strict=False)
    config.read_string(read_text(spark, path))
    return {s: dict(config[s]) for s in ("workspace", "folders") if config.has_section(s)}


def catalog(spark: SparkSession, root: str, workspace: str | None = None) -> DataFrame:
    """(kind, name, branch, filetype, path, size) of all readable objects under a workspace folder.

    Files are listed by Spark, on any file system; their contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    # a bundle, and a table written in parts, is a folder: its files count as one object
    inside = r"^(.*/(?:" + "|".join(FOLDERS.values()) + r")/[^/]+\.[^./]+)/.*$"
    files = files.withColumn("path", F.when(F.col("path").rlike(inside), F.regexp_extract("path", inside, 1)).otherwise(F.col("path"))).groupBy("path").agg(F.sum("length").alias("length"))
    folder = F.element_at(F.split("path", "/"), -2)
    base = F.element_at(F.split("path", "/"), -1)
    kind = F.coalesce(*(F.when(folder == f, F.lit(k)) for k, f in FOLDERS.items()))
    ending = F.lower(F.regexp_extract(base, r"\.([^.]+)$", 1))
    readable = {"dataset": list(tables.READABLE), "network": list(networks.READABLE), "system": list(SYSTEM_TYPES), "model": ["bundle"], "script": ["py"]}
    stem = F.regexp_replace(base, r"\.[^.]+$", "")
    listed = files.select(kind.alias("kind"), F.regexp_extract(stem, r"^([^.]*)", 1).alias("name"), F.regexp_extract(stem, r"^[^.]*\.(.*)$", 1).alias("branch"), ending.alias("filetype"), "path", F.col("length").alias("size"))
    ok = F.lit(False)
    for k, kinds in readable.items():
        ok = ok | ((F.col("kind") == k) & F.col("filetype").isin(kinds))
    out = listed.where(ok)
    return out.withColumn("workspace", F.lit(workspace)) if workspace else out


def find(listing: DataFrame, kind: str, name: str) -> str:
    """Path of an object: by its name, else as `name.default`; several matches are an error."""
    rows = listing.where((F.col("kind") == kind) & (F.col("name") == name.partition(".")[0])).collect()
    branch = name.partition(".")[2]
    for wanted in ((branch,) if branch else ("", "default")):
        if len(hits := [r for r in rows if r["branch"] == wanted]) == 1:
            return hits[0]["path"]
        if len(hits) > 1:
            raise ValueError(f"{kind} {name!r} is ambiguous")
    raise ValueError(f"{kind} {name!r} is not in the workspace")


def register_views(spark: SparkSession, listing: DataFrame) -> list[str]:
    """Every dataset of the listing as a temporary view of its name."""
    made = []
    for r in listing.where("kind = 'dataset'").orderBy("name").collect():
        df = next(iter(tables.read_dataset(spark, r["path"], r["filetype"]).tables.values()))
        df.createOrReplaceTempView(r["name"])
        made.append(r["name"])
    return made
