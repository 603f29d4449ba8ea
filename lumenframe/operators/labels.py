"""Label conversion by lookup, and label text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.arrays import number_rows


def convert(labels: DataFrame, lookup: DataFrame | None = None, prefix: str = "X") -> DataFrame:
    """(position, label, converted, lost): labels looked up after a leading `prefix` is stripped.

    labels: (position, label); lookup: (source, target), or None for the identity. Repeats of a converted label are
    numbered -2, -3, ... by position; labels without a match are lost and stay null.
    """
    bare = labels.withColumn("source", F.regexp_replace(F.trim("label"), f"^{prefix}+", ""))
    if lookup is None:
        found = bare.select("position", "label", F.col("label").alias("target"))
    else:
        first = lookup.groupBy("source").agg(F.min("target").alias("target"))
        found = bare.join(first, "source", "left").select("position", "label", "target")
    # repeats are numbered by a range sort, so that a frequent label does not meet in one task
    kept = number_rows(found.where("target IS NOT NULL"), ["target", "position"], "__at")
    first = kept.groupBy("target").agg(F.min("__at").alias("__first"))
    k = F.col("__at") - F.col("__first") + 1
    named = F.when(k == 1, F.col("target")).otherwise(F.concat("target", F.lit("-"), k.cast("string")))
    made = kept.join(first, "target").select("position", "label", named.alias("converted"), F.lit(False).alias("lost"))
    return made.unionByName(found.where("target IS NULL").select("position", "label", F.col("target").alias("converted"), F.lit(True).alias("lost")))


def full_name(name: Column, branch: Column, version: Column) -> Column:
    """name.branch.version, without the parts that are null."""
    return F.concat_ws(".", name, branch, version.cast("string"))


def tex_label(label: Column) -> Column:
    """abc12 becomes ${abc}_{12}$."""
    stem, digits = _parts(label)
    return F.concat(F.lit("${"), stem, F.lit("}_{"), digits, F.lit("}$"))


def label_width(label: Column) -> Column:
    stem, digits = _parts(label)
    return F.length(stem) + 0.7 * F.length(digits)


def _parts(label: Column) -> tuple[Column, Column]:
    return F.regexp_extract(label, "^(.*?)([0-9]*)$", 1), F.regexp_extract(label, "^(.*?)([0-9]*)$", 2)
