"""Pair tables, wide matrices, tuples and appended columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.session import ensure_checkpoint_dir


def require_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, if the columns are numbers or booleans; else a TypeError."""
    for c in columns:
        kind = df.schema[c].dataType
        if not isinstance(kind, (T.NumericType, T.BooleanType)):
            raise TypeError(f"column {c!r} is of type {kind.simpleString()}, not a number")
    return df


def from_pairs(pairs: DataFrame, columns: Sequence[str], fill: float | None = float("nan")) -> DataFrame:
    """(src, tgt, value) to one row per src with a column per target; absent pairs get `fill`."""
    wide = pairs.groupBy("src").pivot("tgt", list(columns)).agg(F.first("value"))
    return wide if fill is None else wide.select("src", *(F.coalesce(F.col(f"`{c}`"), F.lit(fill)).alias(c) for c in columns))


def as_pairs(wide: DataFrame, columns: Sequence[str], keep_nan: bool = False) -> DataFrame:
    """One row per src with a column per target to (src, tgt, value); missing values are dropped unless kept."""
    long = wide.unpivot("src", list(columns), "tgt", "value")
    return long if keep_nan else long.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))


def from_tuples(spark: SparkSession, rows: Sequence[tuple], names: Sequence[str] | None = None) -> DataFrame:
    """Tuples to a table with columns col0, col1, ...; complex numbers become (re, im). Types follow the first row."""
    plain = [tuple({"re": v.real, "im": v.imag} if isinstance(v, complex) else v for v in r) for r in rows]
    names = list(names or (f"col{k}" for k in range(len(plain[0]))))
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), dict: T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])}
    return spark.createDataFrame(plain, T.StructType([T.StructField(n, kinds[type(v)]) for n, v in zip(names, plain[0], strict=True)]))


def as_tuples(df: DataFrame) -> list[tuple]:
    """Rows of a small table as tuples."""
    return [tuple(r) for r in df.collect()]


def add_columns(left: DataFrame, right: DataFrame, order: Sequence[str], right_order: Sequence[str] | None = None) -> DataFrame:
    """Columns of right appended to left by row number under the given orders. Rows without a partner are dropped."""
    return number_rows(left, order).join(number_rows(right, right_order or order), "__row").drop("__row")


def number_rows(df: DataFrame, order: Sequence[str], name: str = "__row") -> DataFrame:
    """df with its 0-based row number in a total order, without bringing rows together.

    A sort ranges the rows over partitions; a row's number is its place there plus the sizes of the partitions before.
    The placed rows are checkpointed, since ranges are drawn anew whenever a sort runs.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()).checkpoint().withColumn("__part", F.shiftright("__id", 33))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    base = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__base"))  # a row per partition
    at = F.col("__base") + F.col("__id").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(base), "__part").withColumn(name, at).drop("__id", "__part", "__base")


def latest_wins(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Union in which later tables replace rows of earlier ones with the same key."""
    ranked = [t.withColumn("__rank", F.lit(k)) for k, t in enumerate(tables)]
    whole = ranked[0]
    for t in ranked[1:]:
        whole = whole.unionByName(t)
    return whole.withColumn("__last", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__rank")))).where("__last = 1").drop("__rank", "__last")


def distinct_in_order(df: DataFrame, key: str, position: str) -> DataFrame:
    """Each key once, at its first position."""
    return df.groupBy(key).agg(F.min(position).alias(position))
