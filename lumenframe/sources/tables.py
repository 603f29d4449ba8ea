"""Numeric tables: delimited text with `# key = value` lines in front, and parquet bundles."""

from __future__ import annotations

import ast
import csv
import io
import json
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.operators.dataset import LABEL, Dataset

SEPARATORS = {"csv": ",", "tsv": "\t", "tab": "\t"}
READABLE = {"csv": "delimited", "tsv": "delimited", "tab": "delimited", "bundle": "parquet"}


def filetypes(kind: str | None = None) -> dict[str, str] | str:
    """Readable file types and their backends, or the backend of one."""
    if kind is None:
        return dict(READABLE)
    if kind not in READABLE:
        raise ValueError(f"unknown file type {kind!r}")
    return READABLE[kind]


def read_metadata(spark: SparkSession, path: str) -> dict[str, object]:
    """Values of the comment lines in front of the table, however many: more lines are read until the first other one."""
    meta: dict[str, object] = {}
    n = 200
    while True:
        lines = [row[0].strip() for row in spark.read.text(path).limit(n).collect()]
        for line in lines:
            if line and not line.startswith("#"):
                return meta
            key, eq, value = line.lstrip("# ").partition("=")
            if eq:
                meta[key.strip()] = _typed(key.strip(), value.strip())
        if len(lines) < n:
            return meta
        n *= 4


def _typed(key: str, value: str) -> object:
    if key == "version":
        return int(value)
    if key == "preprocessing":
        return ast.literal_eval(value)
    return value


#: Value of the header line `escapes` of files in which a backslash stands before n, r, N and itself in labels.
ESCAPES = "backslash"


def _escaped(label: Column) -> Column:
    """A label without line ends: `\\n`, `\\r` and `\\\\` for them and the backslash, `\\N` for no label."""
    made = F.replace(label, F.lit("\\"), F.lit("\\\\"))
    for char, name in (("\n", "n"), ("\r", "r")):
        made = F.replace(made, F.lit(char), F.lit("\\" + name))
    return F.coalesce(made, F.lit("\\N"))


def _plain(label: Column) -> Column:
    """The label that _escaped wrote."""
    parts = F.transform(F.split(F.coalesce(label, F.lit("")), r"\\\\", -1), lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.when(label == "\\N", F.lit(None).cast("string")).otherwise(F.array_join(parts, "\\"))


def read_delimited(spark: SparkSession, path: str, separator: str | None = None, types: Sequence[str] | None = None) -> Dataset:
    """One table named after the file (or by its metadata). The first header cell, often blank, becomes `label`.

    All other columns are doubles unless `types` says otherwise; what is not a number is null. Labels come back as
    write_delimited got them, blanks, quotes, line ends and missing ones included.
    """
    meta = read_metadata(spark, path)
    ending = PurePosixPath(path).suffix.lstrip(".").lower()
    reader = spark.read.option("header", True).option("comment", "#").option("sep", separator or SEPARATORS.get(ending, ",")).option("escape", '"')
    names = reader.csv(path).columns
    kinds = types or ["double"] * (len(names) - 1)
    schema = T.StructType([T.StructField(LABEL, T.StringType()), *(T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(names[1:], kinds, strict=True))])
    table = reader.option("enforceSchema", True).schema(schema).csv(path)
    if meta.pop("escapes", None) == ESCAPES:
        table = table.withColumn(LABEL, _plain(F.col(LABEL)))
    name = str(meta.get("name") or PurePosixPath(path).stem)
    return Dataset({name: table}, fractions={name: 1.0}, meta=meta)


def read_dataset(spark: SparkSession, path: str, kind: str | None = None) -> Dataset:
    """A dataset by the ending of its path."""
    kind = kind or PurePosixPath(path).suffix.lstrip(".").lower()
    if filetypes(kind) == "parquet":
        return read_bundle(spark, path)
    return read_delimited(spark, path, SEPARATORS[kind])


def _csv_line(cells: Sequence[str], separator: str) -> str:
    out = io.StringIO()
    csv.writer(out, delimiter=separator, quoting=csv.QUOTE_ALL, lineterminator="").writerow(cells)
    return out.getvalue()


def write_delimited(dataset: Dataset, path: str, separator: str = ",", table: str | None = None) -> None:
    """One table as delimited text parts, written by the tasks; each part begins with the metadata, as comment lines, and the names.

    Cells are quoted, with quotes doubled. Line ends and backslashes in labels are escaped, so that a file can be split
    at any line; the header says so.
    """
    name = table or next(iter(dataset.tables))
    df = dataset.tables[name]
    rest = [c for c in df.columns if c != LABEL]
    meta = {"name": name} | dataset.meta | {"escapes": ESCAPES}
    flat = lambda v: str(v).replace("\r", " ").replace("\n", " ")
    head = "\n".join([*(f"# {flat(k)} = {flat(v)}" for k, v in meta.items()), _csv_line([LABEL, *rest], separator)])
    cells = F.struct(_escaped(F.col(LABEL).cast("string")).alias("label"), *(F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate(rest)))
    options = {"sep": separator, "quoteAll": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": "", "nullValue": ""}
    line = F.to_csv(cells, options)
    # the first row of a partition carries the head of its part
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    lines = df.select(F.when(first, F.concat(F.lit(head + "\n"), line)).otherwise(line).alias("value"))
    if df.isEmpty():
        lines = df.sparkSession.createDataFrame([(head,)], "value string").coalesce(1)
    lines.write.mode("overwrite").text(path)


def write_dataset(dataset: Dataset, path: str, kind: str | None = None, table: str | None = None) -> None:
    """A dataset by the ending of its path: one table as delimited text, or all of them as a bundle."""
    kind = kind or PurePosixPath(path).suffix.lstrip(".").lower()
    if filetypes(kind) == "parquet":
        write_bundle(dataset, path)
    else:
        write_delimited(dataset, path, SEPARATORS[kind], table)


def write_bundle(dataset: Dataset, path: str) -> None:
    """All tables as parquet, with names, filters and metadata as one row of JSON."""
    spark = next(iter(dataset.tables.values())).sparkSession
    for name, df in dataset.tables.items():
        df.write.mode("overwrite").parquet(f"{path}/tables/{name}")
    config = {"tables": list(dataset.tables), "columns": dataset.columns, "column_filters": dataset.column_filters, "row_filters": dataset.row_filters, "fractions": dataset.fractions, "meta": dataset.meta}
    spark.createDataFrame([(json.dumps(config, default=str),)], "config string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def read_bundle(spark: SparkSession, path: str) -> Dataset:
    config = json.loads(spark.read.text(f"{path}/config").first()[0])
    tables = {t: spark.read.parquet(f"{path}/tables/{t}") for t in config["tables"]}
    filters = {k: {n: tuple(p) for n, p in config[k].items()} for k in ("column_filters", "row_filters")}
    return Dataset(tables, config["columns"], filters["column_filters"], filters["row_filters"], config["fractions"], config["meta"])


def describe(df: DataFrame) -> DataFrame:
    """(column, type) of a table, as a DataFrame."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column string, type string")
