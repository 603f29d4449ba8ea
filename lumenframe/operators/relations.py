"""Associations between the inputs and the outputs of a system, as long tables (src, tgt, value)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import curves, registry
from lumenframe.functions.registry import register
from lumenframe.operators import stats
from lumenframe.operators.system import System, expectation
from lumenframe.storage import discard, materialize


def _label(unit: str) -> str:
    return unit.rpartition(":")[2]


@register("relation", "correlation", directed=False, signed=True, normal=True)
def correlation(df: DataFrame, system: System) -> DataFrame:
    """Pearson correlation of every input with every output column, in one aggregate."""
    pairs = [(s, t) for s in system.layers[0].columns for t in system.layers[-1].columns]
    cells = [F.struct(F.lit(s).alias("src"), F.lit(t).alias("tgt"), F.corr(F.col(f"`{s}`"), F.col(f"`{t}`")).alias("value")) for s, t in pairs]
    return df.agg(F.array(*cells).alias("m")).select(F.inline("m"))


@register("relation", "weightsumproduct", directed=True, signed=True, normal=False)
def weight_sum_product(links: DataFrame) -> DataFrame:
    """Product of the weight matrices along the layers of a link table (src_layer_id, src, dst, weight)."""
    last = links.agg(F.max("src_layer_id")).first()[0] or 0
    out = links.where("src_layer_id = 0").select("src", F.col("dst").alias("tgt"), F.col("weight").alias("value"))
    for k in range(1, last + 1):
        step = links.where(F.col("src_layer_id") == k).select(F.col("src").alias("tgt"), F.col("dst").alias("next"), "weight")
        out = out.join(step, "tgt").groupBy("src", F.col("next").alias("tgt")).agg(F.sum(F.col("value") * F.col("weight")).alias("value"))
    return out


@register("relation", "knockout", directed=True, signed=True, normal=False)
def knockout(df: DataFrame, system: System, measure: str = "error") -> DataFrame:
    """Change of a unit measure of each output when an input is held at its mean."""
    inputs = system.layers[0].columns
    means = df.agg(*(F.avg(F.col(f"`{c}`")).alias(f"m{k}") for k, c in enumerate(inputs))).first()
    of = registry.get("unit_measure", measure)
    base = of(df, system).select("unit", F.col("value").alias("base"))
    blocked = [of(df, system, block={c: float(means[k])}).select(F.lit(c).alias("src"), "unit", "value") for k, c in enumerate(inputs)]
    return reduce(DataFrame.unionByName, blocked).join(F.broadcast(base), "unit").select("src", F.col("unit").alias("tgt"), (F.col("value") - F.col("base")).alias("value"))


def _deviations(batches: Iterator[pa.RecordBatch], system: System, curves_of: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """For each record, and each input and output, the deviation of the output over the input's points; null where a value is missing."""
    inputs, outputs = system.layers[0].columns, system.layers[-1].columns
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            x = np.column_stack([c.slice(at, 4096).to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            made = []
            for i, points in enumerate(curves_of):
                seen = []
                for v in points:
                    held = x.copy()
                    held[:, i] = v
                    seen.append(expectation(system, held))
                spread = np.std(seen, axis=0) if seen else np.full((len(x), len(outputs)), np.nan)
                made += [pa.array(spread[:, j], pa.float64(), mask=np.isnan(spread[:, j])) for j in range(len(outputs))]
            yield pa.RecordBatch.from_arrays(made, names=[f"d{i}_{j}" for i in range(len(inputs)) for j in range(len(outputs))])


def raw_induction(df: DataFrame, system: System, points: int = 10, amplify: float = 1.0, gauge: float = 0.25) -> DataFrame:
    """Induced deviation before contrast.

    For an input, its representatives replace it in every record; a record's induced deviation of an output is the
    population deviation over the representatives; the mean of the top `gauge` of records is set against the output's own.
    Deviations are computed once, batch by batch, and written, since selection reads them several times.
    """
    inputs, outputs = system.layers[0].columns, system.layers[-1].columns
    plain = df.select(*(F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(inputs)))
    found = stats.representatives(plain, plain.columns, points).collect()  # points per input
    curve = {(r["name"], r["point"]): r["x"] * amplify for r in found}
    curves_of = [np.array([curve[f"c{k}", p] for p in range(points) if (f"c{k}", p) in curve]) for k in range(len(inputs))]
    pairs = [(f"d{i}_{j}", s, t) for i, s in enumerate(inputs) for j, t in enumerate(outputs)]
    made = materialize(plain.mapInArrow(lambda b: _deviations(b, system, curves_of), ", ".join(f"{n} double" for n, _, _ in pairs)), "induced")
    top = stats.top_mean(made, [n for n, _, _ in pairs], gauge)
    discard(made)
    spread = df.agg(F.array(*(F.struct(F.lit(t).alias("tgt"), F.stddev_pop(F.col(f"`{t}`")).alias("std")) for t in outputs)).alias("m")).select(F.inline("m"))
    of = df.sparkSession.createDataFrame(pairs, "name string, src string, tgt string")
    return top.join(F.broadcast(of), "name").join(F.broadcast(spread), "tgt").select("src", "tgt", (F.col("value") / F.col("std")).alias("value"))


@register("relation", "induction", directed=True, signed=False, normal=False)
def induction(df: DataFrame, system: System, points: int = 10, amplify: float = 1.0, gauge: float = 0.25, contrast: float = 20.0) -> DataFrame:
    """raw_induction, contrasted by a soft step whose scale is its maximum over different units."""
    raw = raw_induction(df, system, points, amplify, gauge)
    other = F.when(F.element_at(F.split("src", ":"), -1) != F.element_at(F.split("tgt", ":"), -1), F.col("value")).otherwise(0.0)
    scale = raw.agg(F.max(other).alias("scale"))
    return raw.join(F.broadcast(scale), how="cross").select("src", "tgt", curves.dialogistic(F.col("value"), F.col("scale"), contrast).alias("value"))


@register("relation", "coinduction", directed=True, signed=False, normal=False)
def coinduction(df: DataFrame, system: System, at: float = 10.0, gauge: float = 0.1, **kwargs: float) -> DataFrame:
    """Change of the induction of `src` (length over all outputs) when `tgt`, an input too, is held at a fixed value."""
    base = induction(df, system, gauge=gauge, **kwargs).select("src", "tgt", F.col("value").alias("base"))
    parts = []
    for c in system.layers[0].columns:
        held = induction(df.withColumn(c, F.lit(float(at))), system, gauge=gauge, **kwargs)
        change = F.col("value") - F.col("base")
        parts.append(held.join(base, ["src", "tgt"]).groupBy("src").agg(F.sqrt(F.sum(change * change)).alias("value")).select("src", F.lit(c).alias("tgt"), "value"))
    return reduce(DataFrame.unionByName, parts)


def transform(cells: DataFrame, expression: str, correlations: DataFrame | None = None) -> DataFrame:
    """A relation put through an SQL expression of M (its value) and, if given, C (the correlation of the pair)."""
    df = cells.withColumnRenamed("value", "M")
    if correlations is not None:
        df = df.join(correlations.withColumnRenamed("value", "C"), ["src", "tgt"])
    return df.select("src", "tgt", F.expr(expression).alias("value"))


def evaluate(name: str, *args, expression: str | None = None, **kwargs) -> DataFrame:
    """A registered relation, by name, optionally transformed."""
    cells = registry.get("relation", name)(*args, **kwargs)
    return cells if expression is None else transform(cells, expression)


def relation_graph(weights: DataFrame, filters: DataFrame | None = None, signs: DataFrame | None = None, cutoff: float = 0.5, normal: bool = False) -> DataFrame:
    """Edges of the pairs of different units whose filter relation is beyond `cutoff` deviations.

    Weights are |value| (over the deviation, unless they are normal) relative to their mean; sign is that of the sign
    relation, where only positive values are 1.
    """
    f = (filters if filters is not None else weights).where("src <> tgt").select("src", "tgt", F.col("value").alias("f"))
    s = (signs if signs is not None else weights).select("src", "tgt", F.when(F.col("value") > 0, 1).otherwise(-1).alias("sign"))
    bound = f.agg((F.stddev_pop("f") * cutoff).alias("b"))
    kept = f.join(F.broadcast(bound), how="cross").where("NOT (f > -b AND f < b)").select("src", "tgt")
    spread = weights.where("src <> tgt").agg(F.stddev_pop("value").alias("std"))
    strength = F.abs(F.col("value")) if normal else F.abs(F.col("value") / F.col("std"))
    edges = weights.join(kept, ["src", "tgt"]).join(F.broadcast(spread), how="cross").select("src", "tgt", strength.alias("w"))
    mean = edges.agg(F.avg("w").alias("mean"))
    return edges.join(F.broadcast(mean), how="cross").join(s, ["src", "tgt"]).select("src", "tgt", (F.col("w") / F.col("mean")).alias("weight"), "sign")


def as_heatmap(cells: DataFrame, targets: list[str]) -> DataFrame:
    """One row per source with a column per target: the matrix of a relation; pairs without a value are null."""
    return cells.groupBy("src").pivot("tgt", targets).agg(F.first("value"))


def as_histogram(cells: DataFrame, bins: int = 100) -> DataFrame:
    """(bin, lo, hi, n) of the values of pairs of different units."""
    return stats.histogram(cells.where("src <> tgt"), F.col("value"), bins)


def node_roles(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(unit, role): source, target, transit or isolated, by the edges that leave and reach a unit."""
    out = edges.select(F.col("src").alias("unit")).distinct().withColumn("o", F.lit(True))
    into = edges.select(F.col("tgt").alias("unit")).distinct().withColumn("i", F.lit(True))
    both = units.join(out, "unit", "left").join(into, "unit", "left")
    role = F.when(F.col("o") & F.col("i"), "transit").when(F.col("o"), "source").when(F.col("i"), "target").otherwise("isolated")
    return both.select("unit", role.alias("role"))


def is_symmetric(cells: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """(ok): whether value(a, b) and value(b, a) agree for all pairs."""
    other = cells.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), F.col("value").alias("v"))
    near = F.abs(F.col("value") - F.col("v")) <= tolerance + 1e-5 * F.abs(F.col("v"))
    return cells.join(other, ["src", "tgt"], "left").agg(F.bool_and(F.coalesce(near, F.lit(False))).alias("ok"))


