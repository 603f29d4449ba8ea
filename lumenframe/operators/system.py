"""Layered probabilistic systems: parameters on the driver, inference and errors as Column expressions.

A layer is `sigmoid` (binary units, logistic expectation) or `gauss` (real units with a bias and a log variance).
Parameters are small and fixed during a query, so they become literals of the plan and nothing is shipped or joined.
Unit columns of a layer are named `layer:unit`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import curves
from lumenframe.functions.draws import Draws, draws
from lumenframe.functions.registry import register
from lumenframe.operators import stats
from lumenframe.operators.network import Network


@dataclass(frozen=True)
class Units:
    name: str
    labels: tuple[str, ...]
    kind: str = "gauss"
    visible: bool = True
    bias: np.ndarray | None = None
    lvar: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("gauss", "sigmoid"):
            raise ValueError(f"unsupported kind of units {self.kind!r}")
        n = len(self.labels)
        for key, fill in (("bias", 0.5 if self.kind == "sigmoid" else 0.0), ("lvar", 1.0)):
            given = getattr(self, key)
            value = np.full(n, fill) if given is None else np.asarray(given, dtype=float)
            if value.shape != (n,):
                raise ValueError(f"{key} of layer {self.name!r} needs {n} numbers")
            object.__setattr__(self, key, value)

    @property
    def columns(self) -> list[str]:
        return [f"{self.name}:{x}" for x in self.labels]


@dataclass(frozen=True)
class System:
    layers: tuple[Units, ...]
    weights: tuple[np.ndarray, ...]
    adjacency: tuple[np.ndarray, ...]
    name: str = "system"

    def __post_init__(self) -> None:
        for k, (a, b) in enumerate(zip(self.layers, self.layers[1:], strict=False)):
            shape = (len(a.labels), len(b.labels))
            if self.weights[k].shape != shape or self.adjacency[k].shape != shape:
                raise ValueError(f"links {a.name}-{b.name} need a matrix of shape {shape}")

    @property
    def mapping(self) -> tuple[str, ...]:
        return tuple(u.name for u in self.layers)

    def path(self, source: str, target: str) -> tuple[str, ...]:
        """Layer names from source to target, backwards if the source comes later."""
        i, j = self.mapping.index(source), self.mapping.index(target)
        return self.mapping[i : j + 1] if i <= j else self.mapping[j : i + 1][::-1]

    def layer(self, name: str) -> Units:
        return self.layers[self.mapping.index(name)]

    def link(self, source: str, target: str) -> np.ndarray:
        """Weights from one layer to a neighbour, transposed if the target comes first."""
        i, j = self.mapping.index(source), self.mapping.index(target)
        if abs(i - j) != 1:
            raise ValueError(f"layers {source!r} and {target!r} are not connected")
        k = min(i, j)
        w = self.adjacency[k] * self.weights[k]
        return w if i < j else w.T

    # -- parameters as tables

    def units_table(self, spark: SparkSession, **values: object) -> DataFrame:
        rows = [(u.name, k, label, j, u.kind, u.visible, float(u.bias[j]), float(u.lvar[j])) for k, u in enumerate(self.layers) for j, label in enumerate(u.labels)]
        df = spark.createDataFrame(rows, "layer string, layer_id int, unit string, idx int, class string, visible boolean, bias double, lvar double")
        for key, value in values.items():
            df = df.where(F.col(key).eqNullSafe(F.lit(value)))
        return df

    def links_table(self, spark: SparkSession) -> DataFrame:
        """Links with A <> 0: their ends, adjacency and weight."""
        rows = [
            (k, k + 1, a.columns[i], b.columns[j], float(self.adjacency[k][i, j]), float(self.weights[k][i, j]))
            for k, (a, b) in enumerate(zip(self.layers, self.layers[1:], strict=False))
            for i in range(len(a.labels)) for j in range(len(b.labels)) if self.adjacency[k][i, j]
        ]
        return spark.createDataFrame(rows, "src_layer_id int, dst_layer_id int, src string, dst string, adjacency double, weight double")

    def units(self, spark: SparkSession, groupby: str | None = None, **values: object) -> DataFrame:
        """The units with these attribute values; with groupby (group, units): their names by the values of an attribute, in the order of the units.

        An attribute that units don't have is an error.
        """
        table = self.units_table(spark)
        if unknown := [k for k in [*values, *([groupby] if groupby else [])] if k not in table.columns]:
            raise ValueError(f"unknown attribute {unknown[0]!r}")
        return _grouped(_selected(table, values), groupby, F.concat_ws(":", "layer", "unit"), ["layer_id", "idx"], "units")

    def unit(self, spark: SparkSession, label: str) -> DataFrame:
        """The one unit of this name (`layer:unit`, or the unit alone if only one layer has it); none or several are an error."""
        layer, _, name = label.rpartition(":")
        found = self.units_table(spark).where((F.col("unit") == name) & (F.lit(not layer) | (F.col("layer") == layer)))
        if (n := found.count()) != 1:
            raise ValueError(f"{n} units are named {label!r}")
        return found

    def links(self, spark: SparkSession, groupby: str | None = None, **values: object) -> DataFrame:
        """The links with adjacency, with their computed attributes (link_attributes); filtered and grouped like units."""
        return select_links(link_attributes(self.links_table(spark)), groupby, **values)

    def layer_names(self, spark: SparkSession, **values: object) -> DataFrame:
        """(layer, layer_id) of the layers with these attribute values; attributes that layers don't have are passed over."""
        table = self.units_table(spark).groupBy("layer", "layer_id").agg(F.first("class").alias("class"), F.first("visible").alias("visible"), F.count("*").alias("size"))
        return _selected(table, {k: v for k, v in values.items() if k in table.columns}).select("layer", "layer_id")

    def without_units(self, layer: str, labels: Sequence[str]) -> System:
        """The system without some units of a layer, and the rows and columns of matrices that belong to them."""
        k = self.mapping.index(layer)
        keep = [j for j, x in enumerate(self.layers[k].labels) if x not in set(labels)]
        u = self.layers[k]
        layers = list(self.layers)
        layers[k] = replace(u, labels=tuple(u.labels[j] for j in keep), bias=u.bias[keep], lvar=u.lvar[keep])
        weights, adjacency = list(self.weights), list(self.adjacency)
        for m in (weights, adjacency):
            if k:
                m[k - 1] = m[k - 1][:, keep]
            if k < len(m):
                m[k] = m[k][keep, :]
        return replace(self, layers=tuple(layers), weights=tuple(weights), adjacency=tuple(adjacency))


def from_network(network: Network, name: str = "system") -> System:
    """Layers, kinds and adjacency of a network; weights are zero. The network is model metadata, a few rows."""
    rows = network.nodes.orderBy("layer_id", "layer_sub_id").collect()
    layers, at = [], {}
    for r in rows:
        if not layers or layers[-1][0] != r["layer"]:
            layers.append((r["layer"], [], r["type"] or ("gauss" if r["visible"] else "sigmoid"), r["visible"]))
        at[r["id"]] = (len(layers) - 1, len(layers[-1][1]))
        layers[-1][1].append(r["label"])
    units = tuple(Units(n, tuple(labels), kind, visible) for n, labels, kind, visible in layers)
    adjacency = tuple(np.zeros((len(a.labels), len(b.labels))) for a, b in zip(units, units[1:], strict=False))
    for e in network.edges.select("src", "dst").collect():
        (k, i), (_, j) = at[e["src"]], at[e["dst"]]
        adjacency[k][i, j] = 1.0
    return System(units, tuple(np.zeros_like(a) for a in adjacency), adjacency, name)


def initialize(system: System, df: DataFrame | None = None, sigma: float = 0.1, seed: int = 0) -> System:
    """Biases, variances and random weights, from the moments of the visible columns where df is given."""
    moments = {}
    if df is not None:
        present = [c for u in system.layers if u.visible for c in u.columns if c in df.columns]
        moments = {r["name"]: r for r in stats.moments(df.select(*(F.col(f"`{c}`") for c in present)).toDF(*(f"c{k}" for k in range(len(present)))), [f"c{k}" for k in range(len(present))]).collect()}
        moments = {c: moments[f"c{k}"] for k, c in enumerate(present)}
    rng = np.random.default_rng(seed)
    layers = []
    for u in system.layers:
        if u.kind == "sigmoid":
            layers.append(replace(u, bias=np.full(len(u.labels), 0.5)))
        elif all(c in moments for c in u.columns):
            std = np.array([moments[c]["std"] for c in u.columns])
            layers.append(replace(u, bias=np.array([moments[c]["mean"] for c in u.columns]), lvar=np.log(np.maximum(0.1 * std**2, 1e-12))))
        else:
            layers.append(replace(u, bias=np.zeros(len(u.labels)), lvar=np.ones(len(u.labels))))
    weights = []
    for a, adjacency in zip(system.layers, system.adjacency, strict=False):
        spread = np.array([moments[c]["std"] + 0.001 if c in moments else 1.0 for c in a.columns])
        weights.append(adjacency * rng.normal(0, 1, adjacency.shape) * (sigma / len(a.labels) * spread)[:, None])
    return replace(system, layers=tuple(layers), weights=tuple(weights))


# ---------------------------------------------------------------- forward pass


def _expectation(source: Units, target: Units, w: np.ndarray, x: Sequence[Column]) -> list[Column]:
    scale = np.exp(source.lvar / 2) if source.kind == "gauss" else np.ones(len(source.labels))
    out = []
    for j in range(len(target.labels)):
        total: Column = F.lit(float(target.bias[j]))
        for i, xi in enumerate(x):
            if w[i, j]:
                total = total + xi * float(w[i, j] / scale[i])
        out.append(curves.logistic(total) if target.kind == "sigmoid" else total)
    return out


def expectation(system: System, x: np.ndarray) -> np.ndarray:
    """Expectations of the last layer for rows of the first, with numpy, for use inside tasks."""
    for source, target, w, adjacency in zip(system.layers, system.layers[1:], system.weights, system.adjacency, strict=False):
        z = target.bias + (x / np.exp(source.lvar / 2) if source.kind == "gauss" else x) @ (w * adjacency)
        x = 1 / (1 + np.exp(-np.clip(z, -500, 500))) if target.kind == "sigmoid" else z
    return x


def values_of(kind: str, x: Column) -> Column:
    """Most likely value of a unit."""
    return F.when(x > 0.5, 1.0).otherwise(0.0) if kind == "sigmoid" else x


def sample_of(kind: str, x: Column, lvar: float, draw: Draws) -> Column:
    """A draw of a unit's value."""
    return F.when(x > draw.uniform(), 1.0).otherwise(0.0) if kind == "sigmoid" else x + draw.normal() * float(np.exp(lvar / 2))


def forward(df: DataFrame, system: System, target: str | None = None, how: str = "expect", expect_last: bool = False, block: dict[str, float] | None = None, seed: int = 0, prefix: str = "", path: Sequence[str] | None = None, key: Sequence[str] | None = None) -> DataFrame:
    """df with columns `prefix + layer:unit` for all layers after the first, up to the target. Samples are fixed by the key columns, if given.

    path: names of neighbouring layers to pass instead, forwards or backwards (by the transposed weights); a layer that
    is passed twice keeps its last values. how: expect, values or samples of every layer; with expect_last, the last one is its expectation. block sets input
    columns to constants. Each layer is one projection over the columns of the layer before.
    """
    if how not in ("expect", "values", "samples"):
        raise ValueError(f"unknown kind of forward pass {how!r}")
    if path is None:
        path = system.mapping if target is None else system.mapping[: system.mapping.index(target) + 1]
    chain = [system.layer(name) for name in path]
    stop = len(chain) - 1
    x: list[Column] = [F.lit(float(block[c])) if block and c in block else F.col(f"`{c}`") for c in chain[0].columns]
    if how != "expect" and stop == 0:
        return df
    for k in range(stop):
        a, b = chain[k], chain[k + 1]
        made = _expectation(a, b, system.link(a.name, b.name), x)
        last = k + 1 == stop
        if how == "values" and not (last and expect_last):
            made = [values_of(b.kind, m) for m in made]
        elif how == "samples" and not (last and expect_last):
            made = [sample_of(b.kind, m, b.lvar[j], draws(seed + 1000 * k + j, key)) for j, m in enumerate(made)]
        names = [prefix + c for c in b.columns]
        df = df.withColumns(dict(zip(names, made, strict=True)))
        x = [F.col(f"`{n}`") for n in names]
    return df


def residuals(df: DataFrame, system: System, **kwargs) -> DataFrame:
    """Target columns replaced by target minus expectation; other columns of df stay."""
    target = system.layers[-1].columns
    out = forward(df, system, prefix="~", **kwargs)
    keep = [c for c in df.columns if c not in target]
    return out.select(*(F.col(f"`{c}`") for c in keep), *((F.col(f"`{c}`") - F.col(f"`~{c}`")).alias(c) for c in target))


def _per_unit(df: DataFrame, columns: list[str], f) -> DataFrame:
    """(unit, value): one aggregate per column, all in one scan."""
    return df.agg(F.array(*(F.struct(F.lit(c).alias("unit"), f(c).alias("value")) for c in columns)).alias("m")).select(F.inline("m"))


@register("unit_measure", "mean")
def unit_mean(df: DataFrame, system: System, **kw) -> DataFrame:
    """Mean of the expectation of each output unit."""
    return _per_unit(forward(df, system, prefix="~", **kw), system.layers[-1].columns, lambda c: F.avg(F.col(f"`~{c}`")))


@register("unit_measure", "variance")
def unit_variance(df: DataFrame, system: System, **kw) -> DataFrame:
    return _per_unit(forward(df, system, prefix="~", **kw), system.layers[-1].columns, lambda c: F.var_pop(F.col(f"`~{c}`")))


def _residual(c: str) -> Column:
    return F.col(f"`{c}`") - F.col(f"`~{c}`")


@register("unit_measure", "error", optimum="min")
def unit_error(df: DataFrame, system: System, **kw) -> DataFrame:
    """Mean squared residual."""
    return _per_unit(forward(df, system, prefix="~", **kw), system.layers[-1].columns, lambda c: F.avg(_residual(c) * _residual(c)))


@register("unit_measure", "accuracy", optimum="max")
def unit_accuracy(df: DataFrame, system: System, **kw) -> DataFrame:
    """1 - mean squared residual over mean squared target."""
    return _per_unit(forward(df, system, prefix="~", **kw), system.layers[-1].columns, lambda c: 1 - F.avg(_residual(c) * _residual(c)) / F.avg(F.col(f"`{c}`") * F.col(f"`{c}`")))


@register("unit_measure", "precision", optimum="max")
def unit_precision(df: DataFrame, system: System, **kw) -> DataFrame:
    """1 - deviation of the residual over deviation of the target."""
    return _per_unit(forward(df, system, prefix="~", **kw), system.layers[-1].columns, lambda c: 1 - F.stddev_pop(_residual(c)) / F.stddev_pop(F.col(f"`{c}`")))


def measure(df: DataFrame, system: System, name: str = "error", **kw) -> DataFrame:
    """(value): mean of a unit measure over the output units."""
    from lumenframe.functions import registry

    return registry.get("unit_measure", name)(df, system, **kw).agg(F.avg("value").alias("value"))


# ---------------------------------------------------------------- energies


def _unit_energy(u: Units, j: int, x: Column) -> Column:
    if u.kind == "sigmoid":
        return -x * float(u.bias[j])
    return (x - float(u.bias[j])) * (x - float(u.bias[j])) / (2 * float(np.exp(u.lvar[j])))


def unit_energies(df: DataFrame, system: System, layer: str | None = None) -> DataFrame:
    """(unit, value): mean energy of each unit of a layer (the last, if none is named) over the records."""
    name = layer or system.mapping[-1]
    u = system.layer(name)
    at = "" if name == system.mapping[0] else "~"
    out = forward(df, system, name, prefix="~")
    return _per_unit(out, u.columns, lambda c: F.avg(_unit_energy(u, u.columns.index(c), F.col(f"`{at}{c}`"))))


def _link_matrix(system: System, k: int) -> np.ndarray:
    a = system.layers[k]
    m = -system.adjacency[k] * system.weights[k]
    return m / np.exp(a.lvar / 2)[:, None] if a.kind == "gauss" else m


def _link_terms(system: System, k: int) -> list[tuple[str, str, Column]]:
    """(src, dst, energy) of links k: expectation of the source unit times value of the target unit times the link."""
    a, b, m = system.layers[k], system.layers[k + 1], _link_matrix(system, k)
    at = "" if k == 0 else "~"
    target = [values_of(b.kind, F.col(f"`~{c}`")) for c in b.columns]
    return [(s, t, F.col(f"`{at}{s}`") * target[j] * float(m[i, j])) for i, s in enumerate(a.columns) for j, t in enumerate(b.columns) if m[i, j]]


def link_energies(df: DataFrame, system: System, k: int = 0) -> DataFrame:
    """(src, dst, value): mean energy over the records of each link from layer k to layer k + 1."""
    out = forward(df, system, system.mapping[k + 1], prefix="~")
    cells = [F.struct(F.lit(s).alias("src"), F.lit(t).alias("dst"), F.avg(e).alias("value")) for s, t, e in _link_terms(system, k)]
    return out.agg(F.array(*cells).alias("m")).select(F.inline("m"))


def energy(df: DataFrame, system: System) -> DataFrame:
    """(value): log(1 + sum over records of exp(-E)), E the sum of all unit and link energies of a record."""
    out = forward(df, system, prefix="~")
    total: Column = F.lit(0.0)
    for k, u in enumerate(system.layers):
        at = "" if k == 0 else "~"
        for j, c in enumerate(u.columns):
            total = total + _unit_energy(u, j, F.col(f"`{at}{c}`"))
    for k in range(len(system.weights)):
        for _, _, e in _link_terms(system, k):
            total = total + e
    return out.agg(F.log1p(F.sum(F.exp(-total))).alias("value"))


# ---------------------------------------------------------------- links


def _selected(df: DataFrame, values: dict[str, object]) -> DataFrame:
    for name, value in values.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    return df


def _grouped(df: DataFrame, groupby: str | None, name: Column, order: list[str], many: str) -> DataFrame:
    if groupby is None:
        return df
    members = F.transform(F.sort_array(F.collect_list(F.struct(*order, name.alias("name")))), lambda x: x["name"])  # a system's units, not data
    return df.groupBy(F.col(groupby).alias("group")).agg(members.alias(many))


def select_links(links: DataFrame, groupby: str | None = None, **values: object) -> DataFrame:
    """Links (of link_attributes) with adjacency and these attribute values; with groupby (group, links): `src>dst` by the values of an attribute."""
    if unknown := [k for k in [*values, *([groupby] if groupby else [])] if k not in links.columns]:
        raise ValueError(f"unknown attribute {unknown[0]!r}")
    return _grouped(_selected(links.where("adjacency <> 0"), values), groupby, F.concat_ws(">", "src", "dst"), ["src_layer_id", "src", "dst"], "links")


def link_attributes(links: DataFrame) -> DataFrame:
    """links (src_layer_id, src, dst, adjacency, weight) with sign, normal and intensity, from totals of their layer.

    normal = weight * sum(A) / sum(|A W|); intensity is a soft step of it whose scale is 0.7 max(|A W|) sum(A) / sum(|A W|).
    """
    strength = F.abs(F.col("adjacency") * F.col("weight"))
    totals = links.groupBy("src_layer_id").agg(F.sum("adjacency").alias("a"), F.sum(strength).alias("s"), F.max(strength).alias("m"))
    joined = links.join(F.broadcast(totals), "src_layer_id")  # a row per layer
    normal = F.col("weight") * F.col("a") / F.col("s")
    scale = 0.7 * F.col("m") * F.col("a") / F.col("s")
    return joined.select(
        *links.columns, F.signum("weight").alias("sign"),
        F.when(F.col("weight") == 0, 0.0).otherwise(normal).alias("normal"),
        F.when(F.col("weight") == 0, 0.0).otherwise(curves.dialogistic(normal, scale, 10.0)).alias("intensity"),
    )
