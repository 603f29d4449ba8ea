"""Datasets: named numeric tables with a label column, external column names, filters and preparation steps.

A Dataset is immutable: every step returns a new one over lazily derived DataFrames. Patterns have two parts joined
by a colon, either of which may be `*`.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.draws import Draws, draws
from lumenframe.functions.registry import register
from lumenframe.operators import stats

TABLE, LABEL = "__table", "label"


def _matches(pattern: str, name: str) -> bool:
    """`*:*`, `group:*`, `*:name`, `group:name`; a name without a colon has the empty group."""
    if pattern in ("*", "*:*"):
        return True
    group, _, rest = name.rpartition(":")
    want_group, _, want_rest = pattern.rpartition(":")
    return want_group in ("*", group) and want_rest in ("*", rest)


def numbered(names: Iterable[str]) -> list[str]:
    """Names with repeats numbered: c, c.2, c.3."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}.{seen[n]}")
    return out


@dataclass(frozen=True)
class Dataset:
    """tables: DataFrames with `label` and numeric columns. columns: external name to physical column."""

    tables: dict[str, DataFrame]
    columns: dict[str, str] = field(default_factory=dict)
    column_filters: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"*": ("*:*",)})
    row_filters: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"*": ("*:*",)})
    fractions: dict[str, float] = field(default_factory=dict)
    meta: dict[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.columns and self.tables:
            common = [c for c in next(iter(self.tables.values())).columns if c != LABEL and all(c in t.columns for t in self.tables.values())]
            object.__setattr__(self, "columns", {c: c for c in common})

    # -- names

    def get_columns(self, which: str | Sequence[str] = "*") -> list[str]:
        """External columns of a named filter, of a pattern, or of a list that is checked and passed through."""
        if not isinstance(which, str):
            if unknown := [c for c in which if c not in self.columns]:
                raise ValueError(f"unknown columns: {', '.join(unknown)}")
            return list(which)
        if which == "*":
            return list(self.columns)
        patterns = self.column_filters.get(which, (which,) if ":" in which or which in self.columns else None)
        if patterns is None:
            raise ValueError(f"unknown column filter {which!r}")
        return [c for c in self.columns if any(_matches(p, c) for p in patterns)]

    def get_colnames(self, columns: Sequence[str]) -> list[str]:
        return [self.columns[c] for c in self.get_columns(columns)]

    def column_groups(self) -> dict[str, list[str]]:
        """Names by group; columns without a group are left out."""
        out: dict[str, list[str]] = {}
        for c in self.columns:
            group, _, name = c.rpartition(":")
            if group:
                out.setdefault(group, []).append(name)
        return out

    def with_column_filter(self, name: str, patterns: Sequence[str]) -> Dataset:
        for p in patterns:
            if not any(_matches(p, c) for c in self.columns):
                raise ValueError(f"{p!r} matches no column")
        return replace(self, column_filters=self.column_filters | {name: tuple(patterns)})

    def with_row_filter(self, name: str, patterns: Sequence[str]) -> Dataset:
        return replace(self, row_filters=self.row_filters | {name: tuple(patterns)})

    def with_columns(self, mapping: dict[str, str]) -> Dataset:
        """Virtual columns: external name to physical column, each of which all tables must have."""
        for physical in mapping.values():
            if any(physical not in t.columns for t in self.tables.values()):
                raise ValueError(f"not every table has column {physical!r}")
        return replace(self, columns=dict(mapping))

    def with_tables(self, tables: dict[str, DataFrame]) -> Dataset:
        """Merged tables; of equal names the given ones win."""
        return replace(self, tables=self.tables | tables)

    # -- reading

    def table(self, name: str, rows: str | Sequence[str] = "*", columns: str | Sequence[str] = "*") -> DataFrame:
        """`__table`, `label` and external columns of one table, with its rows filtered."""
        picked = self.get_columns(columns)
        out = numbered(picked)
        df = self.tables[name]
        label = F.col(LABEL).cast("string") if LABEL in df.columns else F.lit(None).cast("string")
        df = df.select(F.lit(name).alias(TABLE), label.alias(LABEL), *(F.col(f"`{self.columns[c]}`").cast("double").alias(o) for c, o in zip(picked, out, strict=True)))
        patterns = self.row_filters.get(rows, (rows,)) if isinstance(rows, str) else tuple(rows)
        if any(p in ("*", "*:*", f"{name}:*") for p in patterns):
            return df
        labels = [p.partition(":")[2] for p in patterns if p.partition(":")[0] in ("*", name)]
        return df.where(F.col(LABEL).isin(labels)) if labels else df.limit(0)

    def rows(self, rows: str | Sequence[str] = "*", columns: str | Sequence[str] = "*") -> DataFrame:
        """All tables in one, by column names."""
        return reduce(DataFrame.unionByName, (self.table(t, rows, columns) for t in self.tables))

    def row_names(self, rows: str | Sequence[str] = "*") -> DataFrame:
        return self.rows(rows).select(F.concat_ws(":", TABLE, LABEL).alias("row"))

    def row_groups(self) -> list[str]:
        return list(self.tables)

    def sample(self, size: int, rows: str | Sequence[str] = "*", columns: str | Sequence[str] = "*", seed: int = 0, order: Sequence[str] = (LABEL,)) -> DataFrame:
        """`size` rows, drawn with replacement in each table by its fraction, then shuffled and cut.

        Rows are numbered in the given order, without being brought together; each draw is the number that a hash of
        table, seed and draw falls on, so the sample is exact and the same in every run.
        """
        from lumenframe.operators.arrays import number_rows

        parts = []
        for t in self.tables:
            want = round(self.fractions.get(t, 1 / len(self.tables)) * size)
            n = self.table(t, rows, columns).count() if want else 0
            if n:
                draw = draws(seed, [F.lit(t), F.col("__draw")])
                wanted = self.tables[t].sparkSession.range(want).select(F.col("id").alias("__draw")).select(F.floor(draw.uniform() * n).alias("__row"), draw.uniform(1).alias("__place"))
                parts.append(number_rows(self.table(t, rows, columns), [TABLE, *order]).join(wanted, "__row").drop("__row"))
        if not parts:
            return self.rows(rows, columns).limit(0)
        return reduce(DataFrame.unionByName, parts).orderBy("__place").limit(size).drop("__place")

    def read(self, output: str | Sequence[str] = "array", rows: str | Sequence[str] = "*", columns: str | Sequence[str] = "*", size: int = 0, noise: tuple[str | None, float] = (None, 0.0), seed: int = 0) -> DataFrame | list[str] | tuple:
        """Data in a format: `array` (values in one column, by row), `recarray` (label and columns), `cols` (names) or `rows` (names); several formats as a tuple.

        size draws so many rows; columns must be known and named once. Physical names that repeat are numbered.
        """
        if not isinstance(output, str):
            return tuple(self.read(o, rows, columns, size, noise, seed) for o in output)
        if output not in ("array", "recarray", "cols", "rows"):
            raise ValueError(f"unknown output format {output!r}")
        picked = self.get_columns(columns)
        if len(set(picked)) < len(picked):
            raise ValueError("columns are not unique")
        names = numbered(self.columns[c] for c in picked)
        if output == "cols":
            return names
        df = self.sample(size, rows, columns, seed) if size else self.rows(rows, columns)
        if output == "rows":
            return df.select(F.concat_ws(":", TABLE, LABEL).alias("row"))
        df = self._noisy(df, picked, noise, seed)
        cells = [F.col(f"`{c}`") for c in picked]
        if output == "array":
            return df.select(F.array(*cells).alias("values"))
        return df.select(LABEL, *(c.alias(n) for c, n in zip(cells, names, strict=True)))

    def _noisy(self, df: DataFrame, picked: list[str], noise: tuple[str | None, float], seed: int) -> DataFrame:
        """df with noise on columns whose names may hold any character."""
        if noise[0] is None:
            return df
        plain = [f"__c{k}" for k in range(len(picked))]
        named = df.select(TABLE, LABEL, *(F.col(f"`{c}`").alias(p) for c, p in zip(picked, plain, strict=True)))
        return add_noise(named, plain, noise[0], noise[1], seed, [TABLE, LABEL]).select(TABLE, LABEL, *(F.col(p).alias(c) for c, p in zip(picked, plain, strict=True)))

    def value(self, row: str, column: str) -> float | None:
        """One cell: row is `table:label`."""
        table, _, label = row.partition(":")
        found = self.table(table, [f"{table}:{label}"], [column]).select(column).first()
        return None if found is None else found[0]

    # -- preparation

    def map_tables(self, f) -> Dataset:
        return replace(self, tables={t: f(df) for t, df in self.tables.items()})

    def stratify(self, mode: str = "hierarchical") -> Dataset:
        """Fractions of the tables: kept, by their size, or equal."""
        if mode == "hierarchical":
            return self
        if mode == "equal":
            return replace(self, fractions={t: 1 / len(self.tables) for t in self.tables})
        if mode == "proportional":
            counts = {t: df.count() for t, df in self.tables.items()}
            total = sum(counts.values()) or 1
            return replace(self, fractions={t: n / total for t, n in counts.items()})
        raise ValueError(f"unknown stratification {mode!r}")

    def normalize(self, mode: str = "gauss", **kwargs: float) -> Dataset:
        physical = list(dict.fromkeys(self.columns.values()))
        everything = reduce(DataFrame.unionByName, (df.select(*physical) for df in self.tables.values()))
        if mode == "gauss":
            moments = {r["name"]: r for r in stats.moments(everything, physical).collect()}
            return self.map_tables(lambda df: normalize_gauss(df, physical, moments, **kwargs))
        if mode == "bernoulli":
            cuts = {r["name"]: r["threshold"] for r in stats.rank_quantile(everything, physical, **kwargs).collect()}
            return self.map_tables(lambda df: df.withColumns({c: step_above(F.col(c), cuts[c]) for c in physical if c in cuts}))
        raise ValueError(f"unknown normalisation {mode!r}")

    def transform(self, mode: str) -> Dataset:
        physical = list(dict.fromkeys(self.columns.values()))
        return self.map_tables(lambda df: df.withColumns({c: TRANSFORMS[mode](F.col(c)) for c in physical}))

    def apply_system(self, system, how: str = "expect", path: Sequence[str] | None = None, seed: int = 0) -> Dataset:
        """Tables in which the units of the path's last layer replace the columns: their expectations, values or samples.

        The columns of the path's first layer must be external columns. Labels, fractions and row filters stay.
        """
        from lumenframe.operators.system import forward

        chain = tuple(path or system.mapping)
        if len(chain) < 2:
            raise ValueError("a path needs two layers at least")
        source, target = system.layer(chain[0]).columns, system.layer(chain[-1]).columns
        physical = self.get_colnames(source)

        def mapped(df: DataFrame) -> DataFrame:
            label = F.col(LABEL) if LABEL in df.columns else F.lit(None).cast("string")
            given = df.select(label.alias(LABEL), *(F.col(f"`{p}`").cast("double").alias(c) for p, c in zip(physical, source, strict=True)))
            out = forward(given, system, how=how, seed=seed, prefix="~", path=chain)
            return out.select(LABEL, *(F.col(f"`~{c}`").alias(c) for c in target))

        return replace(self.map_tables(mapped), columns={c: c for c in target}, column_filters={"*": ("*:*",)})

    def configure(self, nodes: dict[str, Sequence[str]], lookup: DataFrame | None = None) -> Dataset:
        """External columns `layer:label` for the nodes of each layer that all tables have; an empty layer is an error.

        Names of nodes and of columns are compared after conversion by `lookup` (source, target), if it is given. Nodes
        that no conversion knows and nodes that some table lacks are listed in the metadata: `lost` and `missing`.
        """
        mapping: dict[str, str] = {}
        lost: list[str] = []
        missing: list[str] = []
        by_table = [self._converted([c for c in t.columns if c != LABEL], lookup)[0] for t in self.tables.values()]
        for layer, names in nodes.items():
            known, unknown = self._converted(list(names), lookup)
            lost += [f"{layer}:{x}" for x in unknown]
            found = [x for x in known if all(x in t and t[x] == by_table[0][x] for t in by_table)]
            missing += [f"{layer}:{known[x]}" for x in known if x not in found]
            if not found:
                raise ValueError(f"no column matches a node of layer {layer!r}")
            mapping |= {f"{layer}:{x}": by_table[0][x] for x in found}
        meta = self.meta | {"lost": lost, "missing": missing}
        return replace(self, columns=mapping, column_filters={"*": ("*:*",)} | {layer: (f"{layer}:*",) for layer in nodes}, row_filters={"*": ("*:*",)}, meta=meta)

    def _converted(self, names: list[str], lookup: DataFrame | None) -> tuple[dict[str, str], list[str]]:
        """Converted name to name, in the given order, and the names that are lost; names of columns and nodes, no data."""
        if lookup is None or not names:
            return {n: n for n in names}, []
        from lumenframe.operators import labels

        spark = lookup.sparkSession
        made = labels.convert(spark.createDataFrame(list(enumerate(names)), "position long, label string"), lookup, prefix="")
        rows = sorted(made.collect(), key=lambda r: r["position"])
        return {r["converted"]: r["label"] for r in rows if not r["lost"]}, [r["label"] for r in rows if r["lost"]]

    def initialize(self, preprocessing: dict[str, str]) -> Dataset:
        """stratify, normalize and transform, as named in the configuration."""
        out = self.stratify(preprocessing.get("stratify", "hierarchical"))
        if mode := preprocessing.get("normalize"):
            out = out.normalize({"gauss": "gauss", "sigmoid": "bernoulli", "bernoulli": "bernoulli"}[mode])
        if mode := preprocessing.get("transform"):
            out = out.transform(mode)
        return out

    def evaluate(self, name: str, columns: str | Sequence[str] = "*", **kwargs) -> DataFrame:
        """A registered statistic or predicate of the selected columns."""
        from lumenframe.functions import registry

        picked = self.get_columns(columns)
        category = "predicate" if name in registry.names("predicate") else "statistic"
        return registry.get(category, name)(self.rows(columns=picked), picked, **kwargs)


# -- column steps


def normalize_gauss(df: DataFrame, columns: list[str], moments: dict, mu: float = 0.0, sigma: float = 1.0) -> DataFrame:
    """(x - mean + mu) / std * sigma; constant columns keep 0 * sigma."""

    def scaled(c: str) -> Column:
        std = moments[c]["std"]
        return (F.col(c) - moments[c]["mean"] + mu) / (std if std else 1.0) * sigma

    return df.withColumns({c: scaled(c) for c in columns})


def step_above(x: Column, threshold: float | Column = 0.0) -> Column:
    return F.when(x > threshold, 1.0).when(x.isNotNull(), 0.0)


@register("transform", "binary")
def to_binary(x: Column) -> Column:
    return step_above(x)


@register("transform", "weight")
def to_weight(x: Column) -> Column:
    return 2 / (1 + F.exp(-x * x))


@register("transform", "distance")
def to_distance(x: Column) -> Column:
    return 1 - 2 / (1 + F.exp(-x * x))


TRANSFORMS = {"binary": to_binary, "gaussToBinary": to_binary, "weight": to_weight, "gaussToWeight": to_weight, "distance": to_distance, "gaussToDistance": to_distance}


@register("noise", "gauss")
def noise_gauss(x: Column, factor: float, draw: Draws) -> Column:
    return x + draw.normal() * factor


@register("noise", "mask")
def noise_mask(x: Column, factor: float, draw: Draws) -> Column:
    return x * (draw.uniform() < 1 - factor).cast("double")


@register("noise", "bernoulli")
def noise_bernoulli(x: Column, factor: float, draw: Draws) -> Column:
    """1 where x differs from a draw that is 1 with probability 1 - factor, else 0."""
    return (x != (draw.uniform() < 1 - factor).cast("double")).cast("double")


@register("noise", "salt")
def noise_salt(x: Column, factor: float, draw: Draws, lo: float, hi: float) -> Column:
    """Adds the column's largest or smallest value, evenly, to a share 1 - factor of the cells."""
    return x + (draw.uniform() < 1 - factor).cast("double") * F.when(draw.uniform(1) < 0.5, hi).otherwise(lo)


@register("noise", "salt_replace")
def noise_salt_replace(x: Column, factor: float, draw: Draws, lo: float, hi: float) -> Column:
    """Replaces a share `factor` of the cells by the column's largest or smallest value."""
    return F.when(draw.uniform() < factor, F.when(draw.uniform(1) < 0.5, hi).otherwise(lo)).otherwise(x)


def add_noise(df: DataFrame, columns: list[str], kind: str | None, factor: float, seed: int = 0, key: Sequence[str] | None = None) -> DataFrame:
    """Noise on all columns, each with draws of its own, which the key columns fix if they are given; kind None leaves them."""
    if kind is None:
        return df
    from lumenframe.functions import registry

    build = registry.get("noise", kind)
    ends = {r["name"]: (r["lo"], r["hi"]) for r in stats.moments(df, columns).collect()} if kind.startswith("salt") else {}
    return df.withColumns({c: build(F.col(c), factor, draws(seed + 2 * k, key), *ends.get(c, ())) for k, c in enumerate(columns)})


def apply_rules(df: DataFrame, rules: Sequence[tuple[str, str]], gauss: float = 0.1, bernoulli: float = 0.5, seed: int = 0, key: Sequence[str] | None = None) -> DataFrame:
    """Columns from SQL expressions over earlier columns; `gauss` and `bernoulli` are fresh draws for every rule."""
    for k, (name, rule) in enumerate(rules):
        drawn = df.withColumns({"gauss": draws(seed + 2 * k, key).normal() * gauss, "bernoulli": (draws(seed + 2 * k + 1, key).uniform() < bernoulli).cast("double")})
        df = drawn.withColumn(name, F.expr(rule).cast("double")).drop("gauss", "bernoulli")
    return df


def generate(spark, columns: Sequence[str], rows: int | DataFrame = 10_000, initial: str = "gauss + bernoulli", rules: Sequence[tuple[str, str]] = (), sdev: float = 0.1, abin: float = 0.5, normalize: bool = True, seed: int = 0) -> Dataset:
    """A synthetic dataset: every column drawn by `initial`, then overwritten by the rules; rows, or one for each (label) of a table.

    Draws are fixed by the labels.
    """
    base = rows.select(F.col(LABEL).cast("string").alias(LABEL)) if isinstance(rows, DataFrame) else spark.range(rows).select(F.concat(F.lit("r"), (F.col("id") + 1).cast("string")).alias(LABEL))
    drawn = apply_rules(base, [(c, initial) for c in columns], sdev, abin, seed, [LABEL])
    made = Dataset({"rules": apply_rules(drawn, rules, sdev, abin, seed + 10_000, [LABEL])})
    return made.normalize("gauss") if normalize else made
