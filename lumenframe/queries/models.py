"""Layered systems over the embeddings: inference, errors, energies, relations, training and scoring of streams.

The fixed system takes three positions of an embedding to the fourth over two hidden units.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumenframe.functions import registry
from lumenframe.operators import network as net
from lumenframe.operators import epochs, relations, train
from lumenframe.operators import system as sysm
from lumenframe.operators.system import System, Units
from lumenframe.operators.train import Schedule
from lumenframe.queries.common import Registry, draw_sql, rounded, table
from lumenframe.queries.graphs import _graph as graph_of_tables
from lumenframe.streaming import score

R = Registry()
W0, W1 = np.array([[0.5, -0.3], [0.2, 0.8], [-0.6, 0.4]]), np.array([[0.7], [-0.9]])
SYSTEM = System(
    (
        Units("i", ("a", "b", "c"), "gauss", True, np.array([0.1, 0.0, -0.1]), np.zeros(3)),
        Units("h", ("x", "y"), "sigmoid", False, np.array([0.1, -0.2])),
        Units("o", ("d",), "gauss", True, np.array([0.05]), np.zeros(1)),
    ),
    (W0, W1),
    (np.ones((3, 2)), np.ones((2, 1))),
)
#: Without a hidden layer, for one exact training step.
SHALLOW = System((SYSTEM.layers[0], SYSTEM.layers[2]), (np.array([[0.3], [-0.2], [0.1]]),), (np.ones((3, 1)),))

BASE = "(SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings)"
X, Y = "1e0 / (1e0 + exp(-(1e-1 + 5e-1 * a + 2e-1 * b - 6e-1 * c)))", "1e0 / (1e0 + exp(-(-2e-1 - 3e-1 * a + 8e-1 * b + 4e-1 * c)))"
HIDDEN = f"(SELECT *, {X} AS x, {Y} AS y FROM {BASE})"
OUT = f"(SELECT *, 5e-2 + 7e-1 * x - 9e-1 * y AS o FROM {HIDDEN})"


def _rows(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", *(e[k].cast("double").alias(n) for k, n in enumerate(("i:a", "i:b", "i:c", "o:d"))))


@R(f"SELECT vec_id, round(x, 6) AS x, round(y, 6) AS y, round(o, 6) AS o FROM {OUT}")
def sys_expect(spark, sf_dir):
    out = sysm.forward(_rows(spark, sf_dir), SYSTEM, prefix="~")
    return rounded(out.select("vec_id", F.col("`~h:x`").alias("x"), F.col("`~h:y`").alias("y"), F.col("`~o:d`").alias("o")))


@R(f"SELECT vec_id, round(5e-2 + 7e-1 * (CASE WHEN x > 5e-1 THEN 1 ELSE 0 END) - 9e-1 * (CASE WHEN y > 5e-1 THEN 1 ELSE 0 END), 6) AS o FROM {HIDDEN}")
def sys_values(spark, sf_dir):
    return rounded(sysm.forward(_rows(spark, sf_dir), SYSTEM, how="values", prefix="~").select("vec_id", F.col("`~o:d`").alias("o")))


@R(f"SELECT vec_id, round(5e-2 + 7e-1 * (x > {draw_sql('vec_id', 5)})::INT - 9e-1 * (y > {draw_sql('vec_id', 6)})::INT, 6) AS o FROM {HIDDEN}")
def sys_samples(spark, sf_dir):
    return rounded(sysm.forward(_rows(spark, sf_dir), SYSTEM, how="samples", expect_last=True, seed=5, prefix="~", key=["vec_id"]).select("vec_id", F.col("`~o:d`").alias("o")))


@R(f"SELECT vec_id, round(d - o, 6) AS residual FROM {OUT}")
def sys_residuals(spark, sf_dir):
    return rounded(sysm.residuals(_rows(spark, sf_dir), SYSTEM).select("vec_id", F.col("`o:d`").alias("residual")))


BACK = {"a": "1e-1 + 5e-1 * x - 3e-1 * y", "b": "2e-1 * x + 8e-1 * y", "c": "-1e-1 - 6e-1 * x + 4e-1 * y"}
BACK_HIDDEN = f"(SELECT vec_id, 1e0 / (1e0 + exp(-(1e-1 + 7e-1 * d))) AS x, 1e0 / (1e0 + exp(-(-2e-1 - 9e-1 * d))) AS y FROM {BASE})"


@R(f"SELECT vec_id, {', '.join(f'round({e}, 6) AS {c}' for c, e in BACK.items())} FROM {BACK_HIDDEN}")
def sys_backward(spark, sf_dir):
    """Expectations of the inputs from the output, by the transposed weights."""
    out = sysm.forward(_rows(spark, sf_dir), SYSTEM, prefix="~", path=SYSTEM.path("o", "i"))
    return rounded(out.select("vec_id", *(F.col(f"`~i:{c}`").alias(c) for c in "abc")))


@R(f"SELECT vec_id, round(o, 6) AS o FROM {OUT}")
def ds_apply_system(spark, sf_dir):
    """A dataset whose columns are replaced by the outputs that the system expects."""
    from lumenframe.operators.dataset import Dataset

    e = F.col("embedding")
    plain = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("label"), *(e[k].cast("double").alias(n) for k, n in enumerate("abc")))
    made = Dataset({"embeddings": plain}, {f"i:{c}": c for c in "abc"}).apply_system(SYSTEM)
    return rounded(made.rows().select(F.col("label").cast("long").alias("vec_id"), F.col("`o:d`").alias("o")))


MEASURE_SQL = {
    "mean": "avg(o)", "variance": "var_pop(o)", "error": "avg((d - o) * (d - o))",
    "accuracy": "1e0 - avg((d - o) * (d - o)) / avg(d * d)", "precision": "1e0 - stddev_pop(d - o) / stddev_pop(d)",
}


def _measure(name: str):
    return lambda spark, sf_dir: rounded(registry.get("unit_measure", name)(_rows(spark, sf_dir), SYSTEM))


for _n, _sql in MEASURE_SQL.items():
    R.add(f"sys_unit_{_n}", _measure(_n), f"SELECT 'o:d' AS unit, round({_sql}, 6) AS value FROM {OUT}")


@R(f"SELECT round(avg((d - o) * (d - o)), 6) AS value FROM {OUT}")
def sys_error(spark, sf_dir):
    return rounded(sysm.measure(_rows(spark, sf_dir), SYSTEM, "error"))


@R(f"SELECT round({MEASURE_SQL['accuracy']}, 6) AS value FROM {OUT}")
def sys_accuracy(spark, sf_dir):
    return rounded(sysm.measure(_rows(spark, sf_dir), SYSTEM, "accuracy"))


@R(f"SELECT round({MEASURE_SQL['precision']}, 6) AS value FROM {OUT}")
def sys_precision(spark, sf_dir):
    return rounded(sysm.measure(_rows(spark, sf_dir), SYSTEM, "precision"))


@R(f"SELECT 'h:x' AS unit, round(avg(-x * 1e-1), 6) AS value FROM {HIDDEN} UNION ALL SELECT 'h:y', round(avg(y * 2e-1), 6) FROM {HIDDEN} UNION ALL SELECT 'o:d', round(avg((o - 5e-2) * (o - 5e-2) / 2e0), 6) FROM {OUT}")
def sys_unit_energy(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return rounded(sysm.unit_energies(rows, SYSTEM, "h").unionByName(sysm.unit_energies(rows, SYSTEM)))


VX, VY = "(CASE WHEN x > 5e-1 THEN 1e0 ELSE 0e0 END)", "(CASE WHEN y > 5e-1 THEN 1e0 ELSE 0e0 END)"
LINKS_SQL = [("i:" + s, "h:" + t, f"{s} * {v} * {float(-W0[i, j])!r}") for i, s in enumerate("abc") for j, (t, v) in enumerate((("x", VX), ("y", VY)))]


@R(" UNION ALL ".join(f"SELECT '{s}' AS src, '{t}' AS dst, round(avg(CAST({e} AS DOUBLE)), 6) AS value FROM {HIDDEN}" for s, t, e in LINKS_SQL))
def sys_link_energy(spark, sf_dir):
    return rounded(sysm.link_energies(_rows(spark, sf_dir), SYSTEM, 0))


ENERGY = f"(a - 1e-1) * (a - 1e-1) / 2e0 + b * b / 2e0 + (c + 1e-1) * (c + 1e-1) / 2e0 - x * 1e-1 + y * 2e-1 + (o - 5e-2) * (o - 5e-2) / 2e0 + {' + '.join(e for _, _, e in LINKS_SQL)} - 7e-1 * x * o + 9e-1 * y * o"


@R(f"SELECT round(ln(1e0 + sum(exp(-({ENERGY})))), 6) AS value FROM {OUT}")
def sys_energy(spark, sf_dir):
    return rounded(sysm.energy(_rows(spark, sf_dir), SYSTEM))


def _geography(spark, sf_dir):
    """Links region -> nation with a weight from the keys."""
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.lit(0).alias("src_layer_id"), F.concat(F.lit("r:"), "n_regionkey").alias("src"), F.concat(F.lit("n:"), "n_nationkey").alias("dst"), F.lit(1.0).alias("adjacency"),
        ((F.col("n_nationkey") - 12) / 10.0).cast("double").alias("weight"),
    )


STEP = "1e0 / (1e0 + exp(-1e1 * ({})))"


@R(
    f"""SELECT src, dst, sign(weight)::DOUBLE AS sign, round(n, 6) AS normal, round(CASE WHEN weight = 0 THEN 0e0 ELSE abs(n) * ({STEP.format('n - s / 2e0')} + {STEP.format('n + s / 2e0')} - 1e0) / abs({STEP.format('s / 2e0')} + {STEP.format('15e-1 * s')} - 1e0) END, 6) AS intensity
    FROM (SELECT *, weight * sum(1e0) OVER () / sum(abs(weight)) OVER () AS n, 7e-1 * max(abs(weight)) OVER () * sum(1e0) OVER () / sum(abs(weight)) OVER () AS s
    FROM (SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst, (n_nationkey - 12) / 1e1 AS weight FROM nation))"""
)
def sys_link_attrs(spark, sf_dir):
    return rounded(sysm.link_attributes(_geography(spark, sf_dir)).select("src", "dst", "sign", "normal", "intensity"))


def _territory(spark, sf_dir) -> System:
    """Regions and nations, two fixed small tables, as a system."""
    g = graph_of_tables(spark, sf_dir)
    return sysm.from_network(net.Network(g.nodes.where("layer_id < 2"), g.edges.where("layer_id < 1"), "territory"))


@R("SELECT 'gauss' AS \"group\", string_agg('region:' || r_regionkey, ',' ORDER BY r_regionkey) AS units FROM region UNION ALL SELECT 'sigmoid', string_agg('nation:' || n_nationkey, ',' ORDER BY n_nationkey) FROM nation")
def sys_units(spark, sf_dir):
    """Units by their kind."""
    return _territory(spark, sf_dir).units(spark, groupby="class").select("group", F.array_join("units", ",").alias("units"))


@R("SELECT 'r:' || n_regionkey AS \"group\", string_agg('r:' || n_regionkey || '>n:' || n_nationkey, ',' ORDER BY 'n:' || n_nationkey) AS links FROM nation WHERE n_nationkey < 12 GROUP BY n_regionkey")
def sys_links(spark, sf_dir):
    """Links of negative sign, by their source."""
    return sysm.select_links(sysm.link_attributes(_geography(spark, sf_dir)), "src", sign=-1.0).select("group", F.array_join("links", ",").alias("links"))


@R("SELECT 'region' AS layer, 0 AS layer_id FROM region WHERE r_regionkey = 0")
def sys_layers(spark, sf_dir):
    """Visible layers; the colour, which no layer has, is passed over."""
    return _territory(spark, sf_dir).layer_names(spark, visible=True, colour="red")


@R("SELECT (SELECT count(*) FROM nation) AS links, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS units")
def sys_from_network(spark, sf_dir):
    s = _territory(spark, sf_dir)
    return spark.createDataFrame([(sum(int(a.sum()) for a in s.adjacency), sum(len(u.labels) for u in s.layers))], "links long, units long")


# ---------------------------------------------------------------- relations


@R(" UNION ALL ".join(f"SELECT 'i:{s}' AS src, 'o:d' AS tgt, round(corr({s}, d), 6) AS value FROM {BASE}" for s in "abc"))
def rel_correlation(spark, sf_dir):
    return rounded(relations.correlation(_rows(spark, sf_dir), SYSTEM))


@R("""SELECT 'r:' || n_regionkey AS src, m.mktsegment AS tgt, round(sum((n_nationkey - 12) / 1e1 * m.weight), 4) AS value FROM nation
    JOIN (SELECT c_nationkey, c_mktsegment AS mktsegment, avg(c_acctbal) / 1e3 AS weight FROM customer GROUP BY ALL) m ON c_nationkey = n_nationkey GROUP BY ALL""")
def rel_weightsum(spark, sf_dir):
    """Regions to market segments over nations, whose links to segments weigh mean balances."""
    balance = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg((F.avg("c_acctbal") / 1e3).alias("weight"))
    links = balance.select(F.lit(1).alias("src_layer_id"), F.concat(F.lit("n:"), "c_nationkey").alias("src"), F.col("c_mktsegment").alias("dst"), "weight")
    return rounded(relations.weight_sum_product(_geography(spark, sf_dir).drop("adjacency").unionByName(links)), 4)


def _held(s: str) -> str:
    cells = ", ".join(f"avg({s}) OVER () AS {s}" if c == s else c for c in "abcd")
    return f"(SELECT *, 5e-2 + 7e-1 * x - 9e-1 * y AS o FROM (SELECT *, {X} AS x, {Y} AS y FROM (SELECT vec_id, {cells} FROM {BASE})))"


@R(" UNION ALL ".join(f"SELECT 'i:{s}' AS src, 'o:d' AS tgt, round((SELECT avg((d - o) * (d - o)) FROM {_held(s)}) - (SELECT avg((d - o) * (d - o)) FROM {OUT}), 6) AS value" for s in "abc"))
def rel_knockout(spark, sf_dir):
    return rounded(relations.knockout(_rows(spark, sf_dir), SYSTEM))


def _induced(s: str, points: int = 10, gauge: str = "25e-2") -> str:
    point = f"(SELECT p, v FROM (SELECT {s} AS v, row_number() OVER (ORDER BY {s}) - 1 AS r, count(*) OVER () AS n FROM {BASE}), (SELECT unnest(range({points})) AS p) WHERE r = floor((p + 5e-1) * floor(n / {points})))"
    moved = ", ".join(f"v AS {s}" if c == s else c for c in "abcd")
    out = f"(SELECT vec_id, d, 5e-2 + 7e-1 * ({X}) - 9e-1 * ({Y}) AS o FROM (SELECT vec_id, p, {moved} FROM {BASE}, {point}))"
    ranked = f"(SELECT q, row_number() OVER (ORDER BY q) - 1 AS r, count(*) OVER () AS n FROM (SELECT vec_id, stddev_pop(o) AS q FROM {out} GROUP BY vec_id))"
    return f"SELECT 'i:{s}' AS src, 'o:d' AS tgt, (SELECT avg(q) FROM {ranked} WHERE r >= floor((1e0 - {gauge}) * n)) / (SELECT stddev_pop(d) FROM {BASE}) AS value"


RAW = " UNION ALL ".join(_induced(s) for s in "abc")
SHARP = "1e0 / (1e0 + exp(-2e1 * ({})))"


@R(f"SELECT src, tgt, round(value, 6) AS value FROM ({RAW})")
def rel_raw_induction(spark, sf_dir):
    return rounded(relations.raw_induction(_rows(spark, sf_dir), SYSTEM))


@R(
    f"SELECT src, tgt, round(abs(value) * ({SHARP.format('value - s / 2e0')} + {SHARP.format('value + s / 2e0')} - 1e0) / abs({SHARP.format('s / 2e0')} + {SHARP.format('15e-1 * s')} - 1e0), 6) AS value FROM (SELECT *, max(value) OVER () AS s FROM ({RAW}))"
)
def rel_induction(spark, sf_dir):
    return rounded(relations.induction(_rows(spark, sf_dir), SYSTEM))


def _contrasted(raw: str) -> str:
    return f"(SELECT src, tgt, abs(value) * ({SHARP.format('value - s / 2e0')} + {SHARP.format('value + s / 2e0')} - 1e0) / abs({SHARP.format('s / 2e0')} + {SHARP.format('15e-1 * s')} - 1e0) AS value FROM (SELECT *, max(value) OVER () AS s FROM ({raw})))"


def _fixed(raw: str, c: str) -> str:
    """The same over rows in which a column is 10."""
    return raw.replace(BASE, f"(SELECT vec_id, {', '.join(f'1e1 AS {x}' if x == c else x for x in 'abcd')} FROM {BASE})")


RAW4 = " UNION ALL ".join(_induced(s, 4, "1e-1") for s in "abc")


@R(
    f"WITH z AS (SELECT * FROM {_contrasted(RAW4)})"
    + " UNION ALL ".join(f" SELECT h.src, 'i:{c}' AS tgt, round(sqrt(sum((h.value - z.value) * (h.value - z.value))), 6) AS value FROM {_contrasted(_fixed(RAW4, c))} h JOIN z ON h.src = z.src AND h.tgt = z.tgt GROUP BY h.src" for c in "abc")
)
def rel_coinduction(spark, sf_dir):
    return rounded(relations.coinduction(_rows(spark, sf_dir), SYSTEM, points=4))


@R(" UNION ALL ".join(f"SELECT 'i:{s}' AS src, 'o:d' AS tgt, round(corr({s}, d) * corr({s}, d), 6) AS value FROM {BASE}" for s in "abc"))
def rel_transform(spark, sf_dir):
    return rounded(relations.evaluate("correlation", _rows(spark, sf_dir), SYSTEM, expression="M * M"))


MEASURES_SQL = " UNION ALL ".join(f"SELECT '{a}' AS src, '{b}' AS tgt, corr({a}, {b}) AS value FROM {BASE}" for a in "abcd" for b in "abcd")


@R(
    f"""WITH m AS ({MEASURES_SQL}), s AS (SELECT stddev_pop(value) AS std FROM m WHERE src <> tgt),
    k AS (SELECT src, tgt, value, abs(value / std) AS w FROM m, s WHERE src <> tgt AND NOT (value > -5e-1 * std AND value < 5e-1 * std))
    SELECT src, tgt, round(w / (SELECT avg(w) FROM k), 5) AS weight, CASE WHEN value > 0 THEN 1 ELSE -1 END AS sign FROM k"""
)
def rel_graph_cutoff(spark, sf_dir):
    from lumenframe.operators import stats

    plain = _rows(spark, sf_dir).toDF("vec_id", "a", "b", "c", "d")
    return rounded(relations.relation_graph(stats.correlation(plain, list("abcd"))), 5)


@R(f"SELECT bool_and(abs(m.value - o.value) <= 1e-8 + 1e-5 * abs(o.value)) AS ok FROM ({MEASURES_SQL}) m JOIN ({MEASURES_SQL}) o ON m.src = o.tgt AND m.tgt = o.src")
def rel_symmetric(spark, sf_dir):
    from lumenframe.operators import stats

    plain = _rows(spark, sf_dir).toDF("vec_id", "a", "b", "c", "d")
    return relations.is_symmetric(stats.correlation(plain, list("abcd")))


@R("SELECT src, " + ", ".join(f"max(CASE WHEN tgt = '{t}' THEN round(value, 6) END) AS {t}" for t in "abcd") + f" FROM ({MEASURES_SQL}) GROUP BY src")
def rel_heatmap(spark, sf_dir):
    """Correlations as a matrix."""
    from lumenframe.operators import stats

    plain = _rows(spark, sf_dir).toDF("vec_id", "a", "b", "c", "d")
    return rounded(relations.as_heatmap(stats.correlation(plain, list("abcd")), list("abcd")))


@R(f"""WITH m AS ({MEASURES_SQL}), v AS (SELECT value FROM m WHERE src <> tgt), e AS (SELECT min(value) AS a, max(value) AS b FROM v)
    SELECT bin, round(a + bin * (b - a) / 4, 6) AS lo, round(a + (bin + 1) * (b - a) / 4, 6) AS hi, count(*) AS n FROM (SELECT least(floor((value - a) / ((b - a) / 4)), 3)::BIGINT AS bin, a, b FROM v, e) GROUP BY bin, a, b""")
def rel_histogram(spark, sf_dir):
    """Of the correlations of different columns, in four bins."""
    from lumenframe.operators import stats

    plain = _rows(spark, sf_dir).toDF("vec_id", "a", "b", "c", "d")
    return rounded(relations.as_histogram(stats.correlation(plain, list("abcd")), 4))


# ---------------------------------------------------------------- training


@R(
    f"""SELECT 'bias o:d' AS parameter, round(5e-2 - 1e-1 * avg(e), 6) AS value FROM (SELECT *, 5e-2 + 3e-1 * a - 2e-1 * b + 1e-1 * c - d AS e FROM {BASE})"""
    + "".join(f" UNION ALL SELECT 'weight i:{s} o:d', round({w} - 1e-1 * sum({s} * e) / (count(*) * 3), 6) FROM (SELECT *, 5e-2 + 3e-1 * a - 2e-1 * b + 1e-1 * c - d AS e FROM {BASE})" for s, w in (("a", "3e-1"), ("b", "-2e-1"), ("c", "1e-1")))
)
def train_bprop_step(spark, sf_dir):
    return rounded(train.bprop_step(_rows(spark, sf_dir), SHALLOW))


@R(
    f"""SELECT 'bias o:d' AS parameter, round(5e-2 - 12e-4 * sign(avg(e)), 6) AS value FROM (SELECT *, 5e-2 + 3e-1 * a - 2e-1 * b + 1e-1 * c - d AS e FROM {BASE})"""
    + "".join(f" UNION ALL SELECT 'weight i:{s} o:d', round({w} - 12e-4 * sign(sum({s} * e)), 6) FROM (SELECT *, 5e-2 + 3e-1 * a - 2e-1 * b + 1e-1 * c - d AS e FROM {BASE})" for s, w in (("a", "3e-1"), ("b", "-2e-1"), ("c", "1e-1")))
)
def train_rprop_step(spark, sf_dir):
    return rounded(train.rprop_step(_rows(spark, sf_dir), SHALLOW))


def _after(steps: int) -> str:
    """Parameters after so many updates over all rows, each from the sums of the one before."""
    out = "WITH p0 AS (SELECT 5e-2 AS o, 3e-1 AS a, -2e-1 AS b, 1e-1 AS c)"
    for k in range(1, steps + 1):
        error = "p.o + p.a * r.a + p.b * r.b + p.c * r.c - r.d"
        out += f", p{k} AS (SELECT min(p.o) - 1e-1 * avg({error}) AS o" + "".join(f", min(p.{s}) - 1e-1 * sum(r.{s} * ({error})) / (count(*) * 3) AS {s}" for s in "abc") + f" FROM p{k - 1} p, {BASE} r)"
    return out + f" SELECT 'bias o:d' AS parameter, round(o, 6) AS value FROM p{steps}" + "".join(f" UNION ALL SELECT 'weight i:{s} o:d', round({s}, 6) FROM p{steps}" for s in "abc")


@R(_after(3))
def train_epochs(spark, sf_dir):
    """Three epochs of one minibatch a task: each is an update over all rows."""
    fitted = epochs.fit_epochs(_rows(spark, sf_dir), SHALLOW, Schedule(minibatch=1 << 30), 3)
    values = [("bias o:d", float(fitted.layers[1].bias[0])), *((f"weight i:{s} o:d", float(w)) for s, w in zip("abc", fitted.weights[0][:, 0], strict=True))]
    return rounded(spark.createDataFrame(values, "parameter string, value double"))


def _trained(algorithm: str, system: System, **options):
    def query(spark, sf_dir):
        rows = _rows(spark, sf_dir)
        fitted = train.fit(rows, sysm.initialize(system, rows), Schedule(updates=100, rounds=2, algorithm=algorithm, options=options))
        return sysm.measure(rows, fitted, "error").select(F.lit(algorithm).alias("algorithm"), F.col("value").alias("error"))

    return query


R.add("train_shallow", _trained("bprop", SHALLOW))
R.add("train_rprop", _trained("rprop", SHALLOW))


def _machine(kind: str):
    def query(spark, sf_dir):
        cells = _rows(spark, sf_dir).toDF("vec_id", "visible:a", "visible:b", "visible:c", "visible:d")
        if kind == "sigmoid":
            cells = cells.select("vec_id", *((F.col(f"`{c}`") > 0).cast("double").alias(c) for c in cells.columns[1:]))
        start = sysm.initialize(train.rbm(cells.columns[1:], 3, kind), cells if kind == "gauss" else None)
        fitted = train.fit(cells, start, Schedule(updates=60, rounds=2, rate=0.05, algorithm="contrastive", objective=None))
        return fitted.links_table(spark).select("src", "dst", "weight")

    return query


R.add("train_rbm", _machine("sigmoid"))
R.add("train_grbm", _machine("gauss"))


@R()
def train_deep(spark, sf_dir):
    """Pretraining by pairs of layers, then gradients."""
    rows = _rows(spark, sf_dir)
    g = net.build(spark, [net.Layer("i", ("a", "b", "c")), net.Layer("h1", ("n1", "n2"), False, "sigmoid"), net.Layer("o", ("d",))])
    system = sysm.initialize(sysm.from_network(g), rows)
    fitted = train.fit_deep(rows, system, Schedule(updates=100, rounds=2, rate=0.05))
    return sysm.measure(rows, fitted, "error").withColumnRenamed("value", "error")


# ---------------------------------------------------------------- streams


@R("SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """The streaming query's plan on the batch of all events."""
    made = score.windowed_counts(table(spark, sf_dir, "events"))
    return made.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@R(
    """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s
    FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s"""
)
def stream_sessions(spark, sf_dir):
    made = score.sessions(table(spark, sf_dir, "events"))
    return made.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


def queries():
    return dict(R.found)


def oracle_sql():
    return dict(R.sql)
