"""Curves, vector and matrix norms and distances, regression errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import curves, matrices, regress, vectors
from lumenframe.functions import registry as reg
from lumenframe.queries.common import Registry, rounded, table

R = Registry()

# ---------------------------------------------------------------- curves

L = "(1e0 / (1e0 + exp(-({}))))"
CURVE_SQL = {
    ("sigmoid", "logistic"): "1e0 / (1e0 + exp(-x))",
    ("sigmoid", "tanh"): "tanh(x)",
    ("sigmoid", "lecun"): "17159e-4 * tanh(6666e-4 * x)",
    ("sigmoid", "elliot"): "x / (1e0 + abs(x))",
    ("sigmoid", "hill"): "x / sqrt(1e0 + x * x)",
    ("sigmoid", "arctan"): "atan(x)",
    ("bell", "gauss"): "exp(-x * x / 2e0) / sqrt(2e0 * pi())",
    ("bell", "d_logistic"): "exp(-x) / pow(1e0 + exp(-x), 2)",
    ("bell", "d_elliot"): "1e0 / pow(abs(x) + 1e0, 2)",
    ("bell", "d_hill"): "pow(1e0 + x * x, -15e-1)",
    ("bell", "d_tanh_lecun"): "114382e-5 / pow(cosh(6666e-4 * x), 2)",
    ("bell", "d_tanh"): "1e0 - pow(tanh(x), 2)",
    ("bell", "d_arctan"): "1e0 / (1e0 + x * x)",
    ("softstep", "dialogistic"): f"abs(x) * ({L.format('1e1 * (x - 5e-1)')} + {L.format('1e1 * (x + 5e-1)')} - 1e0) / abs({L.format('5e0')} + {L.format('15e0')} - 1e0)",
    ("softstep", "softstep"): f"tanh(abs(x) * ({L.format('1e1 * (x - 5e-1)')} + {L.format('1e1 * (x + 5e-1)')} - 1e0) / abs({L.format('5e0')} + {L.format('15e0')} - 1e0)) / tanh(1e0)",
    ("softstep", "multi_logistic"): f"floor(x) + {L.format('1e1 * (2e0 * (x - floor(x)) - 1e0)')} / (2e0 / {L.format('1e1')} - 1e0)",
}


def _curve(category: str, name: str):
    def query(spark, sf_dir):
        x = F.col("l_discount") * 40 - F.col("l_quantity") / 25
        df = table(spark, sf_dir, "lineitem").select("l_returnflag", reg.get(category, name)(x).alias("y"))
        return rounded(df.groupBy("l_returnflag").agg(F.sum("y").alias("total"), F.avg("y").alias("mean")), 5)

    return query


for (_c, _n), _sql in CURVE_SQL.items():
    R.add(
        f"curve_{_n}", _curve(_c, _n),
        f"SELECT l_returnflag, round(sum(y), 5) AS total, round(avg(y), 5) AS mean FROM (SELECT l_returnflag, {_sql} AS y FROM (SELECT l_returnflag, l_discount * 4e1 - l_quantity / 25e0 AS x FROM lineitem)) GROUP BY l_returnflag",
    )

# ---------------------------------------------------------------- vectors

ROW_NORM_SQL = {
    "p-norm": "pow(sum(pow(abs(x), 3)), 1e0 / 3e0)", "1-norm": "sum(abs(x))", "euclid": "sqrt(sum(x * x))", "maximum": "max(abs(x))",
    "p-mean": "pow(avg(pow(abs(x), 3)), 1e0 / 3e0)", "abs-mean": "avg(abs(x))", "quadratic-mean": "sqrt(avg(x * x))",
}
ARRAY_NORM_SQL = {
    "p-norm": "pow(list_sum(list_transform(v, lambda a: pow(abs(a), 3))), 1e0 / 3e0)", "1-norm": "list_sum(list_transform(v, lambda a: abs(a)))",
    "euclid": "sqrt(list_sum(list_transform(v, lambda a: a * a)))", "maximum": "list_max(list_transform(v, lambda a: abs(a)))",
    "p-mean": "pow(list_avg(list_transform(v, lambda a: pow(abs(a), 3))), 1e0 / 3e0)", "abs-mean": "list_avg(list_transform(v, lambda a: abs(a)))",
    "quadratic-mean": "sqrt(list_avg(list_transform(v, lambda a: a * a)))",
}


def _p(name: str) -> dict[str, float]:
    return {"p": 3} if name in ("p-norm", "p-mean", "minkowski") else {}


def _row_norm(name: str):
    def query(spark, sf_dir):
        df = table(spark, sf_dir, "lineitem")
        return rounded(df.groupBy("l_returnflag").agg(vectors.length(F.col("l_tax") - F.col("l_discount"), name, **_p(name)).alias("norm")))

    return query


def _array_norm(name: str):
    def query(spark, sf_dir):
        return rounded(table(spark, sf_dir, "embeddings").select("vec_id", vectors.array_length(F.col("embedding"), name, **_p(name)).alias("norm")))

    return query


def _row_distance(name: str):
    def query(spark, sf_dir):
        df = table(spark, sf_dir, "lineitem")
        return rounded(df.groupBy("l_linestatus").agg(vectors.distance(F.col("l_tax"), F.col("l_discount"), name, **_p(name)).alias("distance")))

    return query


def _array_distance(name: str):
    def query(spark, sf_dir):
        em = table(spark, sf_dir, "embeddings")
        other = em.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
        return rounded(em.join(other, "vec_id").select("vec_id", vectors.array_distance(F.col("embedding"), F.col("b"), name, **_p(name)).alias("distance")))

    return query


for _n, _sql in ROW_NORM_SQL.items():
    R.add(f"vec_norm_{_n.replace('-', '_')}", _row_norm(_n), f"SELECT l_returnflag, round({_sql}, 6) AS norm FROM (SELECT l_returnflag, l_tax - l_discount AS x FROM lineitem) GROUP BY l_returnflag")
    R.add(f"arr_norm_{_n.replace('-', '_')}", _array_norm(_n), f"SELECT vec_id, round({ARRAY_NORM_SQL[_n]}, 6) AS norm FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)")
for _d, _n in vectors.DISTANCES.items():
    R.add(f"vec_dist_{_d.replace('-', '_')}", _row_distance(_d), f"SELECT l_linestatus, round({ROW_NORM_SQL[_n]}, 6) AS distance FROM (SELECT l_linestatus, l_tax - l_discount AS x FROM lineitem) GROUP BY l_linestatus")
    R.add(
        f"arr_dist_{_d.replace('-', '_')}", _array_distance(_d),
        f"SELECT vec_id, round({ARRAY_NORM_SQL[_n]}, 6) AS distance FROM (SELECT a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE - z[2]::DOUBLE) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)",
    )

# ---------------------------------------------------------------- matrices


def _cells(spark, sf_dir, parity: int | None = None):
    em = table(spark, sf_dir, "embeddings")
    if parity is not None:
        em = em.where((F.col("vec_id") % 2 == parity)).withColumn("vec_id", F.floor(F.col("vec_id") / 2))
    return em.select("label", F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")).select("label", "i", "j", F.col("v").cast("double").alias("value"))


CELLS = "(SELECT label, vec_id AS i, unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS value FROM embeddings)"
PAIRED = """(SELECT 0 AS grp, a.i, a.j, a.value - b.value AS value
    FROM (SELECT vec_id // 2 AS i, unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS value FROM embeddings WHERE vec_id % 2 = 0) a
    JOIN (SELECT vec_id // 2 AS i, unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS value FROM embeddings WHERE vec_id % 2 = 1) b USING (i, j))"""


@R(f"SELECT label, round(sqrt(sum(value * value)), 6) AS norm FROM {CELLS} GROUP BY label")
def mat_frob(spark, sf_dir):
    return rounded(matrices.norm(_cells(spark, sf_dir), ["label"], "frobenius"))


@R(f"SELECT label, round(pow(sum(pow(s, 2e0 / 3e0)), 1e0 / 2e0), 6) AS norm FROM (SELECT label, j, sum(pow(abs(value), 3)) AS s FROM {CELLS} GROUP BY label, j) GROUP BY label")
def mat_pq_norm(spark, sf_dir):
    return rounded(matrices.norm(_cells(spark, sf_dir), ["label"], "pq-norm", p=3, q=2))


def _pair(spark, sf_dir):
    return (_cells(spark, sf_dir, k).withColumn("grp", F.lit(0)).drop("label") for k in (0, 1))


@R(f"SELECT grp, round(sqrt(sum(value * value)), 6) AS distance FROM {PAIRED} GROUP BY grp")
def mat_frob_dist(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return rounded(matrices.distance(a, b, ["grp"], "frobenius"))


@R(f"SELECT grp, round(sqrt(sum(pow(s, 2e0))), 6) AS distance FROM (SELECT grp, j, sum(abs(value)) AS s FROM {PAIRED} GROUP BY grp, j) GROUP BY grp")
def mat_pq_dist(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return rounded(matrices.distance(a, b, ["grp"], "pq-distance", p=1, q=2))


# ---------------------------------------------------------------- regression errors

ERROR_SQL = {"sad": "sum(abs(x - y))", "rss": "sum((x - y) * (x - y))", "mse": "avg((x - y) * (x - y))", "mae": "avg(abs(x - y))", "rmse": "sqrt(avg((x - y) * (x - y)))"}


def _error(name: str):
    def query(spark, sf_dir):
        df = table(spark, sf_dir, "lineitem")
        x, y = F.col("l_extendedprice") / 1000, F.col("l_quantity") * 1.5
        return rounded(df.groupBy("l_linenumber").agg(regress.error(x, y, name).alias("error")), 4)

    return query


for _n, _sql in ERROR_SQL.items():
    R.add(f"err_{_n}", _error(_n), f"SELECT l_linenumber, round({_sql}, 4) AS error FROM (SELECT l_linenumber, l_extendedprice / 1e3 AS x, l_quantity * 15e-1 AS y FROM lineitem) GROUP BY l_linenumber")


@R("SELECT c.category, c.n, t.total FROM (VALUES ('sigmoid', 6::BIGINT), ('bell', 7), ('softstep', 3), ('vector_norm', 7), ('vector_distance', 7), ('matrix_norm', 2), ('matrix_distance', 2), ('error', 5)) c(category, n), (SELECT round(sum(1e0 / (1e0 + exp(-l_discount))), 4) AS total FROM lineitem) t")
def fn_catalog(spark, sf_dir):
    """Number of registered functions by category, and the sum over a column of one that is looked up by its name."""
    kinds = ("sigmoid", "bell", "softstep", "vector_norm", "vector_distance", "matrix_norm", "matrix_distance", "error")
    total = table(spark, sf_dir, "lineitem").agg(F.round(F.sum(reg.get("sigmoid", "logistic")(F.col("l_discount"))), 4).alias("total"))
    return spark.createDataFrame([(c, len(reg.names(c))) for c in kinds], "category string, n long").join(F.broadcast(total), how="cross")


def queries():
    return dict(R.found)


def oracle_sql():
    return dict(R.sql)
