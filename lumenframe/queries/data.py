"""Datasets, preparation steps, statistics, arrays and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import arrays, labels, stats, wide
from lumenframe.operators import dataset as ds
from lumenframe.operators.dataset import Dataset
from lumenframe.queries.common import LINE_KEY, MEASURES, Registry, draw_sql, normal_sql, rounded, table

R = Registry()


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_returnflag", "l_linestatus", *MEASURES)


def _parties(spark, sf_dir) -> Dataset:
    """Customers and suppliers as tables of one dataset, with grouped external columns."""
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("label"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("label"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return Dataset({"customer": c, "supplier": s}, {"place:nation": "nation", "money:balance": "balance"})


PARTIES = """(SELECT 'customer' AS t, c_name AS label, c_nationkey::DOUBLE AS nation, c_acctbal AS balance FROM customer
    UNION ALL SELECT 'supplier', s_name, s_nationkey::DOUBLE, s_acctbal FROM supplier)"""


@R(f'SELECT t || \':\' || label AS "row", nation, balance FROM {PARTIES}')
def ds_union_tables(spark, sf_dir):
    rows = _parties(spark, sf_dir).rows()
    return rows.select(F.concat_ws(":", ds.TABLE, ds.LABEL).alias("row"), F.col("`place:nation`").alias("nation"), F.col("`money:balance`").alias("balance"))


@R(f"SELECT t AS \"table\", label, balance FROM {PARTIES} WHERE t = 'supplier' OR label IN ('Customer#7', 'Customer#000000007')")
def ds_row_filter(spark, sf_dir):
    data = _parties(spark, sf_dir).with_row_filter("picked", ["supplier:*", "customer:Customer#7", "customer:Customer#000000007"])
    return data.rows("picked", "money:*").select(F.col(ds.TABLE).alias("table"), ds.LABEL, F.col("`money:balance`").alias("balance"))


@R(f"SELECT label, balance FROM {PARTIES}")
def ds_col_filter(spark, sf_dir):
    data = _parties(spark, sf_dir).with_column_filter("amounts", ["money:*"])
    return data.rows(columns="amounts").select("label", F.col("`money:balance`").alias("balance"))


@R(f"SELECT 'place' AS grp, 'nation' AS name, count(nation) AS n, round(sum(nation), 2) AS total FROM {PARTIES} UNION ALL SELECT 'money', 'balance', count(balance), round(sum(balance), 2) FROM {PARTIES}")
def ds_colgroups(spark, sf_dir):
    """Column groups with the sums of their columns."""
    data = _parties(spark, sf_dir)
    cells = [F.struct(F.lit(g).alias("grp"), F.lit(n).alias("name"), F.count(F.col(f"`{g}:{n}`")).alias("n"), F.round(F.sum(F.col(f"`{g}:{n}`")), 2).alias("total")) for g, ns in data.column_groups().items() for n in ns]
    return data.rows().agg(F.array(*cells).alias("m")).select(F.inline("m"))


@R(f"SELECT t AS \"table\", round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM {PARTIES} GROUP BY t")
def ds_stratify_proportional(spark, sf_dir):
    made = _parties(spark, sf_dir).stratify("proportional").fractions
    return rounded(spark.createDataFrame(list(made.items()), "table string, fraction double"))


@R(f'SELECT t AS "table", 100 // count(*) OVER () AS n FROM {PARTIES} GROUP BY t')
def ds_stratify_equal(spark, sf_dir):
    """A hundred rows, half of them from each table however large."""
    return _parties(spark, sf_dir).stratify("equal").sample(100, seed=5).groupBy(F.col(ds.TABLE).alias("table")).agg(F.count("*").alias("n"))


@R("SELECT l_returnflag, round(avg((l_quantity - m) / s), 6) AS mean, round(stddev_pop((l_quantity - m) / s), 6) AS std FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem) GROUP BY l_returnflag")
def ds_norm_gauss(spark, sf_dir):
    data = Dataset({"lineitem": _lines(spark, sf_dir)}, {"l_quantity": "l_quantity"}).normalize("gauss")
    return rounded(data.tables["lineitem"].groupBy("l_returnflag").agg(F.avg("l_quantity").alias("mean"), F.stddev_pop("l_quantity").alias("std")))


SLICE = """(SELECT name, avg(x) AS threshold FROM (SELECT name, x, row_number() OVER (PARTITION BY name ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY name) AS n
    FROM (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME name VALUE x))
    WHERE r >= floor(5e-1 * n) - floor(5e-2 * n) AND r < floor(5e-1 * n) + floor(5e-2 * n) GROUP BY name)"""


@R(f"SELECT name, round(threshold, 6) AS threshold FROM {SLICE}")
def ds_bernoulli_threshold(spark, sf_dir):
    return rounded(stats.rank_quantile(_lines(spark, sf_dir), MEASURES))


@R(f"SELECT l_returnflag, sum(CASE WHEN l_quantity > (SELECT threshold FROM {SLICE} WHERE name = 'l_quantity') THEN 1e0 ELSE 0e0 END) AS above FROM lineitem GROUP BY l_returnflag")
def ds_norm_bernoulli(spark, sf_dir):
    data = Dataset({"lineitem": _lines(spark, sf_dir)}, {"l_quantity": "l_quantity"}).normalize("bernoulli")
    return data.tables["lineitem"].groupBy("l_returnflag").agg(F.sum("l_quantity").alias("above"))


def _transform(mode: str):
    def query(spark, sf_dir):
        x = (F.col("l_discount") - 0.05) * 20
        return rounded(_lines(spark, sf_dir).groupBy("l_returnflag").agg(F.avg(ds.TRANSFORMS[mode](x)).alias("mean")))

    return query


for _m, _f in {"binary": "CASE WHEN x > 0 THEN 1e0 ELSE 0e0 END", "weight": "2e0 / (1e0 + exp(-x * x))", "distance": "1e0 - 2e0 / (1e0 + exp(-x * x))"}.items():
    R.add(f"ds_transform_{_m}", _transform(_m), f"SELECT l_returnflag, round(avg({_f}), 6) AS mean FROM (SELECT l_returnflag, (l_discount - 5e-2) * 2e1 AS x FROM lineitem) GROUP BY l_returnflag")


@R("SELECT coalesce(bool_and(quality IN (0, 1) AND toxic IN (0, 1)), true) AS ok FROM labels")
def ds_test_binary(spark, sf_dir):
    return stats.test_binary(table(spark, sf_dir, "labels"), ["quality", "toxic"])


@R("SELECT abs(avg((l_quantity - m) / s)) < 5e-2 AND abs(stddev_pop((l_quantity - m) / s) - 1e0) < 5e-2 AS ok FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem)")
def ds_test_gauss(spark, sf_dir):
    data = Dataset({"lineitem": _lines(spark, sf_dir)}, {"l_quantity": "l_quantity"}).normalize("gauss")
    return data.evaluate("gauss", ["l_quantity"])


def _noise(kind: str):
    def query(spark, sf_dir):
        df = ds.add_noise(_lines(spark, sf_dir), ["l_discount"], kind, 0.1, seed=7, key=LINE_KEY)
        return rounded(df.select(*LINE_KEY, "l_discount"), 8)

    return query


KEY_SQL = " || '|' || ".join(LINE_KEY)
U0, U1 = draw_sql(KEY_SQL, 7), draw_sql(KEY_SQL, 7, 1)
END = f"(CASE WHEN {U1} < 5e-1 THEN (SELECT max(l_discount) FROM lineitem) ELSE (SELECT min(l_discount) FROM lineitem) END)"
for _k, _f in {
    "gauss": f"l_discount + {normal_sql(KEY_SQL, 7)} * 1e-1", "mask": f"l_discount * ({U0} < 9e-1)::INT", "bernoulli": f"(l_discount <> ({U0} < 9e-1)::INT)::INT::DOUBLE",
    "salt": f"l_discount + ({U0} < 9e-1)::INT * {END}", "salt_replace": f"CASE WHEN {U0} < 1e-1 THEN {END} ELSE l_discount END",
}.items():
    R.add(f"ds_noise_{_k}", _noise(_k), f"SELECT {', '.join(LINE_KEY)}, round({_f}, 8) + 0e0 AS l_discount FROM lineitem")


SAMPLE_T = """SELECT t, label, nation, balance, place FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY label) - 1 AS i FROM {p}) JOIN (SELECT t, floor({u} * n)::BIGINT AS i, {v} AS place
    FROM (SELECT t, n, unnest(range(round_even(n / (sum(n) OVER ()) * 500, 0)::BIGINT)) AS k FROM (SELECT t, count(*) AS n FROM {p} GROUP BY t))) USING (t, i)""".format(p=PARTIES, u=draw_sql("t || '|' || k", 3), v=draw_sql("t || '|' || k", 3, 1))


@R(f'SELECT t AS "table", label, nation, balance FROM ({SAMPLE_T}) ORDER BY place LIMIT 500')
def ds_sample(spark, sf_dir):
    """500 rows drawn with replacement from both tables by size."""
    made = _parties(spark, sf_dir).stratify("proportional").sample(500, seed=3)
    return made.select(F.col(ds.TABLE).alias("table"), ds.LABEL, F.col("`place:nation`").alias("nation"), F.col("`money:balance`").alias("balance"))


@R(f"SELECT label, balance, balance AS \"balance.2\", nation FROM {PARTIES}")
def ds_read_recarray(spark, sf_dir):
    """Two names for one column, which is numbered."""
    return _parties(spark, sf_dir).with_columns({"a:x": "balance", "b:y": "balance", "c:z": "nation"}).read("recarray")


@R(f"SELECT nation + 2 * balance AS mixed, len([nation, balance])::INT AS n FROM {PARTIES}")
def ds_read_array(spark, sf_dir):
    cells = _parties(spark, sf_dir).read("array")
    return cells.select((F.col("values")[0] + 2 * F.col("values")[1]).alias("mixed"), F.size("values").alias("n"))


@R("SELECT 'customer' AS stem, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier")
def ds_read_rows(spark, sf_dir):
    rows = _parties(spark, sf_dir).read("rows")
    return rows.groupBy(F.substring_index("row", ":", 1).alias("stem")).agg(F.count("*").alias("n"))


@R(f"""SELECT t || ':' || label AS "row", balance AS "in:acct", nation AS "out:home", 'in:gone' AS lost, 'in:size' AS missing FROM {PARTIES}""")
def ds_configure(spark, sf_dir):
    """Nodes and columns under other names, of which one is unknown to the lookup and one to the tables."""
    lookup = spark.createDataFrame([("acct", "A"), ("balance", "A"), ("home", "N"), ("nation", "N"), ("size", "S")], "source string, target string")
    data = _parties(spark, sf_dir).configure({"in": ["balance", "gone", "size"], "out": ["nation"]}, lookup)
    out = data.rows()
    names = dict(zip(data.columns, ["in:acct", "out:home"], strict=True))
    return out.select(F.concat_ws(":", ds.TABLE, ds.LABEL).alias("row"), *(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.lit(",".join(data.meta["lost"])).alias("lost"), F.lit(",".join(data.meta["missing"])).alias("missing"))


@R("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity + l_tax AS o1, (l_quantity + l_tax) * 2e0 AS o2 FROM lineitem")
def ds_rules(spark, sf_dir):
    return ds.apply_rules(_lines(spark, sf_dir), [("o1", "l_quantity + l_tax"), ("o2", "o1 * 2")]).select(*LINE_KEY, "o1", "o2")


def _generated() -> str:
    drawn = ", ".join(f"{normal_sql('label', 1 + 2 * k)} * 1e-1 + ({draw_sql('label', 2 + 2 * k)} < 5e-1)::INT AS i{k + 1}" for k in range(4))
    ruled = f"(SELECT *, i1 + i2 AS o1, i3 + i4 AS o2 FROM (SELECT label, {drawn} FROM (SELECT o_orderkey::VARCHAR AS label FROM orders)))"
    scaled = ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) + 0e0 AS {c}" for c in ("i1", "i2", "i3", "i4", "o1", "o2"))
    return f"SELECT label, {scaled} FROM {ruled}"


@R(_generated())
def ds_generate(spark, sf_dir):
    """A synthetic row for each order, by rules."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("label"))
    made = ds.generate(spark, ["i1", "i2", "i3", "i4", "o1", "o2"], orders, rules=[("o1", "i1 + i2"), ("o2", "i3 + i4")], seed=1)
    return rounded(made.rows().drop(ds.TABLE))


# ---------------------------------------------------------------- statistics

PAIRS_SQL = " UNION ALL ".join(f"SELECT '{a}' AS src, '{b}' AS tgt, round({{f}}({a}, {b}), 5) AS value FROM lineitem" for a in MEASURES for b in MEASURES)


@R(PAIRS_SQL.format(f="covar_samp"))
def st_cov(spark, sf_dir):
    return rounded(stats.covariance(_lines(spark, sf_dir), MEASURES), 5)


@R(PAIRS_SQL.format(f="corr"))
def st_corr(spark, sf_dir):
    return rounded(stats.correlation(_lines(spark, sf_dir), MEASURES), 5)


# k-covariance with as many components as columns is the covariance itself, k-correlation the correlation
@R(PAIRS_SQL.format(f="corr"))
def st_kcorr_full(spark, sf_dir):
    return rounded(stats.k_correlation(_lines(spark, sf_dir), MEASURES, 4), 5)


@R()
def st_kcov(spark, sf_dir):
    return stats.k_covariance(_lines(spark, sf_dir), MEASURES, 2)


@R()
def st_kcorr(spark, sf_dir):
    return stats.k_correlation(_lines(spark, sf_dir), MEASURES, 2)


#: First component of two columns in closed form: l is the larger eigenvalue, (u, v) its direction.
FIRST = """(SELECT a, b, c, l, (l - c) / sqrt((l - c) * (l - c) + b * b) AS u, b / sqrt((l - c) * (l - c) + b * b) AS v
    FROM (SELECT *, (a + c) / 2e0 + sqrt((a - c) * (a - c) / 4e0 + b * b) AS l FROM (
    SELECT var_samp(l_discount) AS a, covar_samp(l_discount, l_tax) AS b, var_samp(l_tax) AS c FROM lineitem)))"""
PAIR = ["l_discount", "l_tax"]


@R(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(u * l_discount + v * l_tax, 6) AS pc1 FROM lineitem, {FIRST}")
def st_pca_first(spark, sf_dir):
    return rounded(stats.pca_sample(_lines(spark, sf_dir).select(*LINE_KEY, *PAIR), PAIR, 1), 6)


@R(" UNION ALL ".join(f"SELECT 'l_{s}' AS src, 'l_{t}' AS tgt, round(l * {e}, 6) AS value FROM {FIRST}" for s, t, e in (("discount", "discount", "u * u"), ("discount", "tax", "u * v"), ("tax", "discount", "u * v"), ("tax", "tax", "v * v"))))
def st_kcov_first(spark, sf_dir):
    return rounded(stats.k_covariance(_lines(spark, sf_dir), PAIR, 1), 6)


@R()
def st_pca(spark, sf_dir):
    return stats.pca_sample(_lines(spark, sf_dir).select(*LINE_KEY, *MEASURES), MEASURES, 2)


@R("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity, 4) AS l_quantity, round(l_tax, 4) AS l_tax FROM lineitem")
def st_pca_embed_full(spark, sf_dir):
    """All components embedded give the rows back."""
    return rounded(stats.pca_sample(_lines(spark, sf_dir).select(*LINE_KEY, "l_quantity", "l_tax"), ["l_quantity", "l_tax"], 2, embed=True), 4)


@R("""SELECT bin, round(a + bin * w, 4) AS lo, round(a + (bin + 1) * w, 4) AS hi, n FROM (SELECT least(floor((l_extendedprice - a) / w), 99)::BIGINT AS bin, a, w, count(*) AS n
    FROM lineitem, (SELECT min(l_extendedprice) AS a, (max(l_extendedprice) - min(l_extendedprice)) / 1e2 AS w FROM lineitem) GROUP BY ALL)""")
def st_histogram(spark, sf_dir):
    return rounded(stats.histogram(_lines(spark, sf_dir), F.col("l_extendedprice"), 100), 4)


@R(f"SELECT round(max(value), 5) AS max, round(min(value), 5) AS min, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std FROM ({PAIRS_SQL.replace('round({f}', '({f}').replace(', 5) AS value', ') AS value').format(f='corr')}) WHERE src <> tgt")
def st_rel_stats(spark, sf_dir):
    return rounded(stats.relation_statistics(stats.correlation(_lines(spark, sf_dir), MEASURES)), 5)


@R(" UNION ALL ".join(f"SELECT '{c}' AS name, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, round(var_pop({c}), 2) AS var, min({c}) AS lo, max({c}) AS hi FROM lineitem" for c in MEASURES))
def st_moments(spark, sf_dir):
    m = stats.moments(_lines(spark, sf_dir), MEASURES)
    return m.select("name", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.round("var", 2).alias("var"), "lo", "hi")


@R("""SELECT 'l_extendedprice' AS name, p::INT AS point, x FROM (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) - 1 AS r, count(*) OVER () AS n FROM lineitem),
    (SELECT unnest(range(10)) AS p) WHERE r = floor((p + 5e-1) * floor(n / 1e1))""")
def st_representatives(spark, sf_dir):
    return stats.representatives(_lines(spark, sf_dir), ["l_extendedprice"], 10)


@R("""SELECT 'l_extendedprice' AS name, round(avg(x), 4) AS value FROM (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) - 1 AS r, count(*) OVER () AS n FROM lineitem) WHERE r >= floor(75e-2 * n)""")
def st_top_mean(spark, sf_dir):
    return rounded(stats.top_mean(_lines(spark, sf_dir), ["l_extendedprice"], 0.25), 4)


# ---------------------------------------------------------------- arrays and labels


def _by_flag(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy(F.col("l_returnflag").alias("src"), F.col("l_linestatus").alias("tgt")).agg(F.sum("l_quantity").alias("value"))


@R("SELECT l_returnflag AS src, coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 'nan'::DOUBLE) AS \"F\", coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 'nan'::DOUBLE) AS \"O\" FROM lineitem GROUP BY l_returnflag")
def arr_from_pairs(spark, sf_dir):
    return arrays.from_pairs(_by_flag(spark, sf_dir), ["F", "O"])


@R("SELECT l_returnflag AS src, l_linestatus AS tgt, sum(l_quantity) AS value FROM lineitem GROUP BY ALL")
def arr_as_pairs(spark, sf_dir):
    return arrays.as_pairs(arrays.from_pairs(_by_flag(spark, sf_dir), ["F", "O"]), ["F", "O"])


@R("SELECT s.s_suppkey, s.s_name, p.p_brand FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) s JOIN (SELECT *, row_number() OVER (ORDER BY p_partkey) AS r FROM part) p USING (r)")
def arr_add_cols(spark, sf_dir):
    s, p = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return arrays.add_columns(s, p, ["s_suppkey"], ["p_partkey"]).select("s_suppkey", "s_name", "p_brand")


@R("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def set_distinct_in_order(spark, sf_dir):
    return arrays.distinct_in_order(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id")


@R("SELECT n_nationkey AS key, coalesce(s.name, n_name) AS name FROM nation LEFT JOIN (SELECT s_suppkey AS k, max(s_name) AS name FROM supplier GROUP BY s_suppkey) s ON s.k = n_nationkey UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation)")
def set_latest_wins(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return arrays.latest_wins([n, s], "key")


@R("""SELECT c_custkey AS position, label, CASE WHEN target IS NULL THEN NULL WHEN k = 1 THEN target ELSE target || '-' || k END AS converted, target IS NULL AS lost FROM (
    SELECT c_custkey, label, target, row_number() OVER (PARTITION BY target ORDER BY c_custkey) AS k
    FROM (SELECT c_custkey, 'X' || c_nationkey AS label, c_nationkey FROM customer) LEFT JOIN (SELECT n_nationkey, n_name AS target FROM nation WHERE n_regionkey < 3) ON n_nationkey = c_nationkey)""")
def lab_convert(spark, sf_dir):
    given = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("position"), F.concat(F.lit("X"), "c_nationkey").alias("label"))
    lookup = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("string").alias("source"), F.col("n_name").alias("target"))
    return labels.convert(given, lookup)


@R("SELECT p_partkey, '${' || regexp_extract(p_brand, '^(.*?)([0-9]*)$', 1) || '}_{' || regexp_extract(p_brand, '^(.*?)([0-9]*)$', 2) || '}$' AS tex, length(regexp_extract(p_brand, '^(.*?)([0-9]*)$', 1)) + 7e-1 * length(regexp_extract(p_brand, '^(.*?)([0-9]*)$', 2)) AS width FROM part")
def lab_tex(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", labels.tex_label(F.col("p_brand")).alias("tex"), labels.label_width(F.col("p_brand")).alias("width"))


@R("SELECT p_partkey, p_name || '.' || p_brand || '.' || p_size AS full_name FROM part")
def lab_full_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", labels.full_name(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("full_name"))


@R("SELECT (i - 1)::INT AS src, (j - 1)::INT AS tgt, round(covar_samp(embedding[i]::DOUBLE, embedding[j]::DOUBLE), 8) AS value FROM embeddings, range(1, 65) AS a(i), range(1, 65) AS b(j) GROUP BY i, j")
def st_wide_cov(spark, sf_dir):
    """Of all 64 places of the embeddings."""
    return rounded(wide.wide_covariance(table(spark, sf_dir, "embeddings"), vector="embedding"), 8)


@R("SELECT round(sum(v), 8) AS total, round(sum(v * v), 8) AS squares FROM (SELECT covar_samp(embedding[i]::DOUBLE, embedding[j]::DOUBLE) AS v, i, j FROM embeddings, range(1, 65) AS a(i), range(1, 65) AS b(j) GROUP BY i, j) WHERE i = j".replace("round(sum(v * v), 8) AS squares", "round((SELECT sum(v * v) FROM (SELECT covar_samp(embedding[i]::DOUBLE, embedding[j]::DOUBLE) AS v FROM embeddings, range(1, 65) AS a(i), range(1, 65) AS b(j) GROUP BY i, j)), 8) AS squares"))
def st_wide_spectrum(spark, sf_dir):
    """Sums of all eigenvalues and of their squares: the trace and the sum of all squared covariances."""
    rows, d = wide.as_rows(table(spark, sf_dir, "embeddings"), vector="embedding")
    values, _ = wide.leading_components(rows, d, d)
    return rounded(spark.createDataFrame([(float(values.sum()), float((values**2).sum()))], "total double, squares double"), 8)


def queries():
    return dict(R.found)


def oracle_sql():
    return dict(R.sql)


st_corr = R.found["st_corr"]
