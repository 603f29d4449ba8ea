"""Tables and networks written to the shared folder in each format and read back."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from lumenframe.operators.cursor import Cursor
from lumenframe.operators.dataset import Dataset
from lumenframe.operators.network import Network
from lumenframe.queries.common import Registry, table
from lumenframe.queries.graphs import _graph
from lumenframe.session import ensure_checkpoint_dir
from lumenframe.sources import networks, tables

R = Registry()


def _folder(spark) -> str:
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    return f"{sc.getCheckpointDir() or sc.getConf().get('spark.checkpoint.dir')}/store-{uuid.uuid4().hex}"


def _customers(spark, sf_dir) -> Dataset:
    """Customers with labels that files tend to lose: quotes, separators, line ends, outer blanks, backslashes, none."""
    key, name = F.col("c_custkey"), F.col("c_name")
    odd = [
        name, F.concat(F.lit("  "), name, F.lit(" \t")), F.concat(name, F.lit("\nsecond, line\r\n")), F.concat(F.lit('say "'), name, F.lit('"')), F.concat(F.lit("# "), name, F.lit(";\t")),
        F.concat(F.lit("C:\\new\\"), name, F.lit("\\")), F.lit(""), F.lit(None).cast("string"), F.lit("\\N"),
    ]
    label = F.element_at(F.array(*odd), (key % len(odd) + 1).cast("int"))
    c = table(spark, sf_dir, "customer").select(label.alias("label"), key.cast("double").alias("key"), F.when(key % 7 > 0, F.col("c_acctbal")).alias("balance"))
    return Dataset({"customer": c}, meta={"about": "balances = money"})


CUSTOMERS = r"""SELECT CASE c_custkey % 9 WHEN 0 THEN c_name WHEN 1 THEN '  ' || c_name || ' ' || chr(9) WHEN 2 THEN c_name || chr(10) || 'second, line' || chr(13) || chr(10) WHEN 3 THEN 'say "' || c_name || '"'
    WHEN 4 THEN '# ' || c_name || ';' || chr(9) WHEN 5 THEN 'C:\new\' || c_name || '\' WHEN 6 THEN '' WHEN 7 THEN NULL ELSE '\N' END AS label, c_custkey::DOUBLE AS key,
    CASE WHEN c_custkey % 7 > 0 THEN c_acctbal END AS balance, 'balances = money' AS about FROM customer"""


def _round_trip(kind: str):
    def query(spark, sf_dir):
        path = f"{_folder(spark)}/customer.{kind}"
        tables.write_dataset(_customers(spark, sf_dir), path)
        back = tables.read_dataset(spark, path)
        return back.tables["customer"].select("*", F.lit(back.meta["about"]).alias("about"))

    return query


for _k in ("csv", "tsv", "tab", "bundle"):
    R.add(f"io_{_k}", _round_trip(_k), CUSTOMERS)


def _odd_sales(spark, sf_dir) -> Network:
    """Sales whose customers have ids that graph files tend to lose."""
    g = _graph(spark, sf_dir)
    odd = lambda c: F.concat(F.col(c), F.when(F.col(c).startswith("customer:"), F.element_at(F.array(*map(F.lit, ODD)), (F.substring_index(c, ":", -1).cast("int") % len(ODD) + 1))).otherwise(""))
    return replace(g, nodes=g.nodes.withColumn("id", odd("id")), edges=g.edges.withColumn("src", odd("src")).withColumn("dst", odd("dst")).withColumn("weight", F.col("edge_order") % 7 + 0.5))


ODD = ["", ' "q"', " [x]", " <&> &amp;", "\nline", " node [", " ->"]
SUFFIX = "CASE {k} % 7 WHEN 0 THEN '' WHEN 1 THEN ' \"q\"' WHEN 2 THEN ' [x]' WHEN 3 THEN ' <&> &amp;' WHEN 4 THEN chr(10) || 'line' WHEN 5 THEN ' node [' ELSE ' ->' END"
C_NODE, C_ORDER = SUFFIX.format(k="c_custkey"), SUFFIX.format(k="o_custkey")
ODD_SALES = f"""SELECT 'node' AS part, 'region:' || r_regionkey AS a, 'region' AS b, r_regionkey::DOUBLE AS x FROM region UNION ALL SELECT 'node', 'nation:' || n_nationkey, 'nation', 10000000 + n_nationkey FROM nation
    UNION ALL SELECT 'node', 'customer:' || c_custkey || {C_NODE}, 'customer', 20000000 + c_custkey FROM customer UNION ALL SELECT 'node', 'orders:' || o_orderkey, 'orders', 30000000 + o_orderkey FROM orders
    UNION ALL SELECT 'edge', 'region:' || n_regionkey, 'nation:' || n_nationkey, n_nationkey % 7 + 0.5 FROM nation UNION ALL SELECT 'edge', 'nation:' || c_nationkey, 'customer:' || c_custkey || {C_NODE}, c_custkey % 7 + 0.5 FROM customer
    UNION ALL SELECT 'edge', 'customer:' || o_custkey || {C_ORDER}, 'orders:' || o_orderkey, o_orderkey % 7 + 0.5 FROM orders"""


def _network(kind: str):
    def query(spark, sf_dir):
        path = f"{_folder(spark)}/sales.{kind}"
        networks.write_network(_odd_sales(spark, sf_dir), path)
        back = networks.read_network(spark, path)
        ends = F.array(F.struct(F.lit("node").alias("part"), F.col("id").alias("a"), F.col("layer").alias("b"), F.col("node_order").cast("double").alias("x")))
        links = F.array(F.struct(F.lit("edge").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("x")))
        return back.nodes.select(F.inline(ends)).unionByName(back.edges.select(F.inline(links)))

    return query


R.add("io_network_bundle", _network("bundle"), ODD_SALES)
for _k in ("gml", "graphml", "dot"):
    R.add(f"io_{_k}", _network(_k), ODD_SALES)


@R("SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey LIMIT 40 OFFSET 60")
def cur_scrolled(spark, sf_dir):
    """The fourth page of twenty rows and the one before it, of customers by nation and falling balance."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", (-F.col("c_acctbal")).alias("debt"))
    cursor = Cursor(c, ["c_custkey"], "scrollable static", order=["c_nationkey", "debt"])
    fourth = cursor.scroll_to(80).fetch(20)
    return fourth.unionByName(cursor.scroll_by(-40).fetch(20)).drop("debt")


@R("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 2 = 0 ORDER BY o_custkey, o_orderkey LIMIT 50 OFFSET 100")
def cur_forward(spark, sf_dir):
    """The third page of fifty orders of even customers, from the position after the second."""
    def orders():
        return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")

    cursor = Cursor(orders, ["o_custkey", "o_orderkey"], where=F.col("o_custkey") % 2 == 0)
    cursor.fetch(50)
    cursor.fetch(50)
    return Cursor(orders, ["o_custkey", "o_orderkey"], where=F.col("o_custkey") % 2 == 0, position=cursor.position()).fetch(50)


@R("""WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT i // 1000 AS page, min(i) AS first, count(*) AS rows FROM r GROUP BY i // 1000""")
def cur_pages(spark, sf_dir):
    """Pages of a thousand keys."""
    return Cursor(table(spark, sf_dir, "orders"), ["o_orderkey"], "scrollable indexed").pages(1000)


def queries():
    return dict(R.found)


def oracle_sql():
    return dict(R.sql)
