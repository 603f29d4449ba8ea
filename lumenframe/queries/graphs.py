"""The layered graph region -> nation -> customer -> orders, and graph algorithms on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import network as net
from lumenframe.operators.network import Network
from lumenframe.plans import layout
from lumenframe.queries.common import Registry, rounded, table

R = Registry()
#: Layers: name, table, key, key of the layer before, type.
LAYERS = [
    ("region", "region", "r_regionkey", None, "gauss"),
    ("nation", "nation", "n_nationkey", "n_regionkey", "sigmoid"),
    ("customer", "customer", "c_custkey", "c_nationkey", "sigmoid"),
    ("orders", "orders", "o_orderkey", "o_custkey", "gauss"),
]


def _graph(spark, sf_dir) -> Network:
    nodes = edges = None
    for k, (layer, name, key, up, kind) in enumerate(LAYERS):
        t = table(spark, sf_dir, name)
        node = F.concat(F.lit(f"{layer}:"), F.col(key).cast("string"))
        n = t.select(
            node.alias("id"), F.col(key).cast("string").alias("label"), F.lit(layer).alias("layer"), F.lit(k).alias("layer_id"), F.col(key).cast("int").alias("layer_sub_id"),
            (F.lit(k * 10_000_000) + F.col(key)).cast("int").alias("node_order"), F.lit(k in (0, len(LAYERS) - 1)).alias("visible"), F.lit(kind).alias("type"),
        )
        nodes = n if nodes is None else nodes.unionByName(n)
        if up:
            e = t.select(
                F.concat(F.lit(f"{LAYERS[k - 1][0]}:"), F.col(up).cast("string")).alias("src"), node.alias("dst"), F.lit(LAYERS[k - 1][0]).alias("src_layer"), F.lit(layer).alias("dst_layer"),
                F.lit(k - 1).alias("layer_id"), F.col(key).cast("int").alias("edge_order"), F.lit(1.0).alias("weight"),
            )
            edges = e if edges is None else edges.unionByName(e)
    return Network(nodes, edges, "sales")


NODES = """(SELECT 'region:' || r_regionkey AS id, 'region' AS layer, 0 AS layer_id, 0 * 10000000 + r_regionkey AS node_order FROM region
    UNION ALL SELECT 'nation:' || n_nationkey, 'nation', 1, 10000000 + n_nationkey FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'customer', 2, 20000000 + c_custkey FROM customer
    UNION ALL SELECT 'orders:' || o_orderkey, 'orders', 3, 30000000 + o_orderkey FROM orders)"""
EDGES = """(SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 0 AS layer_id FROM nation
    UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 1 FROM customer
    UNION ALL SELECT 'customer:' || o_custkey, 'orders:' || o_orderkey, 2 FROM orders)"""


@R(f"SELECT id, node_order::INT AS node_order FROM {NODES} WHERE layer = 'customer'")
def net_nodes(spark, sf_dir):
    return _graph(spark, sf_dir).where(layer="customer").select("id", "node_order")


@R(f"SELECT layer_id, count(*) AS n, count(DISTINCT src) AS sources FROM {EDGES} GROUP BY layer_id")
def net_edges_by_layer(spark, sf_dir):
    return _graph(spark, sf_dir).edges.groupBy("layer_id").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"))


@R(f"SELECT src, dst FROM {EDGES} WHERE layer_id = 1")
def net_edges(spark, sf_dir):
    return net.select_edges(_graph(spark, sf_dir).edges, src_layer="nation").select("src", "dst")


@R(f"SELECT layer, min(node_order)::INT AS first, count(*) AS size FROM {NODES} GROUP BY layer")
def net_layers(spark, sf_dir):
    return _graph(spark, sf_dir).layers()


@R(f"SELECT type, string_agg(layer, ',' ORDER BY layer_id) AS layers FROM (SELECT DISTINCT layer, layer_id, CASE WHEN layer IN ('region', 'orders') THEN 'gauss' ELSE 'sigmoid' END AS type FROM {NODES}) GROUP BY type")
def net_groups(spark, sf_dir):
    heads = _graph(spark, sf_dir).nodes.groupBy("type", "layer").agg(F.min("layer_id").alias("layer_id"))
    return net.group_members(heads, "type", "layer", "layer_id").select("type", F.array_join("members", ",").alias("layers"))


@R(f"SELECT coalesce(bool_and(layer IS NOT NULL AND layer_id IS NOT NULL AND node_order IS NOT NULL), false) AS ok FROM {NODES}")
def net_is_layered(spark, sf_dir):
    return net.is_layered(_graph(spark, sf_dir).nodes)


@R(f"""WITH s AS (SELECT layer_id, count(*) AS n, bool_and(layer IN ('region', 'orders')) AS v FROM {NODES} GROUP BY layer_id), k AS (SELECT count(*) AS k FROM s)
    SELECT bool_and(CASE WHEN layer_id IN (0, k - 1) THEN v END) AS directed, bool_and(n > 0 AND v = (layer_id IN (0, k - 1))) AS feedforward, bool_and(n > 0 AND v = (layer_id IN (0, k - 1))) AND min(k) >= 3 AS multilayer,
    min(k) % 2 = 1 AS deep_belief, false AS autoencoder FROM s, k""")
def net_predicates(spark, sf_dir):
    """Of the graph of sales, which has four layers."""
    g = _graph(spark, sf_dir)
    return spark.createDataFrame(
        [(net.is_directed(g), net.is_feedforward(g), net.is_multilayer(g), net.is_deep_belief(g), net.is_autoencoder(g))], "directed boolean, feedforward boolean, multilayer boolean, deep_belief boolean, autoencoder boolean"
    )


@R("SELECT 'region:' || r_regionkey AS src, 'nation:' || n_nationkey AS dst FROM region CROSS JOIN nation")
def net_full_binding(spark, sf_dir):
    return net.full_binding(_graph(spark, sf_dir).nodes.where("layer_id < 2")).select("src", "dst")


@R("""SELECT 'region:' || r_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation JOIN region ON r_regionkey = n_regionkey + 2
    UNION ALL SELECT 'customer:' || c_custkey, 'orders:' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey + 1""")
def net_valid_edges(spark, sf_dir):
    """Pairs of labels, some of which name no node."""
    n = table(spark, sf_dir, "nation").select(F.lit(0).alias("layer_id"), (F.col("n_regionkey") + 2).cast("string").alias("src_label"), F.col("n_nationkey").cast("string").alias("dst_label"))
    o = table(spark, sf_dir, "orders").select(F.lit(2).alias("layer_id"), (F.col("o_custkey") + 1).cast("string").alias("src_label"), F.col("o_orderkey").cast("string").alias("dst_label"))
    return net.valid_edges(n.unionByName(o), _graph(spark, sf_dir).nodes).select("src", "dst")


@R("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def net_lost_nodes(spark, sf_dir):
    """Customers that no order leads from."""
    g = _graph(spark, sf_dir)
    return g.where(layer="customer").join(g.edges.select(F.col("src").alias("id")), "id", "left_anti").select("id")


DEGREE = f"(SELECT id, coalesce(i, 0)::BIGINT AS in_degree, coalesce(o, 0)::BIGINT AS out_degree FROM {NODES} LEFT JOIN (SELECT dst AS id, count(*) AS i FROM {EDGES} GROUP BY dst) USING (id) LEFT JOIN (SELECT src AS id, count(*) AS o FROM {EDGES} GROUP BY src) USING (id))"


@R(f"SELECT id, in_degree, out_degree, in_degree + out_degree AS degree FROM {DEGREE}")
def net_degree(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return net.evaluate(g, "degree")


@R(f"SELECT id, round(in_degree / (n - 1), 8) AS in_degree, round(out_degree / (n - 1), 8) AS out_degree, round((in_degree + out_degree) / (n - 1), 8) AS degree FROM {DEGREE}, (SELECT count(*) AS n FROM {NODES})")
def net_degree_centrality(spark, sf_dir):
    return rounded(net.evaluate(_graph(spark, sf_dir), "degree_centrality"), 8)


@R(f"SELECT round(m / (n * (n - 1e0)), 12) AS density FROM (SELECT count(*) AS n FROM {NODES}), (SELECT count(*) AS m FROM {EDGES})")
def net_density(spark, sf_dir):
    return rounded(net.evaluate(_graph(spark, sf_dir), "density"), 12)


@R(f"SELECT avg(CASE WHEN b.src IS NULL THEN 0e0 ELSE 1e0 END) AS reciprocity FROM (SELECT DISTINCT src, dst FROM {EDGES}) a LEFT JOIN (SELECT DISTINCT src, dst FROM {EDGES}) b ON a.src = b.dst AND a.dst = b.src")
def net_reciprocity(spark, sf_dir):
    return net.evaluate(_graph(spark, sf_dir), "reciprocity")


RANK = f"""WITH RECURSIVE n AS (SELECT count(*)::DOUBLE AS n FROM {NODES}), o AS (SELECT src, count(*)::DOUBLE AS m FROM {EDGES} GROUP BY src),
    r0 AS (SELECT id, 1e0 / n AS rank FROM {NODES}, n)"""
for _k in range(1, 4):
    RANK += f""", l{_k} AS (SELECT coalesce(sum(rank), 0e0) AS loose FROM r{_k - 1} WHERE id NOT IN (SELECT src FROM o)),
    g{_k} AS (SELECT dst AS id, sum(rank / m) AS got FROM {EDGES} e JOIN o USING (src) JOIN r{_k - 1} r ON r.id = e.src GROUP BY dst),
    r{_k} AS (SELECT id, 15e-2 / n + 85e-2 * (coalesce(got, 0e0) + loose / n) AS rank FROM {NODES} LEFT JOIN g{_k} USING (id), l{_k}, n)"""


@R(f"{RANK} SELECT id, round(rank, 9) AS rank FROM r3")
def net_pagerank(spark, sf_dir):
    """Three rounds."""
    return rounded(net.evaluate(_graph(spark, sf_dir), "pagerank", rounds=3), 9)


@R(f"""SELECT id, min(component) OVER (PARTITION BY reg) AS component FROM (SELECT id, id AS component, reg FROM (
    SELECT 'region:' || r_regionkey AS id, r_regionkey AS reg FROM region UNION ALL SELECT 'nation:' || n_nationkey, n_regionkey FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'orders:' || o_orderkey, n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey))""")
def net_components(spark, sf_dir):
    return net.evaluate(_graph(spark, sf_dir), "connected_components")


@R("""SELECT 'region:0' AS id, 0 AS depth UNION ALL SELECT 'nation:' || n_nationkey, 1 FROM nation WHERE n_regionkey = 0
    UNION ALL SELECT 'customer:' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0
    UNION ALL SELECT 'orders:' || o_orderkey, 3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0""")
def net_bfs(spark, sf_dir):
    return net.evaluate(_graph(spark, sf_dir), "bfs", source="region:0")


@R("SELECT 'nation:' || c_nationkey AS src, 'customer:' || c_custkey AS dst, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 1e0 END AS weight FROM customer")
def net_push_weights(spark, sf_dir):
    g = _graph(spark, sf_dir)
    new = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.concat(F.lit("nation:"), "c_nationkey").alias("src"), F.concat(F.lit("customer:"), "c_custkey").alias("dst"), F.col("c_acctbal").alias("weight"))
    return net.push_weights(net.select_edges(g.edges, src_layer="nation"), new).select("src", "dst", "weight")


@R(f"SELECT id, round(layer_id / 3e0, 6) AS x, round((row_number() OVER (PARTITION BY layer_id ORDER BY node_order) - 5e-1) / count(*) OVER (PARTITION BY layer_id), 6) AS y FROM {NODES}")
def net_layout(spark, sf_dir):
    """All nodes of all layers."""
    return rounded(layout.positions(_graph(spark, sf_dir).nodes))


@R("""WITH n AS (SELECT count(*)::DOUBLE AS n FROM nation), m AS (SELECT count(*)::DOUBLE AS m FROM region)
    SELECT 'nation:' || n_nationkey AS id, p::BIGINT AS place, round(coalesce(w, 0e0) * abs((p + 5e-1) / (n + 1) - (n_regionkey + 5e-1) / (m + 1)), 6) AS cost
    FROM nation LEFT JOIN (SELECT c_nationkey, abs(sum(c_acctbal)) / 1e4 AS w FROM customer GROUP BY ALL) ON c_nationkey = n_nationkey, n, m, range(25) AS r(p)""")
def net_layer_costs(spark, sf_dir):
    """Costs of the places of nations under their regions, by the balances of their customers."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    nations = n.select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.lit(1).alias("layer_id"), F.col("n_nationkey").cast("long").alias("sub"))
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("id"), F.lit(0).alias("layer_id"), F.col("r_regionkey").cast("long").alias("sub"))
    weights = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg((F.sum("c_acctbal") / 1e4).alias("weight"))
    edges = n.join(weights, "n_nationkey", "left").select(F.concat(F.lit("region:"), "n_regionkey").alias("src"), F.concat(F.lit("nation:"), "n_nationkey").alias("dst"), "weight")
    return rounded(layout.layer_costs(regions.unionByName(nations), edges, 1).select("id", F.col("place").cast("long").alias("place"), "cost"))


#: Nations, with an edge from each customer's nation to the nations of the suppliers in its orders, if 1 line in 600 leads there.
TRADE = """(SELECT src, dst FROM (SELECT c_nationkey::VARCHAR AS src, s_nationkey::VARCHAR AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) WHERE n * 600 > (SELECT count(*) FROM lineitem))"""


def _trade(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("src"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("string").alias("dst"))
    edges = lines.join(o, "l_orderkey").join(c, "c_custkey").join(s, "l_suppkey").groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = lines.agg(F.count("*").alias("total"))
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"))
    return nodes, edges.join(F.broadcast(total), how="cross").where("n * 600 > total").select("src", "dst")


@R(f"""WITH p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {TRADE} WHERE src <> dst),
    t AS (SELECT x.a, x.b, y.b AS c FROM p x JOIN p y ON x.b = y.a JOIN p z ON z.a = x.a AND z.b = y.b)
    SELECT n_nationkey::VARCHAR AS id, (SELECT count(*) FROM t WHERE n_nationkey::VARCHAR IN (a, b, c)) AS triangles FROM nation""")
def net_triangles(spark, sf_dir):
    return net.triangles(*_trade(spark, sf_dir))


@R(f"SELECT count(*) = 0 AS ok FROM {TRADE} a JOIN {TRADE} b ON a.src = b.dst AND a.dst = b.src")
def net_is_dag(spark, sf_dir):
    """Trade runs both ways between some nations, or within one."""
    return net.is_dag(*_trade(spark, sf_dir))


@R(f"SELECT id, layer_id::INT AS generation FROM {NODES}")
def net_generations(spark, sf_dir):
    return net.evaluate(_graph(spark, sf_dir), "topological_generations")


@R("""WITH o AS (SELECT o_orderkey, o_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0 ORDER BY o_orderkey LIMIT 1)
    SELECT 0 AS step, 'region:0' AS id FROM o UNION ALL SELECT 1, 'nation:' || c_nationkey FROM o UNION ALL SELECT 2, 'customer:' || o_custkey FROM o UNION ALL SELECT 3, 'orders:' || o_orderkey FROM o""")
def net_shortest_path(spark, sf_dir):
    """From a region to its first order."""
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    first = o.join(c, o.o_custkey == c.c_custkey).join(n.where("n_regionkey = 0"), c.c_nationkey == n.n_nationkey).agg(F.min("o_orderkey")).first()[0]
    return net.evaluate(_graph(spark, sf_dir), "shortest_path", source="region:0", target=f"orders:{first}")


L = "1e0 / (1e0 + exp(-1e1 * ({})))"
SOFT = f"tanh(abs(w) * ({L.format('w - 5e-1')} + {L.format('w + 5e-1')} - 1e0) / abs({L.format('5e-1')} + {L.format('15e-1')} - 1e0)) / tanh(1e0)"


@R(f"""WITH e AS (SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, (n_nationkey - 12) / 1e1 AS g FROM nation
    UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, -c_acctbal / 1e3 FROM customer),
    k AS (SELECT *, g / (SELECT abs(avg(g)) FROM e) AS w FROM e WHERE abs(g) >= 5e-1), s AS (SELECT *, {SOFT} AS v FROM k)
    SELECT src, dst, round(v * (SELECT CASE WHEN sum(sign(v)) < 0 THEN -1e0 ELSE 1e0 END FROM s), 6) AS weight, g > 0 AS positive FROM s""")
def net_graph_data(spark, sf_dir):
    """Three layers whose links are mostly negative, so that all signs turn."""
    g = _graph(spark, sf_dir)
    own = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("dst"), (-F.col("c_acctbal") / 1e3).alias("w"))
    home = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("dst"), ((F.col("n_nationkey") - 12) / 10.0).alias("w"))
    edges = g.edges.where("dst_layer <> 'orders'").select("src", "dst").join(own.unionByName(home), "dst").withColumnRenamed("w", "weight")
    return rounded(net.graph_data(g.nodes.where("layer <> 'orders'"), edges, threshold=0.5, normalize=True))


@R("""WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT NULL, NULL), e AS (SELECT 'region:' || r AS src, 'nation:' || k AS dst FROM n WHERE k IS NOT NULL
    UNION ALL SELECT 'region:' || r_regionkey, 'nation:new' FROM region UNION ALL SELECT 'nation:new', 'customer:' || c_custkey FROM customer UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer WHERE c_nationkey % 2 = 0)
    SELECT src, count(*) AS n, min(dst) AS first FROM e GROUP BY src""")
def net_configure(spark, sf_dir):
    """Regions, nations and customers, of which the nations become those of even keys and a new one."""
    g = _graph(spark, sf_dir)
    few = Network(g.nodes.where("layer_id < 3"), g.edges.where("layer_id < 2"), "sales")
    names = [str(r[0]) for r in table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select("n_nationkey").collect()]
    made = net.configure(few, {"nation": [*names, "new"], "no such layer": ["x"]})
    return made.edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("first"))


@R(f"SELECT id, CASE layer WHEN 'region' THEN 'source' WHEN 'orders' THEN 'target' ELSE 'latent' END AS \"group\" FROM {NODES}")
def net_node_groups(spark, sf_dir):
    return net.node_groups(_graph(spark, sf_dir))


def queries():
    return dict(R.found)


def oracle_sql():
    return dict(R.sql)
