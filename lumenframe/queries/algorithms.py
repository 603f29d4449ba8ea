"""Algorithms on the graph of trade between nations, and on the stars of nations and their customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import graphs
from lumenframe.queries.common import Registry, rounded, table

R = Registry()
NATIONS = "(SELECT n_nationkey::VARCHAR AS id FROM nation)"


def trade_sql(lines: int) -> str:
    """From each customer's nation to those of the suppliers in its orders, if more than 1 line in so many leads there; weight: lines in all for one of these."""
    return f"""(SELECT src, dst, n, (total // n)::DOUBLE AS w FROM (SELECT c_nationkey::VARCHAR AS src, s_nationkey::VARCHAR AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), (SELECT count(*) AS total FROM lineitem) WHERE n * {lines} > total)"""


def trade(spark, sf_dir, lines: int):
    """(id) and (src, dst, n, weight) of the same."""
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("src"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("string").alias("dst"))
    edges = item.join(o, "l_orderkey").join(c, "c_custkey").join(s, "l_suppkey").groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = item.agg(F.count("*").alias("total"))
    edges = edges.join(F.broadcast(total), how="cross").where(F.col("n") * lines > F.col("total"))
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"))
    return nodes, edges.select("src", "dst", "n", F.expr("cast(total div n as double)").alias("weight"))


def with_edges(lines: int, more: str, recursive: bool = False) -> str:
    """e: directed edges without loops, p: both directions of each."""
    return f"""WITH {"RECURSIVE " if recursive else ""}v AS MATERIALIZED {NATIONS}, e AS MATERIALIZED (SELECT src, dst, n, w FROM {trade_sql(lines)} WHERE src <> dst),
        p AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e), {more}"""


@R(with_edges(420, """r AS (SELECT id AS a, id AS b FROM v UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src)
    SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a""", True))  # fmt: skip
def net_strong_components(spark, sf_dir):
    return graphs.strongly_connected_components(*trade(spark, sf_dir, 420))


#: All distances by doubling: ways of at most 1, 2, 4, 8, 16 and 32 edges.
WAYS = ", ".join(
    ["d0 AS MATERIALIZED (SELECT a, b, min(d) AS d FROM (SELECT id AS a, id AS b, 0e0 AS d FROM v UNION ALL SELECT src, dst, {} FROM e) GROUP BY a, b)"]
    + [f"d{k} AS MATERIALIZED (SELECT x.a, y.b, min(x.d + y.d) AS d FROM d{k - 1} x JOIN d{k - 1} y ON x.b = y.a GROUP BY x.a, y.b)" for k in range(1, 6)]
)


@R(with_edges(500, WAYS.format("w") + """ SELECT b AS id, d AS distance, (SELECT min(src) FROM e JOIN d5 f ON f.a = '0' AND f.b = src WHERE dst = d5.b AND f.d + w = d5.d AND d5.b <> '0') AS via FROM d5 WHERE a = '0'"""))
def net_shortest_distances(spark, sf_dir):
    nodes, edges = trade(spark, sf_dir, 500)
    return graphs.shortest_distances(nodes, edges, "0", delta=480.0)


#: Numbers of shortest ways, level by level.
SHORTEST = WAYS.format("1e0") + ", s0 AS (SELECT id AS a, id AS b, 1e0 AS ways FROM v)" + "".join(
    f", s{k} AS MATERIALIZED (SELECT s.a, e.dst AS b, sum(ways) AS ways FROM s{k - 1} s JOIN e ON e.src = s.b JOIN d5 ON d5.a = s.a AND d5.b = e.dst AND d5.d = {k} GROUP BY s.a, e.dst)" for k in range(1, 9)
) + ", s AS MATERIALIZED (SELECT d5.a, d5.b, d, ways FROM d5 JOIN (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(9)) + ") t ON d5.a = t.a AND d5.b = t.b)"


@R(with_edges(560, SHORTEST + """, n AS (SELECT count(*)::DOUBLE AS n FROM v), x AS (SELECT l.b AS id, sum(l.ways * r.ways / w.ways) AS b FROM s l JOIN s r ON l.b = r.a JOIN s w ON w.a = l.a AND w.b = r.b AND w.d = l.d + r.d
    WHERE l.a <> l.b AND r.a <> r.b AND l.a <> r.b GROUP BY l.b) SELECT v.id, round(coalesce(b, 0e0) / ((n - 1) * (n - 2)), 8) AS betweenness FROM v LEFT JOIN x USING (id), n"""))
def net_betweenness(spark, sf_dir):
    """In two batches of sources."""
    return rounded(graphs.betweenness(*trade(spark, sf_dir, 560), batch=13), 8)


@R(with_edges(480, WAYS.format("1e0") + """, n AS (SELECT count(*)::DOUBLE AS n FROM v) SELECT b AS id, count(*) AS reached, sum(d) AS distance_sum, round(sum(CASE WHEN d > 0 THEN 1e0 / d ELSE 0e0 END), 8) AS harmonic,
    round(CASE WHEN sum(d) > 0 THEN (count(*) - 1) ** 2e0 / sum(d) / (min(n) - 1) ELSE 0e0 END, 8) AS closeness FROM d5, n GROUP BY b"""))
def net_neighbourhoods(spark, sf_dir):
    """Sketches of so few nodes count exactly."""
    return rounded(graphs.neighbourhoods(*trade(spark, sf_dir, 480)), 8)


#: Twenty rounds of neighbour values, more than 25 nodes take.
CORES = "h0 AS (SELECT id, (SELECT count(*) FROM p WHERE src = id) AS h FROM v)" + "".join(
    f""", h{k} AS MATERIALIZED (SELECT id, coalesce(max(least(h, c)), 0) AS h FROM v LEFT JOIN (SELECT src, h, row_number() OVER (PARTITION BY src ORDER BY h DESC) AS c FROM p JOIN h{k - 1} ON h{k - 1}.id = dst) ON src = id GROUP BY id)""" for k in range(1, 21)
)


@R(with_edges(500, CORES + " SELECT id, h::BIGINT AS core FROM h20"))
def net_core_numbers(spark, sf_dir):
    return graphs.core_numbers(*trade(spark, sf_dir, 500))


@R(with_edges(620, """q AS MATERIALIZED (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(w) AS w FROM e GROUP BY ALL), k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY w, a, b) AS i FROM q),
    r AS (SELECT i, a AS x FROM k UNION SELECT r.i, CASE WHEN k.a = r.x THEN k.b ELSE k.a END FROM r JOIN k ON k.i < r.i AND r.x IN (k.a, k.b))
    SELECT a, b, w AS weight FROM k WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.i = k.i AND r.x = k.b)""", True))  # fmt: skip
def net_spanning_forest(spark, sf_dir):
    """An edge is in the forest unless earlier edges already join its ends."""
    nodes, edges = trade(spark, sf_dir, 620)
    return graphs.minimum_spanning_forest(nodes, edges)


@R(f"""WITH q AS (SELECT t.n::DOUBLE AS n, a.n_regionkey AS x, b.n_regionkey AS y FROM {trade_sql(700)} t JOIN nation a ON a.n_nationkey = t.src::INT JOIN nation b ON b.n_nationkey = t.dst::INT),
    k AS (SELECT c, sum(n) AS k FROM (SELECT x AS c, n FROM q UNION ALL SELECT y, n FROM q) GROUP BY c), m AS (SELECT sum(n) AS m FROM q)
    SELECT round((SELECT sum(n) FROM q WHERE x = y) / m - (SELECT sum(k * k) FROM k) / (4 * m * m), 10) AS modularity FROM m""")
def net_modularity(spark, sf_dir):
    """Of the regions, with the lines between nations as weights."""
    nodes, edges = trade(spark, sf_dir, 700)
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_regionkey").alias("community"))
    return rounded(graphs.modularity(nodes, edges, regions, "n"), 10)


STARS = "(SELECT 'nation:' || c_nationkey AS src, 'customer:' || c_custkey AS dst FROM customer)"


@R(f"SELECT id, min(id) OVER (PARTITION BY src) AS community FROM (SELECT src, dst AS id FROM {STARS} UNION SELECT src, src FROM {STARS})")
def net_communities(spark, sf_dir):
    """Nations with their customers: each star is a community."""
    edges = table(spark, sf_dir, "customer").select(F.concat(F.lit("nation:"), "c_nationkey").alias("src"), F.concat(F.lit("customer:"), "c_custkey").alias("dst"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return graphs.communities(nodes, edges)


#: The same choices one after the other, in the order of the hashes.
ORDERED = "o AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY md5(id), id) AS k FROM v), b AS MATERIALIZED (SELECT o.id, o.k, (SELECT coalesce(list(dst), []) FROM p WHERE src = o.id) AS near, (SELECT coalesce(list(x.k), []) FROM p JOIN o x ON x.id = p.dst WHERE p.src = o.id AND x.k < o.k) AS before FROM o)"


@R(with_edges(600, ORDERED + """, g AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS chosen UNION ALL SELECT b.k, CASE WHEN list_has_any(chosen, near) THEN chosen ELSE list_append(chosen, id) END FROM g JOIN b ON b.k = g.k + 1)
    SELECT id, list_contains((SELECT chosen FROM g ORDER BY k DESC LIMIT 1), id) AS chosen FROM v""", True))  # fmt: skip
def net_independent_set(spark, sf_dir):
    return graphs.independent_set(*trade(spark, sf_dir, 600))


@R(with_edges(600, ORDERED + """, g AS (SELECT 0::BIGINT AS k, []::INT[] AS colours UNION ALL SELECT b.k, list_append(colours, list_min(list_filter(range(0, 40), lambda c: NOT list_contains(list_transform(before, lambda i: colours[i]), c)))::INT) FROM g JOIN b ON b.k = g.k + 1)
    SELECT id, (SELECT colours FROM g ORDER BY k DESC LIMIT 1)[o.k] AS colour FROM o""", True))  # fmt: skip
def net_colouring(spark, sf_dir):
    return graphs.colouring(*trade(spark, sf_dir, 600))


@R(with_edges(600, """q AS MATERIALIZED (SELECT src AS a, dst AS b, row_number() OVER (ORDER BY md5(src || '|' || dst), src, dst) AS k FROM p WHERE src < dst),
    g AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS ends UNION ALL SELECT q.k, CASE WHEN list_has_any(ends, [a, b]) THEN ends ELSE list_concat(ends, [a, b]) END FROM g JOIN q ON q.k = g.k + 1),
    l AS (SELECT ends FROM g ORDER BY k DESC LIMIT 1) SELECT ends[i] AS a, ends[i + 1] AS b FROM l, range(1, 60, 2) AS r(i) WHERE i < len(ends)""", True))  # fmt: skip
def net_matching(spark, sf_dir):
    return graphs.matching(*trade(spark, sf_dir, 600))


def queries():
    return dict(R.found)


def oracle_sql():
    return dict(R.sql)
