"""Wide statistics, exact epochs, cursors, and files that give back what was written."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import epochs, wide
from lumenframe.operators import network as net
from lumenframe.operators.cursor import Cursor, parse_mode
from lumenframe.operators.dataset import Dataset
from lumenframe.operators.system import System, Units
from lumenframe.operators.train import Schedule
from lumenframe.sources import networks, tables


def vectors(spark, x, odd=()):
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)] + [(-1 - k, v) for k, v in enumerate(odd)]
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(3)


def test_wide_covariance_of_many_columns(spark, monkeypatch):
    x = np.random.default_rng(0).normal(size=(300, 700)) * 3 + 1e4
    rows, d = wide.as_rows(vectors(spark, x, [None, [float("nan")] * 700, [float("inf")] * 700]), vector="v")
    got, n = wide.covariance_matrix(rows, d)
    assert (d, n) == (700, 300) and np.allclose(got, np.cov(x.T), atol=1e-8)


def test_wide_covariance_by_column_names(spark):
    x = np.random.default_rng(1).normal(size=(40, 3))
    df = spark.createDataFrame(x.tolist(), "a double, `b.c` double, d double").union(spark.createDataFrame([(1.0, None, 2.0)], "a double, b double, d double"))
    got = {(r["src"], r["tgt"]): r["value"] for r in wide.wide_covariance(df, ["a", "b.c", "d"]).collect()}
    assert np.allclose([[got[i, j] for j in range(3)] for i in range(3)], np.cov(x.T))
    assert np.isnan(wide.wide_covariance(df.limit(0), ["a", "b.c", "d"]).first()["value"])


def test_leading_components(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6)) @ (rng.normal(size=(6, 60)) * np.array([9, 7, 5, 3, 2, 1])[:, None]) + rng.normal(size=(400, 60)) * 0.05
    df = vectors(spark, x, [None, [1.0]])
    rows, d = wide.as_rows(df, vector="v")
    values, axes = wide.leading_components(rows, d, 4)
    want, turn = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(values, want[::-1][:4], rtol=1e-8)
    assert np.allclose(np.abs((axes * turn[:, ::-1][:, :4]).sum(axis=0)), 1, atol=1e-8)
    got = {r["id"]: r["pc"] for r in wide.wide_pca(df, 4, "v").collect()}
    assert got[-1] is None and got[-2] is None
    assert np.allclose([got[k] for k in range(400)], (x - x.mean(axis=0)) @ axes, atol=1e-8)


# ---------------------------------------------------------------- epochs


def shallow():
    return System((Units("i", ("a",), "gauss", True, np.zeros(1), np.zeros(1)), Units("o", ("b",), "gauss", True, np.zeros(1), np.zeros(1))), (np.zeros((1, 1)),), (np.ones((1, 1)),))


def test_epochs_use_each_row_once(spark):
    x = np.arange(200.0)
    rows = spark.createDataFrame([(float(v), float(2 * v)) for v in x] + [(None, 1.0), (float("nan"), 1.0)], "`i:a` double, `o:b` double").repartition(5)
    # minibatches of one row with a step of rate 1 and no link: the bias adds up what it has seen
    still = shallow()
    still = System(still.layers, still.weights, (np.zeros((1, 1)),))
    seen = epochs.fit_epochs(rows, still, Schedule(minibatch=1, rate=1e-9), 1, tasks=1)
    assert seen.layers[1].bias[0] == pytest.approx(1e-9 * 2 * x.sum(), rel=1e-6)
    full = epochs.fit_epochs(rows, shallow(), Schedule(minibatch=10**9, rate=1e-5), 3, tasks=4)
    w = b = 0.0
    for _ in range(3):
        e = b + w * x - 2 * x
        b, w = b - 1e-5 * e.mean(), w - 1e-5 * (x * e).mean()
    assert (full.layers[1].bias[0], full.weights[0][0, 0]) == pytest.approx((b, w))


def test_epochs_go_on_where_they_stopped(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(float(v), float(3 * v + 1)) for v in rng.normal(size=300)], "`i:a` double, `o:b` double").repartition(2)
    plan = Schedule(minibatch=10, rate=0.1)
    whole = epochs.fit_epochs(rows, shallow(), plan, 6, tasks=2)
    folder = str(tmp_path / "state")
    epochs.fit_epochs(rows, shallow(), plan, 6, tasks=2, folder=folder, watch=lambda epoch, s: epoch == 2)
    turns = []
    again = epochs.fit_epochs(rows, shallow(), plan, 6, tasks=2, folder=folder, watch=lambda epoch, s: turns.append(epoch))
    assert turns == [3, 4, 5, 6] and again.weights[0][0, 0] == whole.weights[0][0, 0]
    assert abs(again.weights[0][0, 0] - 3) < 0.05 and abs(again.layers[1].bias[0] - 1) < 0.05
    assert epochs.fit_epochs(rows.limit(0), shallow(), plan, 2).weights[0][0, 0] == 0


# ---------------------------------------------------------------- cursors


def test_cursor_modes():
    assert parse_mode("") == ("forward-only", "dynamic") and parse_mode("random static") == ("random", "static")
    for mode in ("sideways", "scrollable dynamic", "random"):
        with pytest.raises(ValueError):
            parse_mode(mode)


def keys(df):
    return [r["k"] for r in df.collect()]


def test_cursors_see_what_their_mode_says(spark, tmp_path):
    path = str(tmp_path / "t")

    def put(rows):
        spark.createDataFrame(rows, "k int, v int").write.mode("overwrite").parquet(path)

    def table():
        spark.catalog.refreshByPath(path)
        return spark.read.parquet(path)

    put([(k, k) for k in range(10)])
    dynamic, indexed, static = (Cursor(table, ["k"], m) for m in ("forward-only dynamic", "scrollable indexed", "scrollable static"))
    assert [keys(c.fetch(3)) for c in (dynamic, indexed, static)] == [[0, 1, 2]] * 3
    put([(k, 10 * k) for k in range(12) if k != 4])
    assert keys(dynamic.fetch(3)) == [3, 5, 6]
    assert [(r["k"], r["v"]) for r in indexed.fetch(3).collect()] == [(3, 30), (5, 50)]
    assert [(r["k"], r["v"]) for r in static.fetch(3).collect()] == [(3, 3), (4, 4), (5, 5)]
    assert keys(dynamic.fetch(20)) == [7, 8, 9, 10, 11] and keys(dynamic.fetch(5)) == []
    assert keys(indexed.scroll_to(8).fetch(20)) == [8, 9] and keys(static.scroll_by(-4).fetch(2)) == [2, 3]
    assert static.count() == 10
    saved = static.position()
    assert keys(Cursor(table, ["k"], "scrollable static", position=saved).fetch(2)) == [5, 6]
    with pytest.raises(ValueError):
        indexed.count()
    with pytest.raises(ValueError):
        dynamic.scroll_to(0)
    static.close()


def test_cursors_with_several_keys_and_draws(spark):
    rows = [(a, b) for a in ("x", "y", "z") for b in range(4)]
    df = spark.createDataFrame(rows, "a string, k int").repartition(3)
    cursor, seen = Cursor(df, ["a", "k"], where=F.col("k") > 0), []
    while page := cursor.fetch(4).orderBy("a", "k").collect():
        cursor = Cursor(df, ["a", "k"], where=F.col("k") > 0, position=cursor.position())
        seen += [tuple(r) for r in page]
    assert seen == [r for r in rows if r[1] > 0]
    draw = Cursor(df, ["a", "k"], "random static", seed=1)
    first, second = draw.fetch(30).collect(), draw.fetch(30).collect()
    assert len(first) == len(second) == 30 and first != second
    assert first == Cursor(df, ["a", "k"], "random static", seed=1).fetch(30).collect()
    with pytest.raises(ValueError):
        draw.fetch(0)
    assert Cursor(df.limit(0), ["a", "k"], "random indexed").fetch(3).count() == 0
    order = Cursor(df, ["a", "k"], "static", order=["k"]).fetch(4).collect()
    assert [tuple(r) for r in order] == [("x", 0), ("y", 0), ("z", 0), ("x", 1)]


# ---------------------------------------------------------------- files


@pytest.mark.parametrize("kind", ["csv", "tsv", "tab"])
def test_labels_and_metadata_come_back(spark, tmp_path, kind):
    labels = [None, "", " ", "  a\t", 'say "x"', '"', "a,b;c", "line\nend", "\r\n", "\\", "\\n", "\\N", "#x", "# name = y", "\\\\n\\", "ü日本"]
    rows = [(v, float(k), None if k % 3 else k + 0.5) for k, v in enumerate(labels)] + [("inf", float("inf"), float("nan"))]
    made = Dataset({"t": spark.createDataFrame(rows, 'label string, a double, `odd, "name"` double').repartition(3)}, meta={"about": "x = y", "version": 4})
    path = str(tmp_path / f"t.{kind}")
    tables.write_dataset(made, path)
    back = tables.read_dataset(spark, path)
    assert back.meta == {"name": "t", "about": "x = y", "version": 4}
    assert back.tables["t"].columns == ["label", "a", 'odd, "name"']
    assert sorted(map(repr, back.tables["t"].collect())) == sorted(map(repr, made.tables["t"].collect()))
    part = next((tmp_path / f"t.{kind}").glob("part-*"))
    assert part.read_text().startswith("# name = t\n")
    tables.write_dataset(Dataset({"t": made.tables["t"].limit(0)}), path)
    empty = tables.read_dataset(spark, path)
    assert empty.tables["t"].count() == 0 and empty.tables["t"].columns == back.tables["t"].columns


def test_graph_files_of_other_programs(spark, tmp_path):
    gml = tmp_path / "g.gml"
    gml.write_text('graph [\n  name "two"\n  directed 1\n  node [ id 7 label "a &amp; b" layer "x" ]\n  node [ id 8 ]\n  edge [ source 7 target 8 weight 1.5 ]\n]\n')
    g = networks.read_network(spark, str(gml))
    assert g.name == "two" and [(r["id"], r["layer"], r["node_order"]) for r in g.nodes.orderBy("node_order").collect()] == [("a & b", "x", 0), ("8", None, 1)]
    assert [(r["src"], r["dst"], r["weight"], r["edge_order"]) for r in g.edges.collect()] == [("a & b", "8", 1.5, 0)]
    gml.write_text('graph [ node [ id 1 label "a]b" ] ]')
    with pytest.raises(ValueError, match="bracket"):
        networks.read_network(spark, str(gml))
    dot = tmp_path / "g.dot"
    dot.write_text('digraph "d" {\n  "a" [layer="x"];\n  "b";\n  "a" -> "b" [weight="2"];\n}\n')
    g = networks.read_network(spark, str(dot))
    xml = tmp_path / "g.graphml"
    xml.write_text('<graphml><graph id="q"><node id="a"><data key="layer">x &lt; y</data></node><node id="b"/>\n<node id="c" /><edge target="b" source="a"><data key="weight">2</data></edge><edge source="b" target="c"/></graph></graphml>')
    h = networks.read_network(spark, str(xml))
    assert [(r["id"], r["layer"], r["node_order"]) for r in h.nodes.orderBy("node_order").collect()] == [("a", "x < y", 0), ("b", None, 1), ("c", None, 2)]
    assert [(r["src"], r["dst"], r["weight"]) for r in h.edges.orderBy("edge_order").collect()] == [("a", "b", 2.0), ("b", "c", 0.0)]
    assert g.name == "d" and {r["id"]: r["layer"] for r in g.nodes.collect()} == {"a": "x", "b": None} and g.edges.first()["weight"] == 2.0


def test_large_networks_are_written_in_parts(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        nodes = spark.range(500).select(F.format_string("n%d", "id").alias("id"), F.lit("l").alias("label"), F.lit("x").alias("layer"), F.lit(0).alias("layer_id"), F.col("id").cast("int").alias("layer_sub_id"), F.col("id").cast("int").alias("node_order"), F.lit(True).alias("visible"), F.lit("t").alias("type"))
        edges = nodes.select(F.col("id").alias("src"), F.lit("n0").alias("dst"), F.lit("x").alias("src_layer"), F.lit("x").alias("dst_layer"), F.lit(0).alias("layer_id"), F.col("node_order").alias("edge_order"), F.lit(0.5).alias("weight"))
        for kind in ("gml", "dot", "graphml"):
            networks.write_network(net.Network(nodes, edges, "big"), str(tmp_path / f"g.{kind}"))
            assert len(list((tmp_path / f"g.{kind}").glob("part-*"))) > 1
            back = networks.read_network(spark, str(tmp_path / f"g.{kind}"))
            assert back.nodes.count() == back.edges.count() == 500 and (kind == "graphml" or back.name == "big")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_graphml_rows_stay_small_and_elements_go_on_in_the_next_split(spark, tmp_path):
    nodes = "".join(f'<node id="n{k}"><data key="layer">x{k}</data></node>' for k in range(3000))
    edges = "".join(f'<edge source="n{k}" target="n0"><data key="weight">{k}</data></edge>' if k % 2 else f'<edge source="n{k}" target="n>0"/>' for k in range(3000))
    path = tmp_path / "g.graphml"
    path.write_text(f'<graphml><graph id="q">{nodes}<node id="big"><data key="layer">{"y" * 9000}</data></node>{edges}</graph></graphml>')
    seen = []
    plain = networks.materialize

    def stored(df, name):
        out = plain(df, name)
        seen.extend([out.agg(F.max(F.length("e"))).first()[0]] if name == "graphml" else [])
        return out

    networks.materialize = stored
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4001")
    try:
        g = networks.read_network(spark, str(path))
        assert [(r["id"], r["layer"]) for r in g.nodes.orderBy("node_order").collect()] == [*((f"n{k}", f"x{k}") for k in range(3000)), ("big", "y" * 9000)]
        assert [(r["src"], r["dst"], r["weight"]) for r in g.edges.orderBy("edge_order").collect()] == [(f"n{k}", "n0", float(k)) if k % 2 else (f"n{k}", "n>0", 0.0) for k in range(3000)]
    finally:
        networks.materialize = plain
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # with a closing tag as the end of a row, all nodes were one row where edges were read
    assert seen and seen[0] < 10000
