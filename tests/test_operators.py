"""Statistics, datasets, arrays, graphs, layouts, systems, relations and training on small inputs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import registry
from lumenframe.operators import arrays, labels, relations, stats, train
from lumenframe.operators import dataset as ds
from lumenframe.operators import network as net
from lumenframe.operators import system as sysm
from lumenframe.operators.dataset import Dataset
from lumenframe.operators.system import System, Units
from lumenframe.operators.train import Schedule
from lumenframe.plans import layout, model
from lumenframe.sources import networks, systems, tables, workspace


def linear(n=100, seed=0):
    """Four normalised inputs and two outputs that are linear in them."""
    x = np.random.default_rng(seed).normal(size=(n, 4))
    y = np.column_stack([x[:, 0] + x[:, 1], x[:, 2] - x[:, 3]])
    z = np.column_stack([x, y])
    return (z - z.mean(axis=0)) / z.std(axis=0)


NAMES = ["i1", "i2", "i3", "i4", "o1", "o2"]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(f"r{k + 1}", *map(float, r)) for k, r in enumerate(linear())]
    return spark.createDataFrame(rows, "label string, " + ", ".join(f"{c} double" for c in NAMES)).cache()


def test_covariance_family(frame):
    x = linear()
    assert np.allclose(stats.to_matrix(stats.covariance(frame, NAMES), NAMES), np.cov(x.T))
    assert np.allclose(stats.to_matrix(stats.correlation(frame, NAMES), NAMES), np.corrcoef(x.T))
    values, p = stats.components(frame, NAMES, 2)
    assert values[0] >= values[1] > 0
    project = p @ p.T
    assert np.allclose(stats.to_matrix(stats.k_covariance(frame, NAMES, 2), NAMES), project @ np.cov(x.T) @ project)
    got = stats.pca_sample(frame, NAMES, 2, embed=True).orderBy(F.expr("int(substring(label, 2))")).select(*NAMES).toPandas().to_numpy()
    assert np.allclose(got, x @ project)
    assert stats.pca_sample(frame, NAMES, 9).columns == ["label", *(f"pc{k}" for k in range(1, 7))]


def test_predicates(frame, spark):
    assert stats.test_gauss(frame, NAMES).first()[0]
    assert not stats.test_binary(frame, NAMES).first()[0]
    assert stats.test_binary(spark.createDataFrame([(0, 1)], "a int, b int"), ["a", "b"]).first()[0]
    assert stats.test_binary(frame.limit(0), NAMES).first()[0]


def test_rank_slices_match_sorting(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.exponential(size=3000), 2)  # many ties
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    s = np.sort(x)
    r, h = int(0.5 * len(s)), int(0.05 * len(s))
    assert stats.rank_quantile(df, ["x"]).first()["threshold"] == pytest.approx(s[r - h : r + h].mean())
    got = [row["x"] for row in stats.representatives(df, ["x"], 10).orderBy("point").collect()]
    assert got == [s[int((k + 0.5) * (len(s) // 10))] for k in range(10)]
    assert stats.top_mean(df, ["x"], 0.25).first()["value"] == pytest.approx(s[int(0.75 * len(s)) :].mean())


def test_histogram_counts_everything(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)] + [(None,)], "x double")
    assert sum(r["n"] for r in stats.histogram(df, F.col("x"), 5).collect()) == 11
    one = stats.histogram(df.where("x = 3"), F.col("x"), 5).collect()
    assert [(r["bin"], r["n"]) for r in one] == [(0, 1)]


def test_columns_and_filters(frame):
    data = Dataset({"t": frame}, {"i:a": "i1", "i:b": "i2", "o:a": "o1", "free": "o2"})
    assert data.get_columns() == ["i:a", "i:b", "o:a", "free"]
    assert data.get_columns("i:*") == ["i:a", "i:b"] and data.get_columns("*:a") == ["i:a", "o:a"] and data.get_columns("o:a") == ["o:a"]
    assert data.get_colnames(["i:b", "free"]) == ["i2", "o2"]
    assert data.column_groups() == {"i": ["a", "b"], "o": ["a"]}
    with pytest.raises(ValueError):
        data.get_columns("nothing")
    with pytest.raises(ValueError):
        data.with_column_filter("x", ["q:*"])
    assert data.rows(columns=["i:a", "i:a"]).columns[2:] == ["i:a", "i:a.2"]
    assert data.rows(["t:r1", "*:r2", "other:*"]).count() == 2
    assert data.value("t:r1", "i:a") == frame.where("label = 'r1'").first()["i1"]
    assert data.value("t:none", "i:a") is None


def test_preparation(frame):
    data = Dataset({"a": frame.where("i1 > 0"), "b": frame.where("i1 <= 0")})
    counts = {t: df.count() for t, df in data.tables.items()}
    assert data.stratify("proportional").fractions == {t: n / 100 for t, n in counts.items()}
    assert data.stratify("equal").fractions == {"a": 0.5, "b": 0.5}
    with pytest.raises(ValueError):
        data.stratify("other")
    assert data.normalize("gauss").evaluate("gauss").first()["ok"]
    assert data.normalize("bernoulli").evaluate("binary").first()["ok"]
    assert data.transform("binary").evaluate("binary").first()["ok"]
    assert data.sample(40, seed=1).count() == 40


@pytest.mark.parametrize("kind", registry.names("noise"))
def test_noise_changes_some_cells(frame, kind):
    noisy = ds.add_noise(frame, ["i1"], kind, 0.3, seed=3)
    both = noisy.select("label", F.col("i1").alias("n")).join(frame.select("label", "i1"), "label")
    assert 5 < both.where("n <> i1").count() <= 100
    assert ds.add_noise(frame, ["i1"], None, 0.3) is frame


def test_rules_draw_afresh(spark):
    made = ds.generate(spark, ["i1", "i10", "o1"], 500, rules=[("o1", "i1 + i10")], normalize=False, seed=2).tables["rules"]
    assert made.where("abs(o1 - i1 - i10) > 1e-9").count() == 0
    assert made.where("i1 = i10").count() == 0


def test_arrays(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0)], "src string, tgt string, value double")
    wide = arrays.from_pairs(pairs, ["a", "b"])
    assert np.isnan(wide.first()["a"]) and wide.first()["b"] == 1.0
    assert [tuple(r) for r in arrays.as_pairs(wide, ["a", "b"]).collect()] == [("a", "b", 1.0)]
    rows = [("this", 1, 1.0, 1j), ("is", 2, 2.0, 2j), ("awesome", 3, 3.0, 3j)]
    t = arrays.from_tuples(spark, rows)
    assert t.columns == ["col0", "col1", "col2", "col3"] and t.count() == 3
    left = spark.range(0, 1000, 1, 7).select("id", (F.col("id") * 7 % 1000).alias("k"))
    both = arrays.add_columns(left, left.select((F.col("k") * 2).alias("d")), ["k"], ["d"])
    assert both.where("d <> 2 * k").count() == 0 and both.count() == 1000
    with pytest.raises(TypeError):
        arrays.require_numeric(t, ["col0"])


def test_labels(spark):
    given = spark.createDataFrame([(1, "X7"), (2, "X8"), (3, "X7"), (4, "X9")], "position int, label string")
    lookup = spark.createDataFrame([("7", "seven"), ("8", "seven")], "source string, target string")
    got = [(r["converted"], r["lost"]) for r in labels.convert(given, lookup).orderBy("position").collect()]
    assert got == [("seven", False), ("seven-2", False), ("seven-3", False), (None, True)]


def test_graph(spark):
    g = net.build(spark, [net.Layer("i", ("1", "2")), net.Layer("o", ("3", "4"))], encapsulate=False)
    assert g.edges.count() == 4
    assert [r["members"] for r in net.group_members(g.nodes, "layer_id", "id", "layer_sub_id").orderBy("layer_id").collect()] == [["1", "2"], ["3", "4"]]
    assert net.group_members(g.nodes, "missing", "id", "node_order").first()["missing"] == ""
    assert net.is_directed(g) and net.is_feedforward(g) and not net.is_multilayer(g)
    with pytest.raises(ValueError):
        g.where(color="red")
    with pytest.raises(ValueError):
        net.build(spark, [net.Layer("a", ("x",)), net.Layer("b", ("y",))], {("a", "b"): [("x", "z")]})
    deep = net.autoencoder(spark, ["v1", "v2", "v3"], (6, 3, 6))
    assert net.is_deep_belief(deep) and net.is_autoencoder(deep)
    assert [r["size"] for r in deep.layers().orderBy("first").collect()] == [3, 6, 3, 6, 3]
    less = net.drop_units(deep, "h1", ["n1"])
    assert less.nodes.where("layer = 'h1'").count() == 5 and less.edges.count() == deep.edges.count() - 6


def test_graph_algorithms(spark):
    g = net.build(spark, [net.Layer("a", ("1", "2")), net.Layer("b", ("3", "4")), net.Layer("c", ("5",))], {("a", "b"): [("1", "3"), ("2", "4")], ("b", "c"): [("3", "5")]}, encapsulate=False)
    components = {r["id"]: r["component"] for r in net.evaluate(g, "connected_components").collect()}
    assert components == {"1": "1", "3": "1", "5": "1", "2": "2", "4": "2"}
    assert {r["id"]: r["depth"] for r in net.evaluate(g, "bfs", source="1").collect()} == {"1": 0, "3": 1, "5": 2}
    assert sum(r["rank"] for r in net.evaluate(g, "pagerank").collect()) == pytest.approx(1)


def test_layout(spark):
    start = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 1, 0), (4, 1, 1)], "id int, layer_id int, layer_sub_id int")
    edges = spark.createDataFrame([(1, 3, 0.1), (1, 4, 0.9), (2, 3, 0.9), (2, 4, 0.1)], "src int, dst int, weight double")
    ordered = layout.order_layers(start, edges)
    assert sorted(tuple(r) for r in ordered.collect()) == [(1, 0, 0), (2, 0, 1), (3, 1, 1), (4, 1, 0)]
    with pytest.raises(ValueError, match="more than 1"):
        layout.order_layers(start, edges, most=1)
    nodes = ordered.withColumnRenamed("place", "layer_sub_id")
    at = lambda df: {r["id"]: (round(r["x"], 6), round(r["y"], 6)) for r in df.collect()}
    right = layout.positions(nodes)
    assert at(right) == {1: (0, 0.25), 2: (0, 0.75), 4: (1, 0.25), 3: (1, 0.75)}
    assert at(layout.positions(nodes, direction="down")) == {1: (0.25, 1), 2: (0.75, 1), 4: (0.25, 0), 3: (0.75, 0)}
    big = layout.rescale(right, 40, 20, (0.2, 0.2, 0.1, 0.1))
    assert at(big) == {1: (4, 2), 2: (4, 16), 4: (32, 2), 3: (32, 16)}
    scale = layout.node_scale(big).first()
    assert int(scale["scale"]) == 9 and int(scale["node_size"]) == 4
    turned = at(layout.rotate(right, 90))
    assert turned[1] == (0.75, 0)


def plain_order(layers, weights):
    """The rule of order_layers on lists."""
    out = [list(layers[0])]
    for layer in layers[1:]:
        before, n = out[-1], len(layer)
        at = lambda k, size: (k + 0.5) / (size + 1)
        cost = np.zeros((n, n))
        for s, u in enumerate(before):
            for t, v in enumerate(layer):
                w = weights.get((u, v), weights.get((v, u), 0.0))
                cost[:, t] += [abs(w) * abs(at(p, n) - at(s, len(before))) for p in range(n)]
        nodes, places, row = list(range(n)), list(range(n)), [None] * n
        while nodes:
            c = cost[places][:, nodes]
            t = nodes[int(np.argmax(c.max(axis=0) ** 2 - c.min(axis=0) ** 2))]
            p = places[int(np.argmin(cost[places, t]))]
            row[p] = layer[t]
            nodes.remove(t)
            places.remove(p)
        out.append(row)
    return out


def test_layer_order_over_several_layers(spark):
    rng = np.random.default_rng(4)
    layers = [[f"a{k}" for k in range(4)], [f"b{k}" for k in range(6)], [f"c{k}" for k in range(3)]]
    weights = {}
    for one, two in zip(layers, layers[1:], strict=False):
        for u in one:
            for v in two:
                if rng.random() < 0.7:
                    weights[(u, v) if rng.random() < 0.8 else (v, u)] = float(rng.normal())
    nodes = spark.createDataFrame([(i, k, j) for k, layer in enumerate(layers) for j, i in enumerate(layer)], "id string, layer_id int, layer_sub_id int")
    edges = spark.createDataFrame([(u, v, w) for (u, v), w in weights.items()], "src string, dst string, weight double")
    got = {r["id"]: (r["layer_id"], r["place"]) for r in layout.order_layers(nodes, edges).collect()}
    assert got == {i: (k, j) for k, layer in enumerate(plain_order(layers, weights)) for j, i in enumerate(layer)}


def fixed():
    return System(
        (Units("i", ("a", "b")), Units("h", ("x",), "sigmoid", False, np.array([0.1])), Units("o", ("d",), bias=np.array([0.2]))),
        (np.array([[0.5], [-0.4]]), np.array([[0.7]])), (np.ones((2, 1)), np.ones((1, 1))),
    )


def test_system_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(50, 2)), rng.normal(size=50)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "`i:a` double, `i:b` double, `o:d` double")
    h = 1 / (1 + np.exp(-(0.1 + (x / np.exp(0.5)) @ np.array([0.5, -0.4]))))
    out = 0.2 + 0.7 * h
    assert sysm.measure(df, fixed(), "error").first()[0] == pytest.approx(((y - out) ** 2).mean())
    assert sysm.measure(df, fixed(), "accuracy").first()[0] == pytest.approx(1 - ((y - out) ** 2).mean() / (y**2).mean())
    assert sysm.measure(df, fixed(), "precision").first()[0] == pytest.approx(1 - (y - out).std() / y.std())
    assert fixed().path("o", "i") == ("o", "h", "i")
    assert fixed().without_units("i", ["a"]).weights[0].shape == (1, 1)
    weights = relations.weight_sum_product(fixed().links_table(spark))
    assert {r["src"]: round(r["value"], 6) for r in weights.collect()} == {"i:a": 0.35, "i:b": -0.28}
    with pytest.raises(ValueError):
        Units("u", ("a",), "other")


def test_knockout_and_coinduction_shapes(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(40, 3))], "`i:a` double, `i:b` double, `o:d` double")
    assert relations.knockout(df, fixed()).count() == 2
    found = relations.coinduction(df, fixed(), points=3)
    assert found.count() == 4 and found.where("value IS NULL OR value < 0").count() == 0


def test_shallow_training_reaches_the_reference_error(spark, frame):
    made = model.create(Dataset({"linear": frame}), net.shallow(spark, NAMES[:4], NAMES[4:]))
    assert made.check()
    fitted = made.optimize(Schedule(updates=100, rounds=2))
    assert fitted.error < 0.1
    assert fitted.network.edges.where("weight <> 0").count() == 8
    assert made.optimize(Schedule(updates=100, rounds=2, algorithm="rprop")).error < 0.1


def test_deep_training_reaches_the_reference_error(spark, frame):
    made = model.create(Dataset({"linear": frame}), net.multilayer(spark, NAMES[:4], NAMES[4:], (4, 4, 4)))
    fitted = made.optimize(Schedule(updates=3000, rounds=3, minibatch=50, options={"pretrain": 1, "bprop_rate": 0.5}))
    assert fitted.error < 0.5


def test_models_survive_storage(spark, frame, tmp_path):
    made = model.create(Dataset({"linear": frame}), net.shallow(spark, NAMES[:4], NAMES[4:]))
    made.save(str(tmp_path / "m"))
    again = model.load(spark, str(tmp_path / "m"))
    assert again.error == pytest.approx(made.error)
    assert np.allclose(train.flatten(again.system), train.flatten(made.system))


def test_delimited_files(spark, frame, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("# name = sample\n# version = 3\n# type = base.Dataset\n\n,i1,i2\nr1,0.5,1\nr2,-1,x\n")
    data = tables.read_dataset(spark, str(path))
    assert data.meta["version"] == 3 and list(data.tables) == ["sample"]
    assert [tuple(r) for r in data.tables["sample"].collect()] == [("r1", 0.5, 1.0), ("r2", -1.0, None)]
    tables.write_bundle(data, str(tmp_path / "b.bundle"))
    assert tables.read_dataset(spark, str(tmp_path / "b.bundle")).tables["sample"].count() == 2
    tables.write_delimited(data, str(tmp_path / "o.tsv"), "\t")
    assert spark.read.option("header", True).option("comment", "#").option("sep", "\t").csv(str(tmp_path / "o.tsv")).columns == ["label", "i1", "i2"]
    with pytest.raises(ValueError):
        tables.filetypes("doc")


@pytest.mark.parametrize("kind", ["gml", "graphml", "dot", "bundle"])
def test_network_files_round_trip(spark, tmp_path, kind):
    g = net.push_weights(*_weighted(spark))
    full = net.Network(_weighted(spark, nodes=True), g, "x")
    networks.write_network(full, str(tmp_path / "n"), kind)
    path = str(tmp_path / "n") if kind == "bundle" else str(next((tmp_path / "n").glob("part-*")))
    again = networks.read_network(spark, path, kind)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(again.nodes) == rows(full.nodes)
    assert rows(again.edges) == rows(full.edges)


def _weighted(spark, nodes=False):
    g = net.build(spark, [net.Layer("i", ("a", "b")), net.Layer("h", ("x",), False, "sigmoid")])
    if nodes:
        return g.nodes
    return g.edges, spark.createDataFrame([("i:a", "h:x", 0.25)], "src string, dst string, weight double")


def test_section_files(spark, tmp_path):
    path = tmp_path / "deep.ini"
    path.write_text("[network]\nname = deep\nlayers = i, h, o\n[layer i]\ntype = gauss\nnodes = i1, i2, i2\n[layer h]\nsize = 3\n[layer o]\nnodes = o1\n[binding h-o]\nn1 = o1\nn3 = o1, gone\n")
    g = networks.read_network(spark, str(path))
    assert [r["size"] for r in g.layers().orderBy("first").collect()] == [2, 3, 1]
    assert g.edges.where("layer_id = 0").count() == 6 and g.edges.where("layer_id = 1").count() == 2
    conf = tmp_path / "ann.ini"
    conf.write_text("[system]\nname = a\ntype = ann.ANN\n[schedule default]\nsystem ann.ANN = {'updates': 100, 'minibatch_size': 100}\n")
    assert systems.read_system_config(spark, str(conf))["schedules"]["default"]["ann.ANN"]["updates"] == 100


def test_workspace(spark, tmp_path):
    (tmp_path / "datasets").mkdir()
    (tmp_path / "datasets" / "one.csv").write_text(",a\nr,1\n")
    (tmp_path / "datasets" / "two.default.csv").write_text(",a\nr,2\n")
    (tmp_path / "datasets" / "no.xyz").write_text("-")
    (tmp_path / "workspace.ini").write_text("[workspace]\nmaintainer = me\n[folders]\ndatasets = d\n")
    listing = workspace.catalog(spark, str(tmp_path))
    assert sorted(r["name"] for r in listing.collect()) == ["one", "two"]
    assert workspace.find(listing, "dataset", "two").endswith("two.default.csv")
    assert workspace.register_views(spark, listing) == ["one", "two"]
    assert spark.sql("SELECT a FROM two").first()[0] == 2.0
    assert workspace.read_workspace_config(spark, str(tmp_path / "workspace.ini"))["workspace"]["maintainer"] == "me"


def test_deep_graphs_are_walked_to_their_end(spark):
    n = 150
    nodes = spark.createDataFrame([(str(1000 + k),) for k in range(n)] + [("alone",)], "id string")
    edges = spark.createDataFrame([(str(1000 + k), str(1001 + k)) for k in range(n - 1)], "src string, dst string")
    found = {r["id"]: r["component"] for r in net.connected_components(nodes, edges).collect()}
    assert found == {str(1000 + k): "1000" for k in range(n)} | {"alone": "alone"}
    depths = {r["id"]: r["depth"] for r in net.bfs(nodes, edges.where("src >= '1110'"), "1110").collect()}
    assert depths == {str(1110 + k): k for k in range(40)}


@pytest.mark.parametrize("kind", ["gml", "graphml", "dot"])
def test_odd_ids_in_graph_files(spark, tmp_path, kind):
    names = ["a&b", "x<y", 'say "q"', "list[0]", "plain"]
    nodes = spark.createDataFrame([(i, i, "l", 0, k, k, True, "t") for k, i in enumerate(names)], networks.NODES)
    edges = spark.createDataFrame([(names[k], names[k + 1], "l", "l", 0, k, 0.5) for k in range(4)], networks.EDGES)
    networks.write_network(net.Network(nodes, edges, "odd [one]"), str(tmp_path / "n"), kind)
    back = networks.read_network(spark, str(tmp_path / "n"), kind)
    assert [r["id"] for r in back.nodes.orderBy("node_order").collect()] == names
    assert [(r["src"], r["dst"]) for r in back.edges.orderBy("edge_order").collect()] == [(names[k], names[k + 1]) for k in range(4)]


def test_long_headers(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("".join(f"# k{k} = v{k}\n" for k in range(300)) + "# name = far\n,a\nr1,1.5\n")
    assert tables.read_metadata(spark, str(path))["name"] == "far"
    only = tmp_path / "only.csv"
    only.write_text("# name = x\n")
    assert tables.read_metadata(spark, str(only)) == {"name": "x"}


def test_graph_algorithms_on_odd_graphs(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    links = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("a", "b")]
    edges = spark.createDataFrame(links, "src string, dst string")
    assert {r["id"]: r["triangles"] for r in net.triangles(nodes, edges).collect()} == {"a": 1, "b": 1, "c": 1, "d": 0, "e": 0, "f": 0}
    assert not net.is_dag(nodes, edges).first()["ok"]
    assert net.is_dag(nodes, edges.limit(0)).first()["ok"]
    ladder = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("e", "e")], "src string, dst string")
    found = {r["id"]: r["generation"] for r in net.topological_generations(nodes, ladder).collect()}
    assert found == {"a": 0, "b": 1, "c": 2, "d": 3, "e": None, "f": 0}
    assert [r["id"] for r in net.shortest_path(nodes, ladder, "a", "d").orderBy("step").collect()] == ["a", "c", "d"]
    assert net.shortest_path(nodes, ladder, "d", "a").isEmpty()


def test_paths_need_neighbours(spark):
    from lumenframe.queries.models import SYSTEM

    assert np.array_equal(SYSTEM.link("h", "i"), SYSTEM.link("i", "h").T)
    with pytest.raises(ValueError):
        SYSTEM.link("i", "o")
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "`i:a` double, `i:b` double, `i:c` double")
    twice = sysm.forward(df, SYSTEM, path=("i", "h", "i", "h"), prefix="~").first()
    again = sysm.forward(sysm.forward(df, SYSTEM, path=("i", "h", "i"), prefix="").select("i:a", "i:b", "i:c"), SYSTEM, target="h", prefix="~").first()
    assert twice["~h:x"] == pytest.approx(again["~h:x"])


def test_metadata_comes_back(spark, tmp_path):
    made = Dataset({"t": spark.createDataFrame([("r", 1.5)], "label string, a double")}, meta={"about": "x = y"})
    tables.write_dataset(made, str(tmp_path / "t.csv"))
    assert tables.read_dataset(spark, str(tmp_path / "t.csv")).meta == {"name": "t", "about": "x = y"}
    with pytest.raises(ValueError):
        tables.write_dataset(made, str(tmp_path / "t.xyz"))


# ---------------------------------------------------------------- schedules and steps


def test_schedules_of_system_files(spark, tmp_path):
    from lumenframe.operators.train import Schedule
    from lumenframe.sources.systems import read_system_config

    path = tmp_path / "deep.ini"
    path.write_text(
        "[system]\ntype = rbm.RBM\n\n[schedule default]\nsystem rbm.RBM:\n  algorithm = 'cd',\n  updates = 40,\n  update_rate = .2,\n"
        "  update_factor_vbias = .5,\n  minibatch_size = 30,\n  minibatch_update_interval = 4,\n  gen_module = '',\nsystem ann.ANN: {'updates': 7}\n"
    )
    found = read_system_config(spark, str(path))["schedules"]["default"]
    made = Schedule.from_settings(found["rbm.RBM"], rounds=2)
    assert (made.algorithm, made.updates, made.rate, made.minibatch, made.interval, made.rounds, made.objective) == ("contrastive", 40, 0.2, 30, 4, 2, None)
    assert made.options == {"vbias_factor": 0.5}
    assert Schedule.from_settings(found["ann.ANN"]).updates == 7


def test_contrastive_factors_and_heat():
    from lumenframe.operators.train import Contrastive, Schedule, rbm

    x = np.random.default_rng(0).integers(0, 2, (50, 3)).astype(float)
    start = rbm(["visible:a", "visible:b", "visible:c"], 2, "sigmoid")

    def step(**options):
        return Contrastive(Schedule(options=options, updates=10), np.random.default_rng(1)).step(start, x, x[:, :0])

    def moves(made):
        return made.layers[0].bias - start.layers[0].bias, made.layers[1].bias - start.layers[1].bias, made.weights[0] - start.weights[0]

    plain, half, still, hot = moves(step()), moves(step(vbias_factor=0.5)), moves(step(weights_factor=0.0, hbias_factor=0.0)), moves(step(temperature=1.0))
    assert np.allclose(half[0], plain[0] / 2) and np.allclose(half[1], plain[1]) and np.allclose(half[2], plain[2])
    assert np.allclose(still[0], plain[0]) and not still[1].any() and not still[2].any()
    for k in range(3):
        assert not np.allclose(hot[k], plain[k])


def test_history_interval_and_stop(spark):
    from lumenframe.operators import train
    from lumenframe.operators.system import System, Units

    system = System((Units("i", ("a",), "gauss", True, np.zeros(1), np.zeros(1)), Units("o", ("b",), "gauss", True, np.zeros(1), np.zeros(1))), (np.zeros((1, 1)),), (np.ones((1, 1)),))
    rows = spark.createDataFrame([(k / 50, k / 25) for k in range(50)], "`i:a` double, `o:b` double").coalesce(1)
    seen, history = [], []
    train.fit(rows, system, train.Schedule(updates=30, rounds=6, minibatch=5, interval=3), watch=lambda turn, s: seen.append(turn) or turn == 2, history=history)
    assert seen == [0, 1, 2] and [u for u, _ in history] == [5, 10, 15] and history[-1][1] < history[0][1]
    once = {r["parameter"]: r["value"] for r in train.rprop_step(rows, system).collect()}
    moved = train.fit(rows, system, train.Schedule(updates=1, rounds=1, minibatch=50, algorithm="rprop", keep_best=False))
    assert np.isclose(once["bias o:b"], moved.layers[1].bias[0]) and np.isclose(once["weight i:a o:b"], moved.weights[0][0, 0])


# ---------------------------------------------------------------- selection, draws, formats and filters


@pytest.mark.parametrize("case", ["spread", "ties", "odd", "few"])
def test_selected_ranks(spark, monkeypatch, case):
    monkeypatch.setattr(stats, "FEW", 20)
    monkeypatch.setattr(stats, "BUCKETS", 7)
    rng = np.random.default_rng(3)
    x = {
        "spread": rng.normal(size=900) * 10.0 ** rng.integers(-200, 200, 900), "ties": rng.integers(0, 4, 900).astype(float),
        "odd": np.concatenate([rng.normal(size=300), [np.inf] * 20, [-np.inf] * 30, [np.nan] * 40, [1.7e308, -1.7e308]]), "few": np.array([2.0]),
    }[case]
    df = spark.createDataFrame([(float(v), 1.0) for v in x] + [(None, 1.0)], "x double, y double").repartition(3)
    order = np.sort(x)
    n, got = stats.select_ranks(df, ["x", "y"], lambda n: [0, n // 3, n // 2, n - 1])["x"]
    assert n == len(x) and [r.rank for r in got] == sorted({0, n // 3, n // 2, n - 1})
    for r in got:
        same = np.isnan(order) if np.isnan(order[r.rank]) else order == order[r.rank]
        assert np.array_equal([r.value], [order[r.rank]], equal_nan=True) and (r.first, r.held) == (np.flatnonzero(same)[0], same.sum())
    assert stats.top_mean(df.limit(0), ["x"], 0.5).count() == 0


def test_keyed_draws(spark):
    from lumenframe.functions.draws import draws

    df = spark.range(20000).select("id", draws(3, ["id"]).uniform().alias("u"), draws(3, ["id"]).uniform(1).alias("v"), draws(4, ["id"]).normal().alias("g"))
    one, two = df.repartition(7).orderBy("id").toPandas(), df.orderBy("id").toPandas()
    assert one.equals(two) and 0 < one.u.min() and one.u.max() < 1
    assert abs(one.u.mean() - 0.5) < 0.01 and abs(one.u.std() - 12**-0.5) < 0.01 and abs(one.g.mean()) < 0.03 and abs(one.g.std() - 1) < 0.02
    assert abs(one.corr().loc["u", "v"]) < 0.03 and abs(one.corr().loc["u", "g"]) < 0.03


def test_output_formats(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "label string, x double, y double")
    data = Dataset({"t": df}, {"g:x": "x", "h:x": "x", "g:y": "y"})
    cols, rows, array = data.read(("cols", "rows", "array"), columns=["g:x", "h:x", "g:y"])
    assert cols == ["x", "x.2", "y"] and sorted(r["row"] for r in rows.collect()) == ["t:a", "t:b"]
    assert sorted(r["values"] for r in array.collect()) == [[1.0, 1.0, 2.0], [3.0, 3.0, 4.0]]
    assert data.read("recarray", columns="g:*").columns == ["label", "x", "y"]
    noisy = data.read("array", noise=("mask", 1.0), seed=1).collect()
    assert all(v == 0 for r in noisy for v in r["values"])
    assert data.read("array", size=9, seed=2).count() == 9
    for bad in ({"columns": ["g:x", "g:x"]}, {"columns": ["no"]}, {"output": "matrix"}):
        with pytest.raises(ValueError):
            data.read(**({"output": "array"} | bad))


def test_units_links_and_layers(spark):
    s = fixed()
    assert [tuple(r) for r in s.units(spark, groupby="layer").orderBy("group").collect()] == [("h", ["h:x"]), ("i", ["i:a", "i:b"]), ("o", ["o:d"])]
    assert s.units(spark, visible=True).count() == 3 and s.unit(spark, "b").first()["layer"] == "i"
    for bad in ("nothing", "i:x"):
        with pytest.raises(ValueError, match="0 units"):
            s.unit(spark, bad)
    with pytest.raises(ValueError, match="unknown attribute"):
        s.units(spark, colour=1)
    assert [tuple(r) for r in s.links(spark, groupby="sign").orderBy("group").collect()] == [(-1.0, ["i:b>h:x"]), (1.0, ["i:a>h:x", "h:x>o:d"])]
    assert s.links(spark, dst="o:d").first()["weight"] == 0.7
    assert [r["layer"] for r in s.layer_names(spark, visible=True, nothing=3).orderBy("layer_id").collect()] == ["i", "o"]


def test_configuration_of_networks(spark):
    g = net.build(spark, [net.Layer("i", ("a", "b")), net.Layer("h", ("x", "y"), False, "sigmoid"), net.Layer("o", ("d",))])
    g = net.Network(g.nodes, net.push_weights(g.edges, spark.createDataFrame([("i:b", "h:x", 0.5)], "src string, dst string, weight double")))
    made = net.configure(g, {"i": ["b", "c", "e"], "o": ["d"], "none": ["q"]})
    assert [(r["id"], r["layer_sub_id"], r["node_order"]) for r in made.nodes.orderBy("node_order").collect()] == [("i:b", 0, 0), ("i:c", 1, 1), ("i:e", 2, 2), ("h:x", 0, 3), ("h:y", 1, 4), ("o:d", 0, 5)]
    edges = {(r["src"], r["dst"]): r["weight"] for r in made.edges.collect()}
    assert set(edges) == {(f"i:{a}", f"h:{b}") for a in "bce" for b in "xy"} | {("h:x", "o:d"), ("h:y", "o:d")} and edges["i:b", "h:x"] == 0.5
    data = Dataset({"t": spark.createDataFrame([("r", 1.0, 2.0)], "label string, a double, b double")}).configure({"i": ["b", "zz"]})
    assert data.meta == {"lost": [], "missing": ["i:zz"]} and data.columns == {"i:b": "b"}
