"""Layered directed graphs as a pair of DataFrames.

nodes: id, label, layer, layer_id, layer_sub_id, node_order, visible, type. edges: src, dst, src_layer, dst_layer,
layer_id, edge_order, weight. Edges lead from one layer to the next.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.registry import register
from lumenframe.operators.arrays import number_rows
from lumenframe.storage import discard, materialize

NODES = "id string, label string, layer string, layer_id int, layer_sub_id int, node_order int, visible boolean, type string"


@dataclass(frozen=True)
class Layer:
    name: str
    nodes: tuple[str, ...]
    visible: bool = True
    type: str = "gauss"


@dataclass(frozen=True)
class Network:
    nodes: DataFrame
    edges: DataFrame
    name: str = "network"
    directed: bool | None = None
    meta: dict[str, object] = field(default_factory=dict)

    def where(self, **values: object) -> DataFrame:
        return select_nodes(self.nodes, **values)

    def layers(self) -> DataFrame:
        return layers(self.nodes)


# ---------------------------------------------------------------- building


def build(spark: SparkSession, spec: Sequence[Layer], bindings: dict[tuple[str, str], Sequence[tuple[str, str]]] | None = None, encapsulate: bool = True, name: str = "network") -> Network:
    """A network from its layers. A pair of neighbouring layers without a binding is bound in full.

    Node ids are `layer:label` unless encapsulate is false. Bindings name labels; pairs with an unknown node are dropped.
    A pair of neighbouring layers that ends up without an edge is an error.
    """
    rows, order = [], 0
    for k, layer in enumerate(spec):
        for j, label in enumerate(dict.fromkeys(layer.nodes)):
            rows.append((f"{layer.name}:{label}" if encapsulate else label, label, layer.name, k, j, order, layer.visible, layer.type))
            order += 1
    nodes = spark.createDataFrame(rows, NODES)
    given = [(k, a, b) for k, (s, d) in enumerate(zip(spec, spec[1:], strict=False)) for a, b in (bindings or {}).get((s.name, d.name), ())]
    bound = {k for k, (s, d) in enumerate(zip(spec, spec[1:], strict=False)) if (s.name, d.name) in (bindings or {})}
    pairs = full_binding(nodes).where(~F.col("layer_id").isin(sorted(bound))) if bound else full_binding(nodes)
    if bound:
        pairs = pairs.unionByName(valid_edges(spark.createDataFrame(given, "layer_id int, src_label string, dst_label string"), nodes))
        found = {r[0] for r in pairs.select("layer_id").distinct().collect()}
        if missing := [f"{spec[k].name}-{spec[k + 1].name}" for k in range(len(spec) - 1) if k not in found]:
            raise ValueError(f"layers are not connected: {', '.join(missing)}")
    return Network(nodes, number_edges(pairs), name)


def full_binding(nodes: DataFrame) -> DataFrame:
    """Every pair of nodes of neighbouring layers: a join on the layer's number."""
    a = nodes.select(F.col("id").alias("src"), F.col("layer").alias("src_layer"), "layer_id", F.col("node_order").alias("a"))
    b = nodes.select(F.col("id").alias("dst"), F.col("layer").alias("dst_layer"), (F.col("layer_id") - 1).alias("layer_id"), F.col("node_order").alias("b"))
    return a.join(b, "layer_id").select("src", "dst", "src_layer", "dst_layer", "layer_id", F.struct("a", "b").alias("place"))


def valid_edges(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(layer_id, src_label, dst_label) resolved to nodes of that layer and the next; others are dropped."""
    a = nodes.select(F.col("id").alias("src"), F.col("label").alias("src_label"), F.col("layer").alias("src_layer"), "layer_id", F.col("node_order").alias("a"))
    b = nodes.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"), F.col("layer").alias("dst_layer"), (F.col("layer_id") - 1).alias("layer_id"), F.col("node_order").alias("b"))
    return pairs.join(a, ["layer_id", "src_label"]).join(b, ["layer_id", "dst_label"]).select("src", "dst", "src_layer", "dst_layer", "layer_id", F.struct("a", "b").alias("place"))


def number_edges(pairs: DataFrame) -> DataFrame:
    """Edges with their order by the places of their ends, and weight 0."""
    flat = pairs.select("src", "dst", "src_layer", "dst_layer", "layer_id", F.col("place.a").alias("a"), F.col("place.b").alias("b"))
    numbered = number_rows(flat, ["layer_id", "a", "b"], "edge_order")
    return numbered.select("src", "dst", "src_layer", "dst_layer", "layer_id", F.col("edge_order").cast("int").alias("edge_order"), F.lit(0.0).alias("weight"))


@register("network_builder", "multilayer")
def multilayer(spark: SparkSession, inputs: Sequence[str] = ("i1", "i2", "i3", "i4"), outputs: Sequence[str] = ("o1", "o2"), shape: Sequence[int] = (4, 2, 4), visible_type: str = "gauss", hidden_type: str = "sigmoid") -> Network:
    hidden = [Layer(f"h{k + 1}", tuple(f"n{j + 1}" for j in range(n)), False, hidden_type) for k, n in enumerate(shape)]
    return build(spark, [Layer("i", tuple(inputs), True, visible_type), *hidden, Layer("o", tuple(outputs), True, visible_type)], name="multilayer")


@register("network_builder", "autoencoder")
def autoencoder(spark: SparkSession, columns: Sequence[str], shape: Sequence[int] | None = None, **kwargs: str) -> Network:
    d = len(columns)
    return replace(multilayer(spark, columns, columns, tuple(shape or (2 * d, d, 2 * d)), **kwargs), name="autoencoder")


@register("network_builder", "factor")
def factor(spark: SparkSession, visible: Sequence[str] = ("v1", "v2", "v3", "v4"), hidden: Sequence[str] | int = 2, visible_type: str = "gauss", hidden_type: str = "sigmoid") -> Network:
    names = tuple(f"n{k + 1}" for k in range(hidden)) if isinstance(hidden, int) else tuple(hidden)
    return build(spark, [Layer("visible", tuple(visible), True, visible_type), Layer("hidden", names, False, hidden_type)], encapsulate=False, name="factor")


@register("network_builder", "shallow")
def shallow(spark: SparkSession, inputs: Sequence[str] = ("i1", "i2", "i3", "i4"), outputs: Sequence[str] = ("o1", "o2"), **kwargs: str) -> Network:
    return replace(multilayer(spark, inputs, outputs, (), **kwargs), name="shallow")


# ---------------------------------------------------------------- queries


def _equal(df: DataFrame, values: dict[str, object]) -> Column:
    for name in values:
        if name not in df.columns:
            raise ValueError(f"unknown attribute {name!r}")
    out = F.lit(True)
    for name, value in values.items():
        out = out & F.col(name).eqNullSafe(F.lit(value))
    return out


def select_nodes(nodes: DataFrame, **values: object) -> DataFrame:
    """Nodes with these attribute values; order by node_order where order matters."""
    return nodes.where(_equal(nodes, values))


def select_edges(edges: DataFrame, **values: object) -> DataFrame:
    return edges.where(_equal(edges, values))


def group_members(df: DataFrame, by: str, member: str, order: str) -> DataFrame:
    """(by, members): members of each group in their order; a missing attribute is the group ''. For graphs of small layers."""
    key = F.coalesce(F.col(by).cast("string"), F.lit("")) if by in df.columns else F.lit("")
    return df.groupBy(key.alias(by)).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, member))), lambda x: x[member]).alias("members"))


def layers(nodes: DataFrame, **values: object) -> DataFrame:
    """(layer, first, size) of the layers of the selected nodes; `first` is the lowest node order."""
    return select_nodes(nodes, **values).groupBy("layer").agg(F.min("node_order").alias("first"), F.count("*").alias("size"))


def is_layered(nodes: DataFrame) -> DataFrame:
    ok = F.bool_and(F.col("layer").isNotNull() & F.col("layer_id").isNotNull() & F.col("layer_sub_id").isNotNull())
    return nodes.agg(F.coalesce(ok, F.lit(False)).alias("ok"))


def is_directed(network: Network) -> bool | None:
    """The declared flag; else whether first and last layer are visible, False for one layer, None if not layered."""
    if network.directed is not None:
        return network.directed
    if not is_layered(network.nodes).first()[0]:
        return None
    ends = network.nodes.groupBy("layer_id").agg(F.bool_and("visible").alias("v")).agg(F.count("*").alias("n"), F.min_by("v", "layer_id").alias("a"), F.max_by("v", "layer_id").alias("b")).first()
    return bool(ends["n"] > 1 and ends["a"] and ends["b"])


def _profile(network: Network) -> list[tuple[int, bool]]:
    """Size and visibility of each layer: a row per layer."""
    made = network.nodes.groupBy("layer_id").agg(F.count("*").alias("n"), F.bool_and("visible").alias("v"))
    return [(r["n"], r["v"]) for r in made.orderBy("layer_id").collect()]


@register("network_predicate", "feedforward")
def is_feedforward(network: Network) -> bool:
    """No empty layer, and the first and last layers, and only these, are visible."""
    p = _profile(network)
    return bool(p) and all(n > 0 and v == (k in (0, len(p) - 1)) for k, (n, v) in enumerate(p))


@register("network_predicate", "multilayer")
def is_multilayer(network: Network) -> bool:
    return is_feedforward(network) and len(_profile(network)) >= 3


@register("network_predicate", "deep_belief")
def is_deep_belief(network: Network) -> bool:
    """A multilayer network with an odd number of layers and hidden sizes that mirror at the centre."""
    sizes = [n for n, _ in _profile(network)]
    hidden = sizes[1:-1]
    return is_multilayer(network) and len(sizes) % 2 == 1 and hidden == hidden[::-1]


@register("network_predicate", "autoencoder")
def is_autoencoder(network: Network) -> bool:
    """A deep belief network whose first and last layer have the same labels."""
    if not is_deep_belief(network):
        return False
    ends = network.nodes.agg(F.min("layer_id").alias("a"), F.max("layer_id").alias("b")).first()
    sign = F.when(F.col("layer_id") == ends["a"], 1).when(F.col("layer_id") == ends["b"], -1)
    return network.nodes.groupBy("label").agg(F.coalesce(F.sum(sign), F.lit(0)).alias("more")).where("more <> 0").isEmpty()


def drop_units(network: Network, layer: str, labels: Sequence[str]) -> Network:
    """The network without some nodes of a layer and the edges at them; places within the layer close up."""
    gone = network.nodes.where((F.col("layer") == layer) & F.col("label").isin(list(labels))).select("id")
    nodes = network.nodes.join(gone, "id", "left_anti")
    at = number_rows(nodes, ["layer", "layer_sub_id", "id"], "__at")
    first = at.groupBy("layer").agg(F.min("__at").alias("__first"))  # a row per layer
    nodes = at.join(F.broadcast(first), "layer").withColumn("layer_sub_id", (F.col("__at") - F.col("__first")).cast("int")).select(network.nodes.columns)
    edges = network.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return replace(network, nodes=nodes, edges=edges.select(network.edges.columns))


def with_layer_nodes(network: Network, layer: str, labels: Sequence[str]) -> Network:
    """The network in which a layer has these nodes, in this order.

    Nodes that stay keep their edges; new ones, which are named as in build, are bound to all nodes of the layers beside.
    """
    spark = network.nodes.sparkSession
    of = network.nodes.where(F.col("layer") == layer)
    head = of.agg(F.first("layer_id").alias("layer_id"), F.bool_and("visible").alias("visible"), F.first("type").alias("type"), F.min("node_order").alias("first"), F.bool_and(F.col("id") == F.concat_ws(":", "layer", "label")).alias("named")).first()
    if head["layer_id"] is None:
        raise ValueError(f"unknown layer {layer!r}")
    kept = of.select("label", "id")
    listed = spark.createDataFrame([(x, k) for k, x in enumerate(dict.fromkeys(labels))], "label string, sub int")
    name = F.concat(F.lit(f"{layer}:"), F.col("label")) if head["named"] else F.col("label")
    own = listed.join(kept, "label", "left").withColumn("fresh", F.col("id").isNull()).withColumn("id", F.coalesce("id", name))
    rest = network.nodes.where(F.col("layer") != layer)
    shift = listed.count() - of.count()
    moved = rest.withColumn("node_order", F.when(F.col("layer_id") > head["layer_id"], F.col("node_order") + shift).otherwise(F.col("node_order")).cast("int"))
    made = own.select("id", "label", F.lit(layer).alias("layer"), F.lit(head["layer_id"]).cast("int").alias("layer_id"), F.col("sub").alias("layer_sub_id"), (F.col("sub") + head["first"]).cast("int").alias("node_order"), F.lit(head["visible"]).alias("visible"), F.lit(head["type"]).alias("type"))
    nodes = materialize(moved.select(made.columns).unionByName(made), "network-nodes")
    ends = nodes.select("id")
    edges = network.edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    fresh = own.where("fresh").select("id")
    pairs = full_binding(nodes.where(F.abs(F.col("layer_id") - head["layer_id"]) <= 1))
    new = pairs.join(fresh.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(pairs.join(fresh.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    places = nodes.select(F.col("id"), F.col("node_order"))
    old = edges.join(places.select(F.col("id").alias("src"), F.col("node_order").alias("a")), "src").join(places.select(F.col("id").alias("dst"), F.col("node_order").alias("b")), "dst")
    numbered = number_edges(old.select("src", "dst", "src_layer", "dst_layer", "layer_id", F.struct("a", "b").alias("place")).unionByName(new.select("src", "dst", "src_layer", "dst_layer", "layer_id", "place")))
    weights = push_weights(numbered, network.edges.select("src", "dst", "weight"))
    return replace(network, nodes=nodes, edges=weights)


def configure(network: Network, groups: dict[str, Sequence[str]]) -> Network:
    """The network whose layers have the nodes of the column groups of the same name (Dataset.column_groups), where these differ."""
    now = {r["layer"]: [m["label"] for m in sorted(r["members"], key=lambda m: m["k"])] for r in network.nodes.where(F.col("layer").isin(list(groups))).groupBy("layer").agg(F.collect_list(F.struct(F.col("layer_sub_id").alias("k"), "label")).alias("members")).collect()}
    for layer, names in groups.items():
        if layer in now and now[layer] != list(names):
            network = with_layer_nodes(network, layer, names)
    return network


def push_weights(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """Edges with weights from (src, dst, weight); edges without one keep theirs."""
    new = weights.select("src", "dst", F.col("weight").alias("__w"))
    return edges.join(new, ["src", "dst"], "left").withColumn("weight", F.coalesce("__w", "weight")).drop("__w").select(edges.columns)


# ---------------------------------------------------------------- algorithms


@register("graph", "degree")
def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree) of all nodes."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))))
    sums = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    i, o = (F.coalesce(c, F.lit(0)) for c in ("i", "o"))
    return nodes.select("id").join(sums, "id", "left").select("id", i.alias("in_degree"), o.alias("out_degree"), (i + o).alias("degree"))


@register("graph", "degree_centrality")
def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees over the number of other nodes."""
    n = nodes.agg(F.count("*").alias("n"))
    return degree(nodes, edges).join(F.broadcast(n), how="cross").select("id", *((F.col(c) / (F.col("n") - 1)).alias(c) for c in ("in_degree", "out_degree", "degree")))


@register("graph", "density")
def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(density): edges over ordered pairs of nodes."""
    return nodes.agg(F.count("*").alias("n")).join(edges.agg(F.count("*").alias("m")), how="cross").select((F.col("m") / (F.col("n") * (F.col("n") - 1))).alias("density"))


@register("graph", "reciprocity")
def reciprocity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(reciprocity): share of edges whose reverse is an edge too."""
    e = edges.select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("b"))
    return e.join(back, ["src", "dst"], "left").agg(F.avg(F.coalesce("b", F.lit(0))).alias("reciprocity"))


@register("graph", "pagerank")
def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(id, rank) after a fixed number of rounds; the rank of nodes without out-edges is spread over all nodes.

    Each round's ranks are written once, and those before go.
    """
    n = nodes.count()
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("m"))
    links = materialize(edges.select("src", "dst"), "links")
    state = materialize(nodes.select("id").join(out, "id", "left").select("id", "m", F.lit(1.0 / max(n, 1)).alias("rank")), "ranks")
    for _ in range(rounds):
        loose = state.agg(F.coalesce(F.sum(F.when(F.col("m").isNull(), F.col("rank"))), F.lit(0.0))).first()[0]
        carried = state.where("m is not null").select(F.col("id").alias("src"), (F.col("rank") / F.col("m")).alias("share"))
        got = links.join(carried, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("got"))
        rank = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + loose / n)
        before, state = state, materialize(state.select("id", "m").join(got, "id", "left").select("id", "m", rank.alias("rank")), "ranks")
        discard(before)
    discard(links)
    return state.select("id", "rank")


@register("graph", "connected_components")
def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable when edges have no direction."""
    from lumenframe.operators import components

    found = components.connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return nodes.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


@register("graph", "bfs")
def bfs(nodes: DataFrame, edges: DataFrame, source: str) -> DataFrame:
    """(id, depth): fewest edges from the source, along their direction; nodes out of reach are left out.

    A step for each depth, until nothing new is found; a step writes what it has found.
    """
    links = materialize(edges.select("src", "dst"), "links")
    front = nodes.where(F.col("id") == source).select("id", F.lit(0).alias("depth")).distinct()
    seen, depth = [front], 0
    while True:
        depth += 1
        step = links.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        known = reduce(DataFrame.unionByName, seen).select("id")
        front = materialize(step.join(known, "id", "left_anti").withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            discard(front, links)
            return reduce(DataFrame.unionByName, seen)
        seen.append(front)
        if len(seen) > 20:  # the plan stays short however deep the graph
            used, seen = seen, [materialize(reduce(DataFrame.unionByName, seen), "seen")]
            discard(*used)
            front = seen[0].where(F.col("depth") == depth)


@register("graph", "triangles")
def triangles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, triangles): triangles through each node when edges have no direction; loops and repeated edges don't count.

    Each edge leads from its end of lower degree to the other, so a node starts at most about sqrt(2 edges) of them and
    the pairs that are tried do not grow with the square of a hub's degree.
    """
    pair = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    pair = materialize(pair, "pairs")
    size = pair.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    sized = pair.join(size.select(F.col("id").alias("a"), F.struct("n", F.col("id")).alias("u")), "a").join(size.select(F.col("id").alias("b"), F.struct("n", F.col("id")).alias("v")), "b")
    out = sized.select(F.least("u", "v")["id"].alias("s"), F.greatest("u", "v")["id"].alias("t"))
    tried = out.join(out.withColumnRenamed("t", "r"), "s").where("t < r").select("s", F.col("t").alias("a"), F.col("r").alias("b"))
    found = tried.join(pair, ["a", "b"]).select(F.explode(F.array("s", "a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("triangles"))


@register("graph", "topological_generations")
def topological_generations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, generation): most edges on a way that ends at the node; null for nodes on a cycle or behind one.

    A step for each generation, until no node is free of edges from nodes that are left. A node keeps the number of the
    edges that it waits for, from which a step takes those whose start has just become free.
    """
    links = materialize(edges.select("src", "dst").distinct(), "links")
    into = links.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("waits"))
    state = materialize(nodes.select("id").join(into, "id", "left").select("id", F.coalesce("waits", F.lit(0)).alias("waits"), F.lit(None).cast("int").alias("generation")), "generations")
    free, turn = F.expr("waits = 0 and generation is null"), 0
    while not state.where(free).isEmpty():
        gone = links.join(state.where(free).select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("gone"))
        step = state.join(gone, "id", "left").select("id", (F.col("waits") - F.coalesce("gone", F.lit(0))).alias("waits"), F.when(free, F.lit(turn)).otherwise(F.col("generation")).alias("generation"))
        before, state = state, materialize(step, "generations")
        discard(before)
        turn += 1
    discard(links)
    return state.select("id", "generation")


@register("graph", "is_dag")
def is_dag(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ok): whether the graph has no directed cycle; true for no nodes."""
    return topological_generations(nodes, edges).agg(F.coalesce(F.bool_and(F.col("generation").isNotNull()), F.lit(True)).alias("ok"))


@register("graph", "shortest_path")
def shortest_path(nodes: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """(step, id) of a way with the fewest edges; of several nodes that lead on, the least id. No rows if out of reach."""
    spark = nodes.sparkSession
    depths = materialize(bfs(nodes, edges, source), "depths")
    end = depths.where(F.col("id") == target).first()
    way = [(end["depth"], target)] if end else []
    for step in range(end["depth"] - 1 if end else -1, -1, -1):
        before = depths.where(F.col("depth") == step).select(F.col("id").alias("src"))
        way.append((step, edges.where(F.col("dst") == way[-1][1]).join(before, "src").agg(F.min("src")).first()[0]))
    return spark.createDataFrame(way, "step int, id string")


def graph_data(nodes: DataFrame, edges: DataFrame, weight: str = "weight", threshold: float = 0.0, normalize: bool = False, soft: bool = True, flip: bool = True) -> DataFrame:
    """(src, dst, weight, positive): what a drawing of the network shows of its edges.

    Edges weaker than the threshold go; weights may be set against the size of their mean and pass a soft step. In a
    network of an odd number of layers all signs turn if negative ones prevail. `positive` is the sign as given; edges
    without a weight stay without one.
    """
    from lumenframe.functions import curves

    given = F.col(weight)
    mean = edges.agg(F.abs(F.avg(F.coalesce(given, F.lit(0.0)))).alias("__mean"))
    kept = edges.join(F.broadcast(mean), how="cross").where(given.isNull() | (F.abs(given) >= threshold))
    shown = F.when(F.col("__mean") > 0, given / F.col("__mean")).otherwise(given) if normalize else given
    made = kept.select("src", "dst", (curves.softstep(shown) if soft else shown).alias("weight"), (given > 0).alias("positive"))
    if not flip:
        return made
    odd = nodes.agg((F.countDistinct("layer") % 2 == 1).alias("__odd"))
    signs = made.agg((F.sum(F.signum("weight")) < 0).alias("__less"))
    turn = F.when(F.col("__odd") & F.col("__less"), -1.0).otherwise(1.0)
    return made.join(F.broadcast(odd), how="cross").join(F.broadcast(signs), how="cross").select("src", "dst", (F.col("weight") * turn).alias("weight"), "positive")


def node_groups(network: Network) -> DataFrame:
    """(id, group): source, target, transit or latent by layer in a directed network, else observable or latent."""
    if not is_directed(network):
        return network.nodes.select("id", F.when(F.coalesce("visible", F.lit(True)), "observable").otherwise("latent").alias("group"))
    ends = network.nodes.agg(F.min("layer_id").alias("__a"), F.max("layer_id").alias("__b"))
    first, last = F.col("layer_id") == F.col("__a"), F.col("layer_id") == F.col("__b")
    group = F.when(first & last, "transit").when(first, "source").when(last, "target").otherwise("latent")
    return network.nodes.join(F.broadcast(ends), how="cross").select("id", group.alias("group"))


def evaluate(network: Network, name: str, **kwargs) -> DataFrame:
    """A registered graph algorithm, of this module or of graphs."""
    from lumenframe.functions import registry
    from lumenframe.operators import graphs  # noqa: F401  it registers its own

    return registry.get("graph", name)(network.nodes, network.edges, **kwargs)
