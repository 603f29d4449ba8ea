"""Graph algorithms that go over the whole graph in rounds.

All take nodes (id) and edges (src, dst), with ids of any type that has an order, and give a row for each node or edge.
The state of a round is written to the shared folder and read again, so a lost executor costs one round and plans stay
short; what is no longer needed is deleted. A node with many edges is a key of partial aggregates and of joins that
adaptive execution may split, never a collected list. The driver sees counts and bounds only.

Unless said otherwise loops, repeated edges and edges with a missing end make no difference, and edges should join
given nodes only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.registry import register
from lumenframe.operators.arrays import number_rows
from lumenframe.operators.components import connected_components
from lumenframe.storage import discard, materialize


def _links(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """Directed edges once each, without loops; of repeated ones the least weight."""
    e = edges.where("src <> dst")
    if weight is None:
        return e.select("src", "dst").distinct()
    return e.groupBy("src", "dst").agg(F.min(F.col(weight).cast("double")).alias("w")).where("w is not null")


def _both_ways(edges: DataFrame) -> DataFrame:
    """Each edge once in either direction."""
    pair = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    turn = lambda s, d: F.struct(F.col(s).alias("src"), F.col(d).alias("dst"))
    return pair.select(F.inline(F.array(turn("a", "b"), turn("b", "a"))))


def _renamed(df: DataFrame, **names: str) -> DataFrame:
    """Columns under new names: name=column."""
    return df.select(*(F.col(c).alias(n) for n, c in names.items()))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# ---------------------------------------------------------------- strongly connected components


@register("graph", "strongly_connected_components")
def strongly_connected_components(nodes: DataFrame, edges: DataFrame, trims: int = 3) -> DataFrame:
    """(id, component): the least id among the nodes that a node can reach and that can reach it.

    Forward-backward colouring: nodes without an edge in or out are components of their own and go first, a few times;
    then every node takes the least id that reaches it, and what reaches that id back within its colour is its
    component. Components that were found go, as do edges between colours.
    """
    links = materialize(_links(edges), "links")
    left = materialize(nodes.select("id").distinct(), "left")
    found: list[DataFrame] = []
    while not left.isEmpty():
        for _ in range(trims):
            ends = links.select(F.inline(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
            inner = ends.groupBy("id").agg((F.max("o") + F.max("i") == 2).alias("inner"))
            state = materialize(left.join(inner, "id", "left").select("id", F.coalesce("inner", F.lit(False)).alias("inner")), "trimmed")
            outer = materialize(state.where(~F.col("inner")).select("id", F.col("id").alias("component")), "trimmed")
            if outer.isEmpty():
                discard(state, outer)
                break
            _keep(found, outer)
            before, left = left, materialize(state.where("inner").select("id"), "left")
            discard(before, state)
            links = _within(links, left)
        if left.isEmpty():
            break
        colour = _least_ancestor(left, links)
        own = links.join(_renamed(colour, src="id", c="colour"), "src").join(_renamed(colour, dst="id", k="colour"), "dst").where("c = k").select("src", "dst", F.col("c").alias("colour"))
        before, links = links, materialize(own, "links")
        discard(before)
        members = _reach_back(colour.where("id = colour"), links)
        before, left = left, materialize(left.join(members.select("id"), "id", "left_anti"), "left")
        _keep(found, materialize(_renamed(members, id="id", component="colour"), "members"))
        discard(before, colour, members)
        links = _within(links, left)
    discard(links)
    return _union(found) if found else nodes.select("id", F.col("id").alias("component")).limit(0)


def _within(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links between these nodes, written; the ones before are deleted."""
    out = materialize(links.join(_renamed(nodes, src="id"), "src", "left_semi").join(_renamed(nodes, dst="id"), "dst", "left_semi").select("src", "dst"), "links")
    discard(links)
    return out


def _least_ancestor(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, colour): the least id from which a node can be reached; a round tells what changed in the one before."""
    state = nodes.select("id", F.col("id").alias("colour"), F.lit(True).alias("changed"))
    while True:
        told = links.join(_renamed(state.where("changed"), src="id", colour="colour"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("c"))
        step = state.join(told, "id", "left").select("id", F.least("colour", F.coalesce("c", "colour")).alias("colour"), F.coalesce(F.col("c") < F.col("colour"), F.lit(False)).alias("changed"))
        before, state = state, materialize(step, "colours")
        discard(before)
        if state.where("changed").isEmpty():
            return state


def _reach_back(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(id, colour) of what reaches the root of its colour along links of that colour."""
    front = materialize(roots.select("id", "colour"), "roots")
    reached = [front]
    while True:
        step = links.join(_renamed(front, dst="id", colour="colour"), ["dst", "colour"]).select(F.col("src").alias("id"), "colour").distinct()
        front = materialize(step.join(_union(reached), ["id", "colour"], "left_anti"), "reached")
        if front.isEmpty():
            discard(front)
            return _gathered(reached)
        _keep(reached, front)
        front = reached[-1] if len(reached) == 1 else front


def _keep(frames: list[DataFrame], more: DataFrame) -> None:
    """Add a frame to those that make the result; many become one, so that plans stay short."""
    frames.append(more)
    if len(frames) > 20:
        frames[:] = [_gathered(frames)]


def _gathered(frames: list[DataFrame]) -> DataFrame:
    """The rows of all frames, written as one; the frames are deleted."""
    out = materialize(_union(frames), "gathered")
    discard(*frames)
    return out


# ---------------------------------------------------------------- weighted distances


@register("graph", "shortest_distances")
def shortest_distances(nodes: DataFrame, edges: DataFrame, source: object, weight: str = "weight", delta: float | None = None) -> DataFrame:
    """(id, distance, via) of all nodes in reach of the source, along the direction of edges; weights must not be negative.

    Delta-stepping: tentative distances fall into buckets of width delta (the mean weight unless given). Edges up to
    delta are followed from the first bucket until it gains nothing more, longer ones once from all that is in it.
    `via` is the node before on a shortest way, of several the least; it is null for the source.
    """
    links = materialize(_links(edges, weight), "links")
    facts = links.agg(F.min("w").alias("least"), F.avg("w").alias("mean")).first()
    if facts["least"] is not None and facts["least"] < 0:
        raise ValueError("a weight is negative")
    width = delta or facts["mean"] or 1.0
    state = nodes.where(F.col("id") == source).select("id", F.lit(0.0).alias("d"), F.lit(True).alias("light"), F.lit(True).alias("heavy")).distinct()
    bucket = F.floor(F.col("d") / width)
    while True:
        # the first bucket with something to do, and whether light edges are part of it
        turn = state.where("light or heavy").agg(F.min(F.struct(bucket.alias("at"), (~F.col("light")).alias("only_heavy"))).alias("t")).first()["t"]
        if turn is None:
            break
        kind = "heavy" if turn["only_heavy"] else "light"
        due = (bucket == turn["at"]) & F.col(kind)
        usable = links.where(F.col("w") > width if turn["only_heavy"] else F.col("w") <= width)
        told = usable.join(_renamed(state.where(due), src="id", d="d"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("d") + F.col("w")).alias("c"))
        now = state.withColumn(kind, F.col(kind) & ~due)
        better = F.col("c").isNotNull() & (F.col("d").isNull() | (F.col("c") < F.col("d")))
        step = now.join(told, "id", "full").select("id", F.when(better, F.col("c")).otherwise(F.col("d")).alias("d"), *(F.when(better, True).otherwise(F.col(k)).alias(k) for k in ("light", "heavy")))
        before, state = state, materialize(step, "distances")
        discard(before)
    ways = links.join(_renamed(state, src="id", d="d"), "src").join(_renamed(state, dst="id", e="d"), "dst").where("d + w = e").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("via"))
    return state.join(ways, "id", "left").select("id", F.col("d").alias("distance"), F.when(F.col("id") != F.lit(source), F.col("via")).alias("via"))


# ---------------------------------------------------------------- centrality


@register("graph", "betweenness")
def betweenness(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, batch: int = 256, normalized: bool = True) -> DataFrame:
    """(id, betweenness): sum over pairs of other nodes of the share of their shortest ways that pass the node.

    Brandes' sums for `batch` sources at a time: ways are counted level by level away from all of them at once, and
    dependencies flow back the same levels. All nodes are sources unless some (id) are given. Edges have a direction
    and count once; normalized divides by the number of ordered pairs of other nodes.
    """
    links = materialize(_links(edges), "links")
    n = nodes.count()
    starts = materialize(number_rows((sources or nodes).select("id").distinct(), ["id"], "at"), "sources")
    total: list[DataFrame] = []
    for low in range(0, starts.count(), batch):
        front = starts.where((F.col("at") >= low) & (F.col("at") < low + batch)).select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("ways"))
        levels = [materialize(front, "level")]
        while True:
            step = links.join(_renamed(levels[-1], s="s", src="v", ways="ways"), "src").groupBy("s", F.col("dst").alias("v")).agg(F.sum("ways").alias("ways"))
            level = materialize(step.join(_union([x.select("s", "v") for x in levels]), ["s", "v"], "left_anti"), "level")
            if level.isEmpty():
                discard(level)
                break
            levels.append(level)
        below, sums, used = None, [], list(levels)
        for level in reversed(levels):
            if below is None:
                below = level.withColumn("depends", F.lit(0.0))
                continue
            shares = below.select("s", F.col("v").alias("dst"), ((1 + F.col("depends")) / F.col("ways")).alias("share"))
            from_below = links.join(shares, "dst")
            shares = from_below.groupBy("s", F.col("src").alias("v")).agg(F.sum("share").alias("share"))
            step = level.join(shares, ["s", "v"], "left").select("s", "v", "ways", (F.col("ways") * F.coalesce("share", F.lit(0.0))).alias("depends"))
            sums.append(below.where("s <> v").select(F.col("v").alias("id"), "depends"))
            below = materialize(step, "dependencies")
            used.append(below)
        if sums:
            _keep(total, materialize(_union(sums).groupBy("id").agg(F.sum("depends").alias("depends")), "dependencies"))
        discard(*used)
    discard(links, starts)
    pairs = max((n - 1) * (n - 2), 1) if normalized else 1
    if not total:
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    sums = _union(total).groupBy("id").agg((F.sum("depends") / pairs).alias("b"))
    return nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("b", F.lit(0.0)).alias("betweenness"))


@register("graph", "neighbourhoods")
def neighbourhoods(nodes: DataFrame, edges: DataFrame, lg_k: int = 12, rounds: int | None = None) -> DataFrame:
    """(id, reached, distance_sum, harmonic, closeness) from the nodes that can reach a node.

    HyperBall: every node holds a sketch of the nodes within so many steps, and each round merges into it the sketches
    at the other ends of its incoming edges, until no estimate grows. reached counts the node itself; harmonic sums
    1 / distance, closeness is (reached - 1)^2 / (distance_sum (n - 1)). A sketch has at most 2^lg_k cells, with a
    relative standard error of about 1.04 / sqrt(2^lg_k); small sets are counted exactly.
    """
    links = materialize(_links(edges), "links")
    n = nodes.count()
    first = nodes.groupBy("id").agg(F.hll_sketch_agg(F.col("id").cast("string"), lg_k).alias("sketch"))
    state = materialize(first.select("id", "sketch", F.lit(1).cast("long").alias("size"), F.lit(0.0).alias("far"), F.lit(0.0).alias("harmonic"), F.lit(True).alias("changed")), "balls")
    t = 0
    while rounds is None or t < rounds:
        t += 1
        told = links.join(_renamed(state.where("changed"), src="id", sketch="sketch"), "src").groupBy(F.col("dst").alias("id")).agg(F.hll_union_agg("sketch").alias("more"))
        union = F.when(F.col("more").isNull(), F.col("sketch")).otherwise(F.hll_union("sketch", "more"))
        step = state.join(told, "id", "left").select("id", union.alias("sketch"), F.col("size").alias("old"), "far", "harmonic")
        step = step.withColumn("size", F.greatest("old", F.hll_sketch_estimate("sketch"))).withColumn("gain", (F.col("size") - F.col("old")).cast("double"))
        step = step.select("id", "sketch", "size", (F.col("far") + t * F.col("gain")).alias("far"), (F.col("harmonic") + F.col("gain") / t).alias("harmonic"), (F.col("gain") > 0).alias("changed"))
        before, state = state, materialize(step, "balls")
        discard(before)
        if state.where("changed").isEmpty():
            break
    others = (F.col("size") - 1).cast("double")
    close = F.when(F.col("far") > 0, others / F.col("far") * others / F.lit(max(n - 1, 1))).otherwise(F.lit(0.0))
    return state.select("id", F.col("size").alias("reached"), F.col("far").alias("distance_sum"), "harmonic", close.alias("closeness"))


@register("graph", "core_numbers")
def core_numbers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, core): the largest k such that the node is in a part in which all have k neighbours; edges have no direction.

    From its degree on, each node takes the largest h for which h of its neighbours have h or more, until none changes.
    """
    links = materialize(_both_ways(edges), "links")
    degree = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("core"))
    state = materialize(nodes.select("id").distinct().join(degree, "id", "left").select("id", F.coalesce("core", F.lit(0)).cast("long").alias("core")), "cores")
    while True:
        near = links.join(_renamed(state, dst="id", h="core"), "dst").groupBy(F.col("src").alias("id"), "h").agg(F.count("*").alias("n"))
        above = F.sum("n").over(Window.partitionBy("id").orderBy(F.desc("h")))
        best = near.withColumn("c", F.least("h", above)).groupBy("id").agg(F.max("c").alias("c"))
        step = state.join(best, "id", "left").select("id", F.least("core", F.coalesce("c", F.lit(0))).alias("core"), F.col("core").alias("old"))
        before, state = state, materialize(step, "cores")
        discard(before)
        if state.where("core < old").isEmpty():
            return state.select("id", "core")


# ---------------------------------------------------------------- forests


@register("graph", "minimum_spanning_forest")
def minimum_spanning_forest(nodes: DataFrame, edges: DataFrame, weight: str = "weight") -> DataFrame:
    """(a, b, weight): the edges that join every component at the least total weight; a < b, edges have no direction.

    Boruvka's rounds: each part takes its least edge, parts joined so become one, edges inside a part go. Of equal
    weights the edge with the smaller ends comes first, so the forest is unique.
    """
    e = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min(F.col(weight).cast("double")).alias("w")).where("w is not null")
    links = materialize(e.select(F.col("a").alias("u"), F.col("b").alias("v"), F.struct("w", "a", "b").alias("e")), "links")
    taken = [e.select(F.struct("w", "a", "b").alias("e")).limit(0)]
    while not links.isEmpty():
        ends = links.select(F.inline(F.array(F.struct(F.col("u").alias("part"), F.col("v").alias("other"), "e"), F.struct(F.col("v").alias("part"), F.col("u").alias("other"), "e"))))
        least = materialize(ends.groupBy("part").agg(F.min(F.struct("e", "other")).alias("m")).select("part", "m.other", "m.e"), "least")
        taken.append(least.select("e"))
        joined = connected_components(_renamed(least, a="part", b="other"))
        step = links.join(_renamed(joined, u="node", x="component"), "u").join(_renamed(joined, v="node", y="component"), "v").where("x <> y")
        step = step.groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.min("e").alias("e"))
        before, links = links, materialize(step, "links")
        discard(before, joined)
    discard(links)
    return _union(taken).distinct().select("e.a", "e.b", F.col("e.w").alias("weight"))


# ---------------------------------------------------------------- communities


def _weighted(edges: DataFrame, weight: str | None) -> DataFrame:
    """(a, b, w): undirected edges with summed weights, loops too; a <= b."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return edges.where("src is not null and dst is not null").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(w).alias("w")).where("w > 0")


def _modularity(links: DataFrame, label: DataFrame) -> DataFrame:
    """(q) of labels (id, c) on (a, b, w)."""
    named = links.join(_renamed(label, a="id", x="c"), "a").join(_renamed(label, b="id", y="c"), "b")
    sums = named.select(F.inline(F.array(F.struct(F.col("x").alias("c"), F.col("w").alias("k"), F.when(F.col("x") == F.col("y"), F.col("w")).otherwise(0.0).alias("i")), F.struct(F.col("y").alias("c"), F.col("w").alias("k"), F.lit(0.0).alias("i")))))
    parts = sums.groupBy("c").agg(F.sum("k").alias("k"), F.sum("i").alias("i"))
    m = F.sum("k") / 2
    return parts.agg(F.coalesce(F.sum("i") / m - F.sum(F.col("k") * F.col("k")) / (4 * m * m), F.lit(0.0)).alias("q"))


@register("graph", "modularity")
def modularity(nodes: DataFrame, edges: DataFrame, labels: DataFrame, weight: str | None = None) -> DataFrame:
    """(modularity) of a partition (id, community): the share of weight inside communities less what chance would give; edges have no direction and count as often as they stand."""
    return _modularity(_weighted(edges, weight), _renamed(labels, id="id", c="community")).select(F.col("q").alias("modularity"))


#: What a round may move: towards smaller or larger labels, and all nodes or those of one half by hash.
_TURNS = [(True, None), (False, None), (True, 0), (False, 0), (True, 1), (False, 1)]


@register("graph", "communities")
def communities(nodes: DataFrame, edges: DataFrame, weight: str | None = None, rounds: int = 50) -> DataFrame:
    """(id, community): parts with much weight inside, by moves that raise the modularity; named after their least node.

    Every round all nodes look for the neighbouring community that gains most, of equal ones that with the least label,
    and move to it at once, in turns to smaller and to larger labels only, so that no two swap; a round that does not
    raise the modularity is taken back and the next turn tried. When no turn helps, communities become nodes and all
    starts over, until nothing moves. The result is the same on every run.
    """
    links = materialize(_weighted(edges, weight), "links")
    where = materialize(nodes.select("id", F.col("id").alias("c")).distinct(), "members")
    while True:
        moved = _moves(links, rounds)
        if moved is None:
            break
        named = links.join(_renamed(moved, a="id", x="c"), "a").join(_renamed(moved, b="id", y="c"), "b")
        step = named.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w"))
        renamed = where.join(_renamed(moved, c="id", d="c"), "c", "left").select("id", F.coalesce("d", "c").alias("c"))
        old = (links, where)
        links, where = materialize(step, "links"), materialize(renamed, "members")
        discard(*old, moved)
    discard(links)
    least = where.groupBy("c").agg(F.min("id").alias("community"))
    return where.join(least, "c").select("id", "community")


def _moves(links: DataFrame, rounds: int) -> DataFrame | None:
    """(id, c) after the moves of one level; None if none helps."""
    ends = links.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))))
    near = materialize(ends.where("src <> dst"), "ends")
    degree = materialize(ends.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")), "degrees")
    twice = degree.agg(F.sum("k")).first()[0]
    label = degree.select("id", F.col("id").alias("c"))
    if not twice:
        discard(near, degree)
        return None
    best, helped, idle, turn = _modularity(links, label).first()[0], False, 0, 0
    while idle < len(_TURNS) and turn < rounds:
        down, half = _TURNS[turn % len(_TURNS)] if idle else _TURNS[turn % 2]
        turn += 1
        state = label.join(degree, "id")
        weights = state.groupBy("c").agg(F.sum("k").alias("total"))
        seen = near.join(_renamed(label, dst="id", c="c"), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("inside"))
        own = _renamed(state, id="id", c="c").withColumn("inside", F.lit(0.0))
        options = seen.unionByName(own).groupBy("id", "c").agg(F.sum("inside").alias("inside")).join(weights, "c").join(_renamed(state, id="id", now="c", k="k"), "id")
        stays = F.col("c") == F.col("now")
        gain = F.round(F.col("inside") - F.col("k") * (F.col("total") - F.when(stays, F.col("k")).otherwise(0.0)) / twice, 9)
        options = options.select("id", "now", "c", gain.alias("gain"), stays.alias("stays")).groupBy("id", "now")
        options = options.agg(F.max(F.when(F.col("stays"), F.col("gain"))).alias("base"), F.min(F.struct((-F.col("gain")).alias("loss"), (~F.col("stays")).alias("away"), "c")).alias("m"))
        allowed = (F.col("m.c") < F.col("now")) if down else (F.col("m.c") > F.col("now"))
        if half is not None:
            allowed = allowed & (F.crc32(F.col("id").cast("string")) % 2 == half)
        step = materialize(options.select("id", F.when(allowed & (-F.col("m.loss") > F.col("base")), F.col("m.c")).otherwise(F.col("now")).alias("c")), "labels")
        q = _modularity(links, step).first()[0]
        if q > best + 1e-12:
            discard(label)
            label, best, helped, idle = step, q, True, 0
        else:
            discard(step)
            idle += 1
    discard(near, degree)
    return label if helped else None


# ---------------------------------------------------------------- greedy choices in a hashed order


def _order(*columns: str) -> Column:
    """A fixed order of nodes or edges that has nothing to do with the graph."""
    return F.struct(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in columns))).alias("hash"), *columns)


@register("graph", "independent_set")
def independent_set(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, chosen): a maximal set of nodes of which no two are joined; edges have no direction.

    Luby's rounds with the order of hashed ids: a node that comes before all its open neighbours is chosen and closes
    them. It is the set that going through all nodes in that order would choose.
    """
    links = materialize(_both_ways(edges), "links")
    left = materialize(nodes.select("id").distinct(), "left")
    found: list[DataFrame] = []
    while not left.isEmpty():
        rivals = links.groupBy(F.col("src").alias("id")).agg(F.min(_order("dst")).alias("first"))
        state = left.join(rivals, "id", "left").withColumn("chosen", F.coalesce(F.col("first") > _order("id"), F.lit(True)))
        chosen = materialize(state.where("chosen").select("id"), "chosen")
        closed = links.join(_renamed(chosen, src="id"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        gone = materialize(chosen.withColumn("chosen", F.lit(True)).unionByName(closed.withColumn("chosen", F.lit(False))), "decided")
        before, left = left, materialize(left.join(gone.select("id"), "id", "left_anti"), "left")
        _keep(found, gone)
        discard(before, chosen)
        links = _within(links, left)
    discard(links)
    return _union(found) if found else nodes.select("id", F.lit(True).alias("chosen")).limit(0)


@register("graph", "matching")
def matching(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b): a maximal set of edges of which no two share an end; a < b, edges have no direction.

    In rounds, an edge that comes first at both of its ends in the order of hashed pairs is taken and closes its ends.
    """
    left = materialize(edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "left")
    found = [edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).limit(0)]
    while not left.isEmpty():
        ends = left.select(F.inline(F.array(F.struct(F.col("a").alias("id"), _order("a", "b").alias("e")), F.struct(F.col("b").alias("id"), _order("a", "b").alias("e")))))
        first = ends.groupBy("id").agg(F.min("e").alias("e"))
        taken = materialize(first.groupBy("e").agg(F.count("*").alias("n")).where("n = 2").select("e.a", "e.b"), "taken")
        gone = taken.select(F.explode(F.array("a", "b")).alias("id"))
        before, left = left, materialize(left.join(_renamed(gone, a="id"), "a", "left_anti").join(_renamed(gone, b="id"), "b", "left_anti").select("a", "b"), "left")
        _keep(found, taken)
        discard(before)
    return _union(found)


@register("graph", "colouring")
def colouring(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, colour): numbers from 0 that differ along every edge; edges have no direction.

    In rounds, a node that comes before all its open neighbours in the order of hashed ids takes the least number that
    no neighbour has. There are at most as many as the largest degree and one.
    """
    links = materialize(_both_ways(edges), "links")
    state = materialize(nodes.select("id", F.lit(None).cast("int").alias("colour")).distinct(), "colours")
    while not state.where("colour is null").isEmpty():
        named = links.join(_renamed(state, dst="id", c="colour"), "dst").join(_renamed(state.where("colour is null"), src="id"), "src", "left_semi")
        facts = named.groupBy(F.col("src").alias("id")).agg(F.min(F.when(F.col("c").isNull(), _order("dst"))).alias("first"), F.collect_set("c").alias("used"))
        used = F.coalesce("used", F.array().cast("array<int>"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size(used)), used))
        turn = F.col("colour").isNull() & F.coalesce(F.col("first") > _order("id"), F.lit(True))
        before, state = state, materialize(state.join(facts, "id", "left").select("id", F.when(turn, free).otherwise(F.col("colour")).alias("colour")), "colours")
        discard(before)
    discard(links)
    return state
