"""Graph algorithms against plain versions on random and odd graphs."""

from __future__ import annotations

import hashlib
import heapq
import random
from collections import deque
from itertools import combinations

import pytest

from lumenframe.operators import graphs
from lumenframe.operators import network as net


def graph(spark, n, m, seed=0, chain=0):
    """Ids of nodes and edges with weights; some are loops and repeats, some nodes stand alone."""
    rng = random.Random(seed)
    ids = [f"n{k:03d}" for k in range(n)]
    edges = [(rng.choice(ids[: n - 2]), rng.choice(ids[: n - 2]), float(rng.randrange(1, 30))) for _ in range(m)]
    edges += edges[:5] + [(ids[0], ids[0], 1.0), (None, ids[1], 1.0)]
    tail = [f"t{k:03d}" for k in range(chain)]
    edges += [(a, b, 1.0) for a, b in zip(tail, tail[1:], strict=False)]
    ids += tail
    return ids, edges, spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edges, "src string, dst string, weight double")


def least(edges):
    out = {}
    for a, b, w in edges:
        if a and b and a != b:
            out[a, b] = min(w, out.get((a, b), w))
    return out


def outgoing(edges):
    out = {}
    for a, b in least(edges):
        out.setdefault(a, set()).add(b)
    return out


def undirected(edges):
    out = {}
    for a, b in least(edges):
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def depths(out, s):
    found, queue = {s: 0}, deque([s])
    while queue:
        a = queue.popleft()
        for b in out.get(a, ()):
            if b not in found:
                found[b] = found[a] + 1
                queue.append(b)
    return found


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


@pytest.mark.parametrize("n,m,chain", [(40, 60, 0), (30, 25, 12), (20, 120, 0)])
def test_strong_components(spark, n, m, chain):
    ids, edges, nodes, links = graph(spark, n, m, n, chain)
    out = outgoing(edges)
    reach = {i: set(depths(out, i)) for i in ids}
    want = {i: min(j for j in ids if j in reach[i] and i in reach[j]) for i in ids}
    assert as_dict(graphs.strongly_connected_components(nodes, links, trims=1), "id", "component") == want


@pytest.mark.parametrize("delta", [None, 1.0, 1e9])
def test_distances(spark, delta):
    ids, edges, nodes, links = graph(spark, 40, 110, 3)
    out = {}
    for (a, b), w in least(edges).items():
        out.setdefault(a, []).append((b, w))
    want, heap = {}, [(0.0, "n001")]
    while heap:
        d, a = heapq.heappop(heap)
        if a not in want:
            want[a] = d
            for b, w in out.get(a, ()):
                heapq.heappush(heap, (d + w, b))
    got = graphs.shortest_distances(nodes, links, "n001", delta=delta).collect()
    assert {r["id"]: r["distance"] for r in got} == want
    for r in got:
        before = [a for (a, b), w in least(edges).items() if b == r["id"] and a in want and want[a] + w == want[b]]
        assert r["via"] == (None if r["id"] == "n001" else min(before))
    assert graphs.shortest_distances(nodes, links, "gone").count() == 0
    with pytest.raises(ValueError, match="negative"):
        graphs.shortest_distances(nodes, links.selectExpr("src", "dst", "-weight as weight"), "n001")


@pytest.mark.parametrize("batch", [7, 256])
def test_betweenness(spark, batch):
    ids, edges, nodes, links = graph(spark, 18, 40, 4)
    out = outgoing(edges)
    want = dict.fromkeys(ids, 0.0)
    for s in ids:
        d = depths(out, s)
        for t in d:
            ways = []

            def walk(way, t=t, d=d, ways=ways):
                if way[-1] == t:
                    ways.append(way)
                for b in out.get(way[-1], ()):
                    if d[b] == len(way) and d[b] <= d[t]:
                        walk([*way, b])

            walk([s])
            for w in ways:
                for v in w[1:-1]:
                    want[v] += 1 / len(ways)
    got = as_dict(graphs.betweenness(nodes, links, batch=batch, normalized=False), "id", "betweenness")
    assert got == pytest.approx(want)
    some = as_dict(graphs.betweenness(nodes, links, sources=nodes.where("id < 'n004'")), "id", "betweenness")
    assert all(some[i] * 17 * 16 <= got[i] + 1e-9 * 17 * 16 + got[i] for i in ids)


def test_neighbourhoods_are_close_to_bfs(spark):
    ids, edges, nodes, links = graph(spark, 600, 1500, 5)
    back = outgoing([(b, a, w) for a, b, w in edges])
    for r in graphs.neighbourhoods(nodes, links, lg_k=10).collect():
        d = depths(back, r["id"])
        assert abs(r["reached"] - len(d)) <= max(0.5, 0.15 * len(d))
        assert r["distance_sum"] == pytest.approx(sum(d.values()), rel=0.2, abs=0.5)
        assert r["harmonic"] == pytest.approx(sum(1 / x for x in d.values() if x), rel=0.2, abs=0.5)
    one = as_dict(net_bfs_count(nodes, links), "id", "n")
    assert one["n000"] == len(depths(outgoing(edges), "n000"))


def net_bfs_count(nodes, links):
    from pyspark.sql import functions as F

    return net.bfs(nodes, links.where("src is not null"), "n000").agg(F.count("*").alias("n")).selectExpr("'n000' as id", "n")


def test_core_numbers(spark):
    ids, edges, nodes, links = graph(spark, 40, 150, 6)
    near = undirected(edges)
    want = dict.fromkeys(ids, 0)
    for k in range(1, 40):
        left = set(ids)
        while gone := {i for i in left if len(near.get(i, set()) & left) < k}:
            left -= gone
        want.update(dict.fromkeys(left, k))
    assert as_dict(graphs.core_numbers(nodes, links), "id", "core") == want


def test_spanning_forest(spark):
    ids, edges, nodes, links = graph(spark, 40, 60, 7)
    e = {}
    for (a, b), w in least(edges).items():
        pair = (min(a, b), max(a, b))
        e[pair] = min(w, e.get(pair, w))
    up, want = {i: i for i in ids}, set()

    def top(i):
        return i if up[i] == i else top(up[i])

    for w, a, b in sorted((w, a, b) for (a, b), w in e.items()):
        if top(a) != top(b):
            up[top(a)] = top(b)
            want.add((a, b, w))
    assert {tuple(r) for r in graphs.minimum_spanning_forest(nodes, links).collect()} == want


def plain_modularity(edges, label):
    m = sum(w for a, b, w in edges if a and b)
    q = sum(w for a, b, w in edges if a and b and label[a] == label[b]) / m
    k = {}
    for a, b, w in edges:
        for i in (a, b):
            if a and b:
                k[label[i]] = k.get(label[i], 0) + w
    return q - sum(x * x for x in k.values()) / (4 * m * m)


def test_communities(spark):
    rng = random.Random(8)
    ids = [f"n{k:02d}" for k in range(48)]
    part = {i: k // 12 for k, i in enumerate(ids)}
    edges = [(a, b, 1.0) for a, b in combinations(ids, 2) if rng.random() < (0.7 if part[a] == part[b] else 0.04)]
    nodes, links = spark.createDataFrame([(i,) for i in [*ids, "alone"]], "id string"), spark.createDataFrame(edges, "src string, dst string, weight double")
    found = graphs.communities(nodes, links, "weight")
    got = as_dict(found, "id", "community")
    assert got == {i: ids[12 * part[i]] for i in ids} | {"alone": "alone"}
    q = graphs.modularity(nodes, links, found, "weight").first()[0]
    assert q == pytest.approx(plain_modularity(edges, got))
    ids, edges, nodes, links = graph(spark, 30, 60, 9)
    label = as_dict(graphs.communities(nodes, links, "weight"), "id", "community")
    assert plain_modularity(edges, label) > max(0.25, plain_modularity(edges, dict.fromkeys(ids, 0)))


def hashed(*ids):
    return (hashlib.md5("|".join(ids).encode()).hexdigest(), *ids)


def test_greedy_choices(spark):
    ids, edges, nodes, links = graph(spark, 40, 90, 10)
    near = undirected(edges)
    chosen, colour = set(), {}
    for i in sorted(ids, key=hashed):
        if not near.get(i, set()) & chosen:
            chosen.add(i)
        colour[i] = min(set(range(50)) - {colour[j] for j in near.get(i, ()) if j in colour})
    taken, closed = set(), set()
    for a, b in sorted({(min(p), max(p)) for p in least(edges)}, key=lambda p: hashed(*p)):
        if not {a, b} & closed:
            taken.add((a, b))
            closed |= {a, b}
    assert as_dict(graphs.independent_set(nodes, links), "id", "chosen") == {i: i in chosen for i in ids}
    assert as_dict(graphs.colouring(nodes, links), "id", "colour") == colour
    assert {tuple(r) for r in graphs.matching(nodes, links).collect()} == taken


def test_graphs_without_edges(spark):
    nodes, none = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([], "src string, dst string, weight double")
    assert as_dict(graphs.strongly_connected_components(nodes, none), "id", "component") == {"a": "a", "b": "b"}
    assert as_dict(graphs.shortest_distances(nodes, none, "a"), "id", "distance") == {"a": 0}
    assert as_dict(graphs.betweenness(nodes, none), "id", "betweenness") == {"a": 0, "b": 0}
    assert as_dict(graphs.neighbourhoods(nodes, none), "id", "reached") == {"a": 1, "b": 1}
    assert as_dict(graphs.core_numbers(nodes, none), "id", "core") == {"a": 0, "b": 0}
    assert as_dict(graphs.communities(nodes, none), "id", "community") == {"a": "a", "b": "b"}
    assert as_dict(graphs.independent_set(nodes, none), "id", "chosen") == {"a": True, "b": True}
    assert as_dict(graphs.colouring(nodes, none), "id", "colour") == {"a": 0, "b": 0}
    assert graphs.minimum_spanning_forest(nodes, none).count() == graphs.matching(nodes, none).count() == 0
    empty = nodes.limit(0)
    for f in (graphs.strongly_connected_components, graphs.betweenness, graphs.neighbourhoods, graphs.core_numbers, graphs.communities, graphs.independent_set, graphs.colouring):
        assert f(empty, none).count() == 0
