"""Layouts of layered graphs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRECTIONS = ("right", "left", "up", "down")


def layer_costs(nodes: DataFrame, edges: DataFrame, layer: int, weight: str = "weight") -> DataFrame:
    """(id, sub, place, cost) for the nodes of a layer, numbered by `sub`, and all its places: the weights of a node's edges to the layer before, each times the distance.

    nodes: id, layer_id, sub (places from 0). Distances are those of (place + 0.5) / (size + 1).
    """
    own, before = (nodes.where(F.col("layer_id") == k) for k in (layer, layer - 1))
    sizes = own.agg(F.count("*").alias("n")).join(before.agg(F.count("*").alias("m")), how="cross")
    ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), F.abs(F.col(weight)).alias("w"), F.lit(0).alias("turned")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), F.abs(F.col(weight)).alias("w"), F.lit(1).alias("turned")))))
    ends = ends.groupBy("a", "b").agg(F.min_by("w", "turned").alias("w"))
    pulls = ends.join(before.select(F.col("id").alias("a"), F.col("sub").alias("s")), "a").join(own.select(F.col("id").alias("b")), "b").where("w IS NOT NULL")
    pulls = pulls.groupBy("b").agg(F.collect_list(F.struct("s", "w")).alias("pulls"))  # at most the size of the layer before
    placed = own.select("id", "sub").join(pulls.withColumnRenamed("b", "id"), "id", "left").join(F.broadcast(sizes), how="cross")
    place = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("place")
    at = lambda k, size: (k + 0.5) / (size + 1.0)
    return placed.select("id", "sub", "pulls", "n", "m", place).select(
        "id", "sub", "place", F.aggregate(F.coalesce("pulls", F.array().cast("array<struct<s:bigint,w:double>>")), F.lit(0.0), lambda t, p: t + p["w"] * F.abs(at(F.col("place"), F.col("n")) - at(p["s"], F.col("m")))).alias("cost")
    )


def order_layers(nodes: DataFrame, edges: DataFrame, weight: str = "weight", most: int = 500) -> DataFrame:
    """(id, layer_id, place): nodes of each layer after the first, put where their edges to the layer before are short.

    Of the nodes and places that are left, the node goes first whose highest and lowest cost, squared, differ most, to
    its cheapest place; of equals the first by layer_sub_id. A drawing has a row per node: costs are computed by Spark, and a layer of more
    than `most` nodes, whose table of costs would not be a drawing's, is an error.
    """
    spark = nodes.sparkSession
    sizes = {r["layer_id"]: r["n"] for r in nodes.groupBy("layer_id").agg(F.count("*").alias("n")).collect()}
    if any(n > most for n in sizes.values()):
        raise ValueError(f"a layer has more than {most} nodes")
    order: list[tuple] = []
    last: list[tuple] = []
    for k in sorted(sizes):
        own = [r["id"] for r in nodes.where(F.col("layer_id") == k).orderBy("layer_sub_id").select("id").collect()]
        now = [(i, k, p) for p, i in enumerate(own)]
        if last:
            table = spark.createDataFrame(last + now, f"id {nodes.schema['id'].dataType.simpleString()}, layer_id int, sub long").withColumn("layer_id", F.when(F.col("layer_id") == k, 1).otherwise(0))
            cost = np.zeros((len(own), len(own)))
            for r in layer_costs(table, edges, 1, weight).collect():
                cost[r["place"], r["sub"]] = r["cost"]
            now = [(own[n], k, p) for n, p in _assigned(cost)]
        order += now
        last = sorted(now, key=lambda x: x[2])
    return spark.createDataFrame(order, f"id {nodes.schema['id'].dataType.simpleString()}, layer_id int, place long")


def _assigned(cost: np.ndarray) -> list[tuple[int, int]]:
    """(node, place) of all nodes, from the costs by place and node."""
    free = np.ones(len(cost), dtype=bool)
    left = free.copy()
    out = []
    while left.any():
        c = np.where(free[:, None], cost, np.nan)[:, left]
        node = np.flatnonzero(left)[np.argmax(np.nanmax(c, axis=0) ** 2 - np.nanmin(c, axis=0) ** 2)]
        place = np.flatnonzero(free)[np.argmin(cost[free, node])]
        out.append((int(node), int(place)))
        left[node], free[place] = False, False
    return out


def positions(nodes: DataFrame, order: str = "layer_sub_id", direction: str = "right") -> DataFrame:
    """(id, x, y) on the unit square: layers along the direction, nodes of a layer evenly across it.

    Nodes are numbered by a range sort over layers and order; the numbers at which layers begin are a row per layer.
    """
    from lumenframe.operators.arrays import number_rows

    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {direction!r}")
    numbered = number_rows(nodes.select("id", "layer_id", F.col(order).alias("__order")), ["layer_id", "__order", "id"], "__at")
    layers = numbered.groupBy("layer_id").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    last = layers.agg(F.max("layer_id").alias("last"))
    along = F.when(F.col("last") > 0, F.col("layer_id") / F.col("last")).otherwise(0.5)
    across = (F.col("__at") - F.col("__first") + 0.5) / F.col("__n")
    along = along if direction in ("right", "up") else 1 - along
    x, y = (along, across) if direction in ("right", "left") else (across, along)
    return numbered.join(F.broadcast(layers), "layer_id").join(F.broadcast(last), how="cross").select("id", x.alias("x"), y.alias("y"))


def rotate(layout: DataFrame, degrees: float) -> DataFrame:
    """Positions turned about their centre."""
    mean = layout.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    return layout.join(F.broadcast(mean), how="cross").select("id", (dx * cos - dy * sin + F.col("mx")).alias("x"), (dx * sin + dy * cos + F.col("my")).alias("y"))


def rescale(layout: DataFrame, width: float, height: float, padding: tuple[float, float, float, float] = (0, 0, 0, 0)) -> DataFrame:
    """Positions brought to a canvas; padding is up, right, down, left as shares of it."""
    up, right, down, left = padding
    box = layout.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))

    def to(v: Column, lo: Column, hi: Column, size: float, before: float, behind: float) -> Column:
        return (F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(0.5) * (1 - before - behind) + before) * size

    x = to(F.col("x"), F.col("x0"), F.col("x1"), width, left, right)
    y = to(F.col("y"), F.col("y0"), F.col("y1"), height, down, up)
    return layout.join(F.broadcast(box), how="cross").select("id", x.alias("x"), y.alias("y"))


#: Factors of the largest scale without overlap and of the least, by distance; sizes by scale.
LARGEST, LEAST = 2.32, 0.20
NODE_SIZE, LINE_WIDTH, EDGE_WIDTH, FONT_SIZE = 0.0558, 0.0030, 0.0066, 0.1200


def node_scale(layout: DataFrame) -> DataFrame:
    """(scale, node_size, line_width, edge_width, font_size) from the least and mean pairwise distance of a drawing."""
    a = layout.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = layout.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    d = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    ends = a.join(b, F.col("a") < F.col("b")).agg((LARGEST * F.min(d)).alias("hi"), (LEAST * F.avg(d)).alias("lo"))
    scale = F.when(F.col("lo") > F.col("hi"), F.col("lo")).otherwise(F.col("lo") * (2 - F.col("lo") / F.col("hi")))
    s = F.col("scale")
    return ends.select(scale.alias("scale")).select(
        "scale", (NODE_SIZE * s * s).alias("node_size"), (LINE_WIDTH * s).alias("line_width"), (EDGE_WIDTH * s).alias("edge_width"), (FONT_SIZE * s).alias("font_size")
    )
