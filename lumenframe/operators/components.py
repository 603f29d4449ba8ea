"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.storage import discard, materialize


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected edges (a, b); component is the smallest node that can be reached.

    Alternating large-star and small-star steps: every step is two shuffles of the edge list and the number of
    steps grows with the logarithm of the longest chain. The edge list is written to the shared folder after each
    step, so a lost executor costs one step. The hub of a large star is the key of a grouped minimum with partial
    aggregation and of a join that adaptive execution may split, never of a collected list.
    """
    e = edges.select("a", "b").where("a <> b")
    e = materialize(e.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "edges")
    last = None
    for _ in range(rounds):
        # large star: link each strictly larger neighbour of u to the smallest of u and its neighbours
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: link u and its smaller neighbours to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        used, e = e, materialize(small, "edges")
        discard(used)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = materialize(
        e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components"
    )
    discard(e)
    return out
