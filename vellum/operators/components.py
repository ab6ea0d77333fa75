"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.plans.shared import written


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``node, component``: for ``edges(a, b)`` of one ordered type, each node's least reachable node.

    Loops, nulls and repeated edges are left out; no edges give no rows. Each
    round is two aggregations over the remaining edges, written to the shared
    folder; the number of rounds grows with the logarithm of the longest path.
    Nothing but a count comes to the driver. Every group is combined with
    ``min`` before its shuffle; large groups are never gathered in one task.
    """
    kind = edges.schema["a"].dataType.simpleString()
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "edges")
    last = None
    for _ in range(max_rounds):
        # large star: each larger neighbour of a node goes to the least node around it
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: each node and its smaller neighbours go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        step = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        e = written(step, "edges")
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots).select(F.col("node").cast(kind), F.col("component").cast(kind))
