"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a shuffle on a node with partial aggregation; nothing is gathered per component, and a component of any size
takes a number of rounds that grows with the logarithm of its diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u, v with u != v.  Large: each larger neighbour of a node links to the smallest of node and neighbours.
    Small: so do the node and its smaller neighbours."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(least.select("u", F.col("low").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links: u, v of one ordered type, nulls not allowed.  Returns node, component (the smallest node reachable) for
    every node of a link between two different nodes.  An empty table gives an empty result."""
    edges = materialize(links.select("u", "v").where("u <> v").distinct(), "links")
    for _ in range(max_rounds):
        following = materialize(_star(_star(edges, True), False), "links")
        # a star forest is a fixed point: the same rows again
        same = [f.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for f in (edges, following)]
        release(edges)
        edges = following
        if tuple(same[0]) == tuple(same[1]):
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
