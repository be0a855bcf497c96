"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm._common import checkpoint


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): each node points its larger (or not larger) neighbours, and itself, to its least neighbour."""
    least = checkpoint(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    # A plain exchange on either side: a hub's rows can be split.
    joined = edges.join(least.hint("merge"), "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.where("m != u").select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all nodes of the edges but the least of each component; component: its least node.

    Edges may repeat, point either way or join a node with itself. No edges give no rows. Rounds go on until nothing
    changes: their number grows with the logarithm of the nodes.
    """
    now = checkpoint(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = checkpoint(_star(both, True).distinct())
        now = checkpoint(_star(large, False).distinct())
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            break
        before = state
    return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
