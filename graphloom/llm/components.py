"""Connected components of a graph that no single machine holds: alternating large-star and small-star rounds.

Each round is two aggregations by node with joins on the node. The least neighbour of a node with very many neighbours is sent to all tasks, as such nodes are few, so that its
neighbours are not one task. Rounds end when the edges are stars around least nodes, after a number of rounds that grows with the logarithm of the longest path. The edges are written to
the shared folder after every round, and those of the round before deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, few, written

#: Neighbours from which a node is not joined by shuffling.
MANY = 4096


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (u, v) with u > v: links neighbours to the least node around them. Edges may be repeated.

    Large: each node's larger neighbours go to its least neighbour (or itself). Small: its smaller neighbours and itself do.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    # Looked up the same way for both parts, so that they share one broadcast.
    looked = both.join(F.broadcast(least.where(F.col("n") > MANY).select("u", "m")), "u", "left")
    rest = looked.where("m is null").drop("m").join(least.where(F.col("n") <= MANY).select("u", "m"), "u")
    linked = looked.where("m is not null").unionByName(rest)
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one lesser neighbour, which has none, or none: then a round changes nothing."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select("v", F.lit(0), F.lit(1)).toDF("node", "up", "down"))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0] == 0


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: any order, repeats and loops allowed; about ``rows``, if known); component: its least node.

    Nulls are no nodes. A node that only has loops is not returned.
    """
    u, v = F.greatest("u", "v"), F.least("u", "v")
    now = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).select(u.alias("u"), v.alias("v")).distinct()
    now = written(few(now, rows), "edges")
    while not _are_stars(now):
        before, now = now, written(few(_star(_star(now, True), False).distinct(), rows), "edges")
        dropped(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select("v", "v").distinct().toDF("node", "component"))
