"""Connected components by alternating large-star and small-star steps, and the smallest label of each component.

Every step is a grouped minimum and a join, so nothing is gathered in one place, and each round is cut at the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour or itself."""
    around = _both(edges)
    low = around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return around.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them. In edges a < b."""
    low = edges.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("u"), "m")
    moved = edges.join(low, F.col("b") == F.col("u")).select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b")
    return moved.unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b: every node b of a component but its smallest node a. Rounds go on until none changes anything; their number
    grows with the logarithm of the longest way in a component."""
    edges, before = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges
        last = edges
        before, edges = now, cut(_small_star(_large_star(edges)))
        drop(last)


def smallest_reachable(edges: DataFrame, nodes: DataFrame, starred: bool = False) -> DataFrame:
    """nodes (node, low) with low replaced by the smallest low of the node's component. starred: edges come from stars()."""
    roots = edges if starred else stars(edges)
    rooted = nodes.join(roots.select("a", F.col("b").alias("node")), "node", "left").select("node", F.coalesce("a", "node").alias("root"), "low")
    lows = rooted.where("root <> node").groupBy("root").agg(F.min("low").alias("m"))
    at_root = nodes.join(lows, F.col("node") == F.col("root")).select("root", F.least("low", "m").alias("m"))
    return rooted.join(at_root, "root", "left").select("node", F.coalesce("m", "low").alias("low"))
