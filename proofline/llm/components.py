"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.session import cut


def _digest(edges: DataFrame) -> tuple:
    """Number of edges and two sums over their hashes: equal for equal sets of edges."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.xxhash64("v", "u", F.lit(1)).cast("decimal(20,0)"))).first())


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; a component is named by its smallest node.

    ``edges`` has two columns of one orderable type. A round replaces each node's edges by edges to its smallest
    neighbour: first those to larger nodes, then those to smaller ones. Minima are combined before the shuffle and the
    rest are joins, so a node with any number of edges is no single group. Each round is written down; rounds grow with
    the logarithm of a component's size.
    """
    a, b = edges.columns
    now = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    seen = _digest(now)
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours of u go to u's smallest
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of those
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = cut(small.distinct(), "components")
        seen, before = _digest(after), seen
        now = after
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
