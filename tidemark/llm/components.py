"""Connected components of an edge table, by alternating large-star and small-star steps.

The smallest neighbours are written before they are joined back, so that both sides of the join are plain shuffles and Spark can
split the one node that a very large component hangs on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.staging import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")), "low")
    return both.where("v > u").join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is tied to the smallest of them. Edges run from the larger to the smaller."""
    low = staged(edges.groupBy("u").agg(F.min("v").alias("low")), "low")
    tied = edges.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return tied.union(low.select("u", F.col("low").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node that has an edge in ``edges`` (u, v: integers); label is the component's smallest node.

    Each round is written to the shared folder. The number of rounds grows with the logarithm of the longest path; only two
    sums a round reach the driver.
    """
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            break
        seen = mark
        large = _large_star(now).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        now = staged(_small_star(staged(large, "edges")).distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
