"""Connected components of an edge table, by alternating stars.

Large-star hangs every larger neighbour of a node on the node's smallest
neighbour, small-star does so with its smaller ones; in the end every node hangs
on the smallest id of its component. Edges stay in tables: sums run before each
shuffle, and joins on a node with very many edges can be split by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.store import discard, settle


def _stars(edges: DataFrame) -> DataFrame:
    """One round of large-star, then small-star, on edges (u, v) with v < u."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("u", "m").alias("m"))
    large = both.join(least, F.col("u") == F.col("at")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = settle(large.distinct(), "large-star", thin=True)
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(least.select(F.col("u").alias("at"), "m"), F.col("u") == F.col("at")).filter("v > m")
    small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out = settle(small.distinct(), "small-star", thin=True)
    discard(large)
    return out


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one centre only, and no centre on another one."""
    leaves, links = edges.agg(F.count_distinct("u"), F.count("*")).first()
    return leaves == links and edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) of every node that has an edge to another one.

    Null ends and loops are no edges; repeated edges count once. An empty edge
    table gives an empty table.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("x"), F.col(b).alias("y"))
    now = settle(pairs.filter("x is not null and y is not null and u <> v").select("u", "v").distinct(), "edges", thin=True)
    while not _settled(now):
        following = _stars(now)
        discard(now)
        now = following
    centres = now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return settle(now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(centres), "components", thin=True)
