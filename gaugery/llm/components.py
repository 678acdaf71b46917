"""Connected components of an undirected graph by alternating large-star and small-star steps.

Each step is a partial aggregation (the least neighbour of each node) and a join, so no node's neighbourhood is ever
collected; a node with a large share of the links is met through `join_groups`. Every round is written to the shared
scratch folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugery.llm.common import join_groups, materialise

MOST_ROUNDS = 100


def _least(edges: DataFrame, node: str, other: str) -> DataFrame:
    return edges.groupBy(node).agg(F.min(other).alias("least"), F.count(F.lit(1)).alias("n"))


def _large(edges: DataFrame) -> DataFrame:
    """a > b: every a moves to the least neighbour of b, b included."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both.withColumnsRenamed({"a": "u", "b": "v"}), "u", "v").select(F.col("u").alias("b"), F.least("u", "least").alias("m"), "n")
    return join_groups(edges, least, ["b"], "n", F.col("a")).select("a", F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a moves to the least of them, and so does a."""
    least = _least(edges, "a", "b").select("a", F.col("least").alias("m"), "n")
    moved = join_groups(edges, least, ["a"], "n", F.col("b"))
    return moved.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Every node has one way down and ends there: no node with two, and none with ways both down and up."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or (down = 1 and up = 1)").isEmpty()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """One row per linked node: node and component, the least node that it reaches. Self-links and nulls are ignored."""
    edges = links.filter(F.col(left) != F.col(right)).select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).distinct()
    edges = materialise(edges, "links")
    for _ in range(MOST_ROUNDS):
        if _settled(edges):
            break
        edges = materialise(_small(_large(edges)), "links")
    else:
        raise RuntimeError(f"components have not settled in {MOST_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
