"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.scratch import save


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("b", "a").toDF("a", "b"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour (or to the node itself)."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. ``a`` is the larger end of an edge."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.toDF("a", "b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")),
    ).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component_id) for every node that has an edge: the smallest node that edges lead to.

    Edges with a null end or two equal ends say nothing; repeated and reversed edges count once. An empty table
    gives an empty one. Alternates large-star and small-star steps until the edges stop changing: every step is a
    combined minimum per node and a join, so a hub with millions of neighbours is one row of the minimum. Each
    round is written to the shared folder, which cuts the lineage.
    """
    ends = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    now = save(ends.where("_a IS NOT NULL AND _b IS NOT NULL AND a <> b").select("a", "b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = save(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    # every node now points to the smallest node of its component
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component_id")).distinct()
    return now.toDF("node", "component_id").union(roots)
