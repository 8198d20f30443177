"""Connected components of an edge table, by alternating star contractions on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import join_by_weight, stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large(edges: DataFrame) -> DataFrame:
    """Every node joins its larger neighbours to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "component-least")
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    joined = join_by_weight(both.filter("b > a"), least, ["a"], "n", total, how="inner")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node joins its smaller neighbours and itself to the smallest of them."""
    least = stored(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "component-least")
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    joined = join_by_weight(edges, least, ["a"], "n", total, how="inner")
    moved = joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node that has an edge to a smaller one; the component is its smallest node.

    ``edges`` has long columns ``a`` and ``b`` in any order; loops and repeated edges change nothing.
    Smallest nodes themselves have no row.
    """
    pairs = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(pairs, "component-edges")
    before = _state(edges)
    while before[0]:
        edges = stored(_small(stored(_large(edges), "component-large")), "component-edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
