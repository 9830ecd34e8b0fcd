"""Connected components by alternating large-star and small-star steps.

Nothing is collected: every step is a partial aggregation (smallest
neighbour of each node) and a join, written to the shared folder. A hub with
very many neighbours is one hot join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, root)`` for every node that has an edge; root is the smallest node.

    Self loops and repeated edges are allowed, null ends are dropped, and an
    empty input gives an empty result. It goes on until a round changes nothing.
    """
    tables = Tables(edges.sparkSession, "components")
    edges = tables.write(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "start",
    )
    before = _state(edges)
    while before[0]:
        # large star: every larger neighbour of a node moves to the node's smallest neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = tables.write(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = tables.write(large.distinct(), "large")
        tables.drop(least, edges)
        # small star: every smaller neighbour and the node itself move to the smallest of them
        least = tables.write(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = tables.write(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), "small")
        tables.drop(least, large)
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
