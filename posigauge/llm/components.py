"""Connected components by alternating large-star and small-star steps.

Every step is a join and two aggregates on edges; nothing is collected but a
count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posigauge.session import materialize


def _lowest(pairs: DataFrame) -> DataFrame:
    """(u, low): the smallest of u and its neighbours."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the smallest node around u."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    tied = both.join(_lowest(both), "u").where("v > u")
    return tied.select(F.col("v").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    tied = down.join(_lowest(down), "u")
    rows = tied.select(F.col("v").alias("a"), F.col("low").alias("b")).unionByName(
        tied.select(F.col("u").alias("a"), F.col("low").alias("b"))
    )
    return rows.where("a != b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: longs); root is the smallest node of its component.

    Rounds go on until no edge changes; their number grows with the logarithm
    of the nodes. Each round is checkpointed, so lost executors cost one round.
    Nodes without an edge have no row. Null ends take no part.
    """
    edges = materialize(
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = None
    while True:
        state = edges.agg(
            F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("sum")
        ).first()
        if state == seen:
            break
        seen = state
        edges = materialize(_small_star(_large_star(edges)))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
