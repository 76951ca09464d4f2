"""Connected components by alternating large-star and small-star rounds, all in DataFrame operations.

Edges live in the shared checkpoint folder between rounds; the driver sees only two counts a round. Group minima are
partial aggregates, so a hub's rows are reduced before the shuffle, and the join back to the rows is one that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    moved = down.join(least, F.col("u") == F.col("k")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select(F.col("k").alias("u"), F.col("m").alias("v")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the edges (u, v); component is the least node that it is linked with.

    Rows with a null end and loops say nothing and are dropped; repeated edges count once; no edges give an empty table."""
    edges = edges.select("u", "v").where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        shape = edges.agg(F.count("*").alias("n"), F.count_distinct("u").alias("us"))
        # a forest of stars: every node points once, and to a node that points nowhere
        n, us = shape.first()
        if n == us and edges.join(edges.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        edges = _large(edges).where("u <> v").distinct()
        edges = cut(_small(edges).where("u <> v").distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
