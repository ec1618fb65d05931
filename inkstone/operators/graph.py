"""Connected components over edge tables, by alternating large and small stars.

Each round is two equi-joins and two aggregations with map-side minima; a node that many edges
share is spread by Spark's skew handling, and no neighbour list is gathered. Rounds end when the
edges no longer change; the number of rounds grows with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.session import durable


def _least(edges: DataFrame, node: str, other: str) -> DataFrame:
    return edges.groupBy(F.col(node).alias("node")).agg(F.min(other).alias("least"))


def components(edges: DataFrame, small: str = "a", large: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, component`` (the least node reachable) for every node that an edge has.

    Edges may repeat and have either order; loops are kept as single nodes; null ends are ignored.
    """
    e = edges.select(F.least(small, large).alias("a"), F.greatest(small, large).alias("b")).where(f"{small} is not null and {large} is not null")
    alone = e.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    e = durable(e.where("a < b").distinct())
    before = None
    for _ in range(max_rounds):
        # large star: each neighbour above a node goes to the least of the node's neighbourhood
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both, "a", "b").withColumn("least", F.least("node", "least"))
        e = both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("least").alias("a"), "b").distinct()
        # small star: a node and its lesser neighbours go to the least of these
        least = _least(e, "b", "a")
        e = (
            e.join(least, F.col("b") == F.col("node"))
            .select(F.col("least").alias("a"), F.explode(F.array("a", "b")).alias("b"))
            .where("a < b")
            .distinct()
        )
        e = durable(e)
        now = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    found = e.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return found.unionAll(roots).unionAll(alone).groupBy("node").agg(F.min("component").alias("component"))
