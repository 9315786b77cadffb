"""Connected components of a graph given as edges, by alternating large and small stars.

Every round is two aggregations by node and two joins; what a round leaves is
written in the shared folder. Nothing but two numbers a round reaches the driver.
A hub's edges meet one row of its own in the join, so they may be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. Links each neighbour to its node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "star-least")
    joined = both.join(least, "u")
    if large:  # (v, m) for the neighbours v above u
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # (v, m) for the neighbours below u, and (u, m)
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: long columns a, b. Returns node, root for every node of an edge; root is the component's smallest."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "star-edges")
    state = None
    while True:
        after = written(_star(written(_star(now, True), "star-large"), False), "star-small")
        new = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == state or not new[0]:
            break
        now, state = after, new
    roots = after.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
