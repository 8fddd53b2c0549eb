"""Connected components of a graph given as pairs, by large-star and small-star steps.

Only minima and joins: no neighbourhood is ever collected, so a node with millions of
links costs no task more than its share (adaptive execution splits the joins).  Each
round is written to the shared folder; the number of rounds grows with the logarithm of
the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from satchel.plans.session import stage


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or other) neighbours to its smallest neighbour."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = both.join(least, "u")
    if large:
        linked = moved.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        linked = moved.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return linked.where("a < b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``pairs(a, b)``; root is the smallest node it reaches.

    Repeated pairs, loops and either order are allowed.  No pairs: no rows.
    """
    now = stage(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        now = stage(_star(stage(_star(now, True), "links"), False), "links")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
