"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step groups by one end with a minimum (combined before the shuffle) and joins it back (one row per
node on one side, so a node of many edges is split by adaptive execution). Every round's edges are written to the
shared folder. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import drop_scratch, scratch


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def components(edges: DataFrame) -> DataFrame:
    """a, b (long, undirected) -> node, component (its smallest node); nodes without edges don't appear."""
    spark = edges.sparkSession
    now = scratch(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    state = _state(now)
    while state[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # edges that lead to a smaller node and are the smallest of their own stay
        large = scratch(large.unionAll(least.where("m < a").select("a", F.col("m").alias("b"))).distinct(), "cc-large")  # read twice
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionAll(least.select("a", F.col("m").alias("b"))).distinct()
        after = scratch(small, "cc-edges")
        drop_scratch(spark, now, large)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b"), F.col("b"))).distinct()
