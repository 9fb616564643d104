"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``edges``: (u, v) longs. Returns (u, root) for every vertex with an edge, ``root`` the
    smallest vertex of its component.

    Each step is an aggregation and a join of the links, written to the shared folder; the
    number of steps grows with the logarithm of the longest chain. Only a count and a checksum reach
    the driver.
    """
    state = stash(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "graph")
    mark = None
    for _ in range(most_rounds):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_of = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_of, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_of.withColumnRenamed("m", "v"))
        state = stash(small.where("u <> v").distinct(), "graph")
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"links not settled after {most_rounds} rounds")
    roots = state.select("u", F.col("v").alias("root"))
    return roots.unionByName(state.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
