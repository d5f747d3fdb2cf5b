"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilcount.llm._scratch import Scratch


def _stars(pairs: DataFrame) -> bool:
    """Whether every component of (u, v), v < u, is a star around its smallest node."""
    ends = pairs.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(pairs.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp): comp is the smallest node of the component; nodes without an edge do not occur.

    edges: two bigint columns a, b.  A hub is never gathered: its smallest neighbour comes from partial
    aggregation and goes back by an equi-join.  Each step is written, so lost executors cost one step.
    """
    pairs = scratch.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    while not _stars(pairs):
        both = pairs.union(pairs.select(F.col("v"), F.col("u"))).toDF("u", "v")
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.toDF("u", "v")).where("u <> v").distinct()
        after = scratch.put(small, "star")
        scratch.drop(pairs)
        pairs = after
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(pairs.select(F.col("v"), F.col("v")).distinct()).toDF("node", "comp").distinct()
