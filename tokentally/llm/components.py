"""Connected components by alternating large-star and small-star steps, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.llm.shared import drop_scratch, materialize


def _least(edges: DataFrame) -> DataFrame:
    """u and the smallest of u and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of ``edges`` (a, b: long).

    Large-star ties a node's larger neighbours to the smallest node around it,
    small-star does so with the smaller ones; both keep the components, and a
    graph of stars is their only fixed point.  Each round is two aggregations,
    whose partial sums make light of hot nodes, and joins that adaptive execution can
    split.  No edges give no rows.
    """
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        new = materialize(small, "edges")
        sums = [d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first() for d in (now, new)] if before is None else [before, new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()]
        drop_scratch(now.sparkSession, now)
        now = new
        if sums[0] == sums[1]:
            break
        before = sums[1]
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
