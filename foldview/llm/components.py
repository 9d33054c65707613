"""Connected components by alternating large-star and small-star steps, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settled


def _large_star(edges: DataFrame) -> DataFrame:
    """Of each node, hang the larger neighbours on the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Of each node, hang it and its smaller neighbours on the smallest of them (edges have u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node that has a link, from links (a, b) of long ids."""
    spark = links.sparkSession
    edges = settled(spark, links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    before = mark(edges)
    for _ in range(rounds):
        old, edges = edges, settled(spark, _small_star(_large_star(edges)), "links")
        discard(spark, old)
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = settled(spark, nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    discard(spark, edges)
    return out
