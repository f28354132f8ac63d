"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of (a, b): the least node that it reaches. Large and small stars alternate: each node's
    neighbours are linked to the least of them, first the larger ones, then the smaller ones, until nothing changes. Every round's
    edges are written to the shared folder, so no lineage grows and a lost executor costs one round at most."""
    spark = edges.sparkSession
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    links = blocks.stored(spark, links)
    state = None
    while True:
        both = links.select(F.col("high").alias("u"), F.col("low").alias("v")).union(links.select(F.col("low").alias("u"), F.col("high").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("high"), F.col("m").alias("low")).filter("high <> low").distinct()
        top = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(top, "high").select(F.col("low").alias("high"), F.col("m").alias("low")).filter("high <> low")
        before, links = links, blocks.stored(spark, small.union(top.select("high", F.col("m").alias("low"))).distinct())
        blocks.drop(before)
        now = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("high", "low")).alias("h")).first()
        if now == state:
            break
        state = now
    return links.select(F.col("high").alias("node"), F.col("low").alias("component")).union(links.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
