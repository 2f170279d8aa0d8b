"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import written


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges`` (``a, b``, longs).

    Each step hangs all neighbours of a node below the smallest one, first the larger neighbours,
    then the smaller ones, until all components are stars; steps needed grow with the logarithm of a
    component's diameter. A node with very many neighbours is a hot left key of a join, which
    adaptive execution splits, and neighbours are never gathered. Each step is written, as the next
    one reads it twice. Self links are ignored; no edges give no rows.
    """
    now = written(_oriented(edges), label)
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        now = written(_oriented(small.select("e.a", F.col("e.m").alias("b"))), label)
    roots = now.select(F.col("b").alias("a")).distinct()
    return now.unionByName(roots.withColumn("b", F.col("a"))).toDF("node", "component")


def _oriented(edges: DataFrame) -> DataFrame:
    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    return edges.filter("a <> b").select(larger.alias("a"), smaller.alias("b")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs below one other at most, and nothing hangs below that node then."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("up")), F.struct(F.col("b").alias("x"), F.lit(0).alias("up")))).alias("e"))
    nodes = ends.select("e.*").groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return nodes.filter("up > 1 OR (up = 1 AND least = 0)").isEmpty()
