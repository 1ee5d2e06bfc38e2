"""Connected components by alternating large-star and small-star steps, each a join and a grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long) that isn't the smallest of its component.

    Nulls and self-loops are ignored. Every step's edges are written to the shared folder, so lineage stays short, and those of the
    step before are removed; only a count and a checksum of the edges reach the driver, which stops once a step changes nothing.
    """
    keep = Scratch(edges.sparkSession)
    edges = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a <> b").distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, keep = keep, Scratch(edges.sparkSession)
        edges = keep(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        last.clear()
        mark, before = _mark(edges), mark
        if mark == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
