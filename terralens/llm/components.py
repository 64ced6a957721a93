"""Connected components of a table of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import functions as F

from .shared import settled, written


def _stars(edges):
    """Whether every node is linked with one smaller node that is linked with no smaller one itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    seen = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return seen.where("ups > 1 OR (ups = 1 AND least = 0)").agg(F.count(F.lit(1)).alias("n")).first()["n"] == 0


def _large(edges):
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small(edges):
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges):
    """(node, root) for every node of ``edges`` (a, b) but the roots, the smallest node of each component.

    Links from a node to itself and repeated links change nothing. Each round is written to the shared folder, so the
    lineage stays short; the number of rounds grows with the logarithm of the longest path, and none is run on links
    that are stars already, which a round leaves as they are.
    """
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(pairs, "links")
    while not _stars(now):
        now = written(_small(_large(now)), "links")
    settled(edges.sparkSession)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
