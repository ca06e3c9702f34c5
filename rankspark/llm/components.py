"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node's larger (large star) or smaller-or-equal (small star) neighbours
    are linked to the smallest node around it. The smallest neighbour is an aggregate joined
    back, so a hub's links need not meet in one task."""
    around = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("m"))
    joined = around.join(least, around.a == least.node)
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of ``edges`` (a, b long).

    Each round is written to the shared folder, and only a yes or no comes to the driver: the
    loop ends when all links are stars, that is, every node has one link to a root.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    while _unsettled(edges):
        edges = materialize(_star(_star(edges, True), False), "links")
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _unsettled(edges: DataFrame) -> bool:
    """Whether some node has two links upwards or is itself linked to: then not all are stars."""
    seen = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    seen = seen.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    counts = seen.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not counts.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()
