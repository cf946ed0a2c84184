"""Connected components over an edge table, without bringing edges or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickerwork.llm.shared import durable


def _digest(edges: DataFrame) -> tuple:
    """Number and hash sum of distinct edges; equal for equal tables."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the smallest node reachable.

    Each round links every node to the smallest node in its closed neighbourhood and then makes the neighbours
    point there (large star, small star); the edge count never grows and the rounds grow as the logarithm of the
    longest path. Aggregates are combined before the shuffle, so a hub's edges are not gathered in one task.
    Null ends are dropped; loops and repeated edges do no harm.
    """
    edges = durable(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .distinct()
    )
    state = _digest(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = durable(large.join(down, "a").select(F.explode(ends).alias("e")).select("e.*").where("a <> b").distinct())
        before, state = state, _digest(edges)
        if state == before:
            break
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(edges.select("b", "b")).distinct()
