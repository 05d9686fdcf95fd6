"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. Edges (a, b) with b < a come back as edges to the smallest neighbour.

    Large: every larger neighbour of a node is tied to the smallest of the node and its neighbours.
    Small: every smaller neighbour and the node itself are tied to the smallest of them.
    The smallest neighbour is an aggregate with partial sums, and ties are made by a join that may
    be split, so a hub with many edges is no task of its own.
    """
    if large:
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        tied = ways.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("low"))
        across = edges.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        tied = across.unionByName(least.select("a", F.col("low").alias("b")))
    return tied.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is reachable, for every node with an edge.

    edges has long columns a and b; direction, loops and repeats do not matter. Each round is written
    to the shared folder, so a lost executor never costs more than the round.
    """
    one_way = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(one_way, "edges")
    state = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen["n"] == 0 or (seen["n"], seen["h"]) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        state = (seen["n"], seen["h"])
        after = materialise(_stars(_stars(now, True), False), "edges")
        discard(now)
        now = after
