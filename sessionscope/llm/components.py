"""Connected components of a graph of links, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, read_table, write_table

MOST_ROUNDS = 60


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node, component``: the smallest node reachable from each node that has a link.

    Each round lets a node hand its smallest neighbour first to its larger neighbours, then
    to its smaller ones, until every component is a star around its smallest node; the
    number of rounds grows with the logarithm of the longest path. A round is written to the
    shared folder, so plans stay short and a lost executor costs one round at most. Minima
    are combined before the shuffle and joined back, so a node with very many links is
    split like any skewed join. Nodes are longs; links with a null end or to themselves
    link nothing.
    """
    spark = links.sparkSession
    edges = (
        links.filter(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .distinct()
    )
    path = write_table(edges, "links")
    seen = None
    for _ in range(MOST_ROUNDS):
        now = read_table(edges, path)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen, previous = state, path
        path = write_table(_round(now), "links")
        drop_table(spark, previous)
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    stars = read_table(edges, path)
    centres = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(centres)


def _round(edges: DataFrame) -> DataFrame:
    """One pass over larger, one over smaller neighbours; rows are (a, b) with a > b."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min("b").alias("m"))
    larger = (
        both.join(lowest, "a")
        .filter("b > a")
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        .distinct()
    )
    floor = larger.groupBy("a").agg(F.min("b").alias("m"))
    handed = larger.join(floor, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return handed.unionAll(floor.select("a", F.col("m").alias("b"))).distinct()
