"""Connected components of a table of links, by alternating stars, all of it in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved


def _pairs(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) with a > b; loops and nulls are left out."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): for each end of a link (a, b), the smallest end that it reaches, itself included.

    Rounds hang each node's larger neighbours, then its smaller ones, under the smallest node that it
    knows, until every node hangs under its component's smallest. Smallest neighbours are found by an
    aggregation that sums up before it shuffles, so a node with very many links needs no task of its own.
    Ids that no link has are not in the result.
    """
    edges = saved(_pairs(edges), "links")
    known = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = edges.join(least, edges["b"] == least["u"]).select("a", F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        joined = large.join(low, large["a"] == low["u"])
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        before, edges = edges, saved(_pairs(small), "links")
        forget(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == known:
            break
        known = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
