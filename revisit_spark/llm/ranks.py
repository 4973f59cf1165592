"""Places of rows in an order, for tables of any size and groups of any share of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, saved


def ranked(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` (from 0, within their ``group``) and ``size`` (rows of the group), both long.

    Rows are dealt by ranges of (group, order), so a large group lies over many tasks. A row's rank is its
    place among its partition's rows of the group, and the rows of the group in partitions before: a prefix
    sum over one row for each partition and group. ``group`` must not be null; the order should be total,
    or else ties are in any order. An empty table stays empty.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    at = F.monotonically_increasing_id()
    placed = saved(dealt.select("*", F.shiftright(at, 33).alias("_piece"), at.alias("_at")), "placed")
    pieces = placed.groupBy(group, "_piece").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select(group, "_piece", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("size"))
    out = saved(placed.join(pieces, [group, "_piece"]).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("rank"), "size"), "ranked")
    forget(placed)
    return out
