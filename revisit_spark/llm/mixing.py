"""Operator 2: mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies: its source's target over its source's
size. The expected copies are summed along the source, largest document first; one offset per source
is added; a document is emitted once for each integer that its part of the sum crosses. After any
number of documents the copies so far differ from the expected ones by less than one, so in this order
the words taken differ from the target by less than the source's largest document.

The sum needs no task that holds a source: rows are range-partitioned by (source, size, id), a
row's rank is its place within its partition plus what earlier partitions have of its source, and
only those counts per partition (at most partitions + sources of them) go through one small window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, free_name, saved

#: Weights of the sources in code point order, repeating; null is the last source.
WEIGHTS = (5, 2, 1)
#: A document's expected copies are counted in units of 2**-26.
UNIT = 1 << 26


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(SPACE_WORD))).cast("long")


def source_offset(source: Column, seed: int) -> Column:
    """The source's one offset, 0 to UNIT - 1, by its name and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % UNIT


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """Adds ``target`` to a table of one row per (_source, source_size).

    All targets are ``percent`` of all sizes, shared by weight; a target stops at ``most`` times its
    source's size and the excess is shared by weight among the others until none is above. In order
    of (most * size / weight) the sources that stop are the first ones, so the shared factor is found
    from running sums, without repeating. One row per source goes through one task.
    """
    if percent > 100 * most:
        raise ValueError("the targets can't share more than the most that all sources may give")
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    ranked = sizes.withColumn("_n", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") % len(weights) + 1).cast("int")).cast("long")
    cap = (F.col("source_size") * most).cast("long")
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", cap).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    everything = Window.partitionBy()
    before = Window.orderBy("_ratio", "_n").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) * percent - F.coalesce(F.sum("_cap").over(before), F.lit(0)) * 100
    open_weight = (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))) * 100
    ranked = ranked.withColumn("_rest", rest).withColumn("_open", open_weight)
    # The first source that isn't stopped has the factor that it and all after it get.
    stopped = F.col("_rest").cast("double") >= F.col("_ratio") * F.col("_open")
    ranked = ranked.withColumn("_stop", stopped)
    first = F.min(F.when(~F.col("_stop"), F.struct("_ratio", "_n", "_rest", "_open"))).over(everything)
    ranked = ranked.withColumn("_first", first)
    share = (F.col("_first._rest") * F.col("_w")).cast("double") / F.col("_first._open").cast("double")
    target = F.when(F.col("_stop"), F.col("_cap").cast("double")).otherwise(share)
    return ranked.select("_source", "source_size", target.alias("target"))


def copies(docs: DataFrame, source: str = "source", size: str = "size", order: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2, seed: int = 0) -> DataFrame:
    """``docs`` with source_size (long), target (double) and copies (long), whatever columns it has.

    ``size`` names a column of whole numbers, null counts as 0. Null is a source of its own. Ties in
    (source, size, ``order``) are broken by the row's other simple columns, rows equal in all of them
    are interchangeable. A null ``order`` sorts first. A source of size 0 has target 0 and gives no
    copies; an empty table stays empty. Where ``docs`` has a column of such a name already, the new
    one gets underscores before it (see ``result_names``).
    """
    key, n = docs[source].cast("string"), F.coalesce(docs[size].cast("long"), F.lit(0))
    simple = [c for c, kind in docs.dtypes if c not in (source, size, order) and not kind.startswith(("map", "array", "struct", "variant"))]
    # All of a row travels as one column, so that none of its names can clash with those made here.
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), key.alias("source"), n.alias("size"), docs[order].alias("order"))
    largest_first = ["source", F.desc("size"), "order"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = packed.repartitionByRange(parts, *largest_first).sortWithinPartitions(*largest_first, *(F.col("row").getField(c) for c in simple)).drop("order")
    rows = saved(rows.withColumn("at", F.monotonically_increasing_id()), "mix")
    rows = rows.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = saved(rows.groupBy("source", "part").agg(F.count("*").alias("rows"), F.sum("size").alias("words"), F.min("at").alias("low")), "mix-counts")
    sizes = counts.groupBy(F.col("source").alias("_source")).agg(F.sum("words").alias("source_size"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("source").alias("_from"), F.col("part").alias("_part"), (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("low")).alias("shift"))
    plan = before.join(targets(sizes, weights, percent, most), F.col("_from").eqNullSafe(F.col("_source"))).drop("_source")
    joined = rows.join(plan, rows["part"].eqNullSafe(plan["_part"]) & rows["source"].eqNullSafe(plan["_from"]))
    step = F.when(F.col("source_size") > 0, F.floor(F.col("target") * UNIT / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    k = F.col("at") + F.col("shift")
    offset = source_offset(F.col("source"), seed)
    crossed = F.shiftright((k + 1) * step + offset, 26) - F.shiftright(k * step + offset, 26)
    made = dict(zip(result_names(docs), (F.col("source_size"), F.col("target"), crossed.cast("long")), strict=True))
    return joined.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), *(c.alias(name) for name, c in made.items()))


def result_names(docs: DataFrame) -> tuple[str, str, str]:
    """Names that ``copies`` gives to source_size, target and copies beside the columns of ``docs``."""
    return tuple(free_name(docs, c) for c in ("source_size", "target", "copies"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", order: str = "doc_id", **kinds) -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as it is taken, with the columns of ``docs``.

    A document's size is its number of words (null text: 0). See ``copies`` for the rest.
    """
    size = free_name(docs, "_words_of_text")
    sized = docs.withColumn(size, word_count(docs[text].cast("string")))
    times = F.col(result_names(sized)[2])
    taken = copies(sized, source, size, order, **kinds).where(times > 0)
    return taken.withColumn(free_name(taken, "_again"), F.explode(F.sequence(F.lit(1), times.cast("int")))).select(*docs.columns)
