"""Operator 4: benchmark decontamination by a prefix-filtered set join.

An item gives windows of its words; a window is contained in a document where all its shingles are,
in their order. Shingles are ordered by how often the documents have them, and as all of a window's
shingles are needed, its necessary prefix is the rarest one alone. Documents are joined with windows
on that one; where the shingle stands bounds where the window begins, it must lie within the text,
and the words there are compared exactly.

Documents are read twice: to count the items' shingles, and to find the prefix shingles. Both
passes let only hashes through that a bitmap has, so that what is shuffled follows
the number of matches, not of words. Windows are joined by Spark, hence items may be any number;
windows of several items are joined once, by a key of their list of items.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import bitmap, bits_for, cell, member, without
from .common import ALNUM_WORD, in_arrow, saved, text_key
from .words import ALNUM, grams, pieces, words

WINDOW, SHINGLE = 10, 3
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def item_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit(ALNUM_WORD), F.lit(0))


def item_windows(items: DataFrame, window: int = WINDOW, text: str = "text", id_col: str = "item_id") -> DataFrame:
    """(item, content, size): each distinct window of each item; an item of fewer words is one window."""
    parted = items.select(F.coalesce(items[id_col].cast("string"), F.lit("")).alias("item"), item_words(items[text].cast("string")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    windows = parted.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("w"))
    return windows.select("item", F.array_join("w", " ").alias("content"), F.size("w").alias("size")).distinct()


def _window_shingles(contents: DataFrame, shingle: int) -> DataFrame:
    """(content, size, shift, n, h): every shingle of each window; all of it where it is shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "content"):
            w = words(batch.column("content"), ALNUM)
            counts = w.counts
            for n in range(1, shingle + 1):
                h, ok = grams(w, n)
                ok &= np.repeat(np.minimum(counts, shingle) == n, counts)
                at = np.flatnonzero(ok)
                of = np.repeat(np.arange(len(counts)), counts)[at]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("content").take(pa.array(of)), batch.column("size").take(pa.array(of)), pa.array((at - w.at[of]).astype(np.int32)), pa.array(np.full(len(at), n, np.int32)), pa.array(h[at].view(np.int64))],
                    names=["content", "size", "shift", "n", "h"],
                )

    return in_arrow(contents, run, "content string, size int, shift int, n int, h long")


def _counted(docs: DataFrame, lengths: list[int], wanted) -> DataFrame:
    """(h, seen): how often the documents have each wanted shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            w = words(batch.column("_text"), ALNUM)
            for n in lengths:
                h, ok = grams(w, n)
                found, times = np.unique(h[ok & member(wanted.value, h)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times.astype(np.int64))], names=["h", "seen"])

    return in_arrow(docs.select("_text"), run, "h long, seen long").groupBy("h").agg(F.sum("seen").alias("seen"))


def _found(docs: DataFrame, lengths: list[int], wanted, window: int) -> DataFrame:
    """A row for each document (h is null), and one for each place of a wanted shingle with the words around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            w = words(batch.column("_text"), ALNUM)
            counts = w.counts
            places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for n in lengths:
                h, ok = grams(w, n)
                at = np.flatnonzero(ok & member(wanted.value, h))
                places.append(at)
                hashes.append(h[at].view(np.int64))
            at, h = np.concatenate(places), np.concatenate(hashes)
            of = np.searchsorted(w.at, at, side="right") - 1
            low, high = np.maximum(at - window + 1, w.at[of]), np.minimum(at + window, w.at[of + 1])
            raw = w.data.tobytes().translate(_LOWER) if len(at) else b""
            around = [b" ".join(raw[b:e] for b, e in zip(w.begin[a:z].tolist(), w.end[a:z].tolist(), strict=True)) for a, z in zip(low.tolist(), high.tolist(), strict=True)]
            d, k = batch.num_rows, len(at)
            rows = pa.concat_arrays([pa.array(np.arange(d)), pa.array(of)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_row").take(rows), batch.column("_id").take(rows),
                    pa.concat_arrays([pa.array(counts.astype(np.int64)), pa.nulls(k, pa.int64())]),
                    pa.concat_arrays([pa.nulls(d, pa.int64()), pa.array(h)]),
                    pa.concat_arrays([pa.nulls(d, pa.int64()), pa.array((at - w.at[of]).astype(np.int64))]),
                    pa.concat_arrays([pa.nulls(d, pa.int64()), pa.array((low - w.at[of]).astype(np.int64))]),
                    pa.concat_arrays([pa.nulls(d, pa.string()), pa.array(around, pa.string())]),
                ],
                names=["_row", "_id", "n_words", "h", "at", "low", "around"],
            )

    kind = docs.schema["_id"].dataType.simpleString()
    return in_arrow(docs, run, f"_row long, _id {kind}, n_words long, h long, at long, low long, around string")


def _item_lists(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(content, items_key) and (items_key, items): the sorted items of each window, written once for all windows with the same."""
    listed = windows.groupBy("content").agg(F.array_sort(F.collect_set("item")).alias("items"))
    # Each id with its length, so that different lists don't read alike.
    exact = F.array_join(F.transform("items", lambda x: F.concat(F.octet_length(x), F.lit(":"), x)), "")
    listed = saved(listed.withColumn("items_key", text_key(exact)), "listed")
    return listed.select("content", "items_key"), listed.groupBy("items_key").agg(F.first("items").alias("items"))


def _hits(docs: DataFrame, windows: DataFrame, named: DataFrame | None, window: int, shingle: int, text: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(_row, id, n_words) of all documents, and (_row, id, start, size, ..) of the places of windows, whatever their items.

    A hit has its window's ``content`` or, with ``named`` (content, and others), these other columns instead.
    """
    spark = docs.sparkSession
    shingles = saved(_window_shingles(windows.select("content", "size").distinct(), shingle), "shingles")
    lengths = sorted(r["n"] for r in shingles.select("n").distinct().collect())
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), docs[id_col].alias("_id"), docs[text].cast("string").alias("_text"))
    bits = bits_for(shingles.count())
    every = spark.sparkContext.broadcast(bitmap(shingles.select(cell(F.col("h"), bits)), bits))
    seen = _counted(rows, lengths, every)
    rarest = F.min(F.struct("seen", "h", "shift", "n")).alias("r")
    # A shingle that no document has rules its window out: the join below is an inner one for counts of one up,
    # and a window with any unseen shingle is dropped.
    ordered = shingles.join(seen, "h", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    prefix = ordered.groupBy("content", "size").agg(rarest).where("r.seen > 0").select("content", "size", "r.h", "r.shift")
    known = ["content"] if named is None else [c for c in named.columns if c != "content"]
    prefix = saved(prefix if named is None else prefix.join(named, "content"), "prefix")
    prefixes = spark.sparkContext.broadcast(bitmap(prefix.select(cell(F.col("h"), bits)), bits))
    found = saved(_found(rows, lengths, prefixes, window), "found")
    start = F.col("at") - F.col("shift")
    there = found.where("h is not null").select("_row", "_id", "h", "at", "low", "around").join(prefix, "h").where(start >= F.col("low"))
    same = F.array_join(F.slice(F.split("around", " "), (start - F.col("low") + 1).cast("int"), F.col("size")), " ") == F.col("content")
    hits = there.where(same).select("_row", F.col("_id").alias(id_col), start.alias("start"), "size", *known)
    return found.where("h is null").select("_row", F.col("_id").alias(id_col), "n_words"), hits


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Two tables: all documents (_row, id, n_words), and all matches (_row, id, item, start, size).

    ``_row`` numbers the rows of ``docs``, so repeated rows and repeated or null ids stay apart. A
    null or empty text has no words and no match, a null or empty item no window; a null item id is
    the empty id. Without documents or items there are no matches. Other columns are not read. A window
    of many items in many documents is a match for each item and document; ``report`` has them summed up.
    """
    windows = saved(item_windows(items, window, item_text, item_id), "windows")
    every, hits = _hits(docs, windows, None, window, shingle, text, id_col)
    return every, hits.join(windows.select("content", "item"), "content").select("_row", id_col, "item", "start", "size")


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Per row of ``docs``: its id, n_words, n_hit (words inside matches), items (sorted ids), n_items, items_sha256 (of the ids, comma-joined), contaminated.

    Nulls, empty tables and repeated rows are as in ``matches``. Items stay lists all along: a window's
    list is made once, documents gather the keys of lists, and each set of lists that occurs is
    united once, however many documents have it. So a window that many items share, in
    many documents, is never a row for each of both; only the column ``items``, where it is asked for, has that size.
    """
    windows = saved(item_windows(items, window, item_text, item_id), "windows")
    named, lists = _item_lists(windows)
    every, hits = _hits(docs, windows, named, window, shingle, text, id_col)
    spans = F.collect_set(F.struct("start", "size"))
    hit = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1))))
    keys = F.array_sort(F.collect_set("items_key"))
    per = hits.groupBy("_row").agg(F.size(hit).cast("long").alias("n_hit"), keys.alias("keys"))
    per = saved(per.withColumn("set_key", text_key(F.array_join(F.transform("keys", F.hex), ","))), "per")
    parts = per.groupBy("set_key").agg(F.first("keys").alias("keys")).select("set_key", F.explode("keys").alias("items_key"))
    united = parts.join(lists, "items_key").groupBy("set_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    united = saved(united.withColumns({"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ",").cast("binary"), 256)}), "united")
    # Documents without a match have no key here, so that theirs isn't one hot null.
    known = per.select("_row", "n_hit", "set_key").join(united, "set_key").drop("set_key")
    out = every.join(known, "_row", "left")
    none = {"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return out.select(id_col, "n_words", *(F.coalesce(c, v).alias(c) for c, v in none.items()), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Rows of ``docs`` whose text has no match; whatever their ids, equal texts stay or go together.

    A null or empty text stays. Columns of any names pass through.
    """
    body = docs[text].cast("string")
    keyed = docs.select(text_key(body).alias("key"), body.alias("text"))
    windows = saved(item_windows(items, window, item_text, item_id), "windows")
    _, hits = _hits(keyed, windows, None, window, shingle, "text", "key")
    return without(docs, text_key(body), saved(hits.select("key").distinct(), "gone"))
