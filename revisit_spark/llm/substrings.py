"""Operator 7: substring dedup behind a count-min sketch.

A window is 50 words in a row. Every window has a smallest 20-word gram (by hash), the same wherever
the window stands; neighbouring windows mostly share it and form a run, some 16 windows long.

1. Each partition counts its runs by smallest gram in a sketch of two rows, up to two; the sketches are
   merged part by part, sent as bitmaps or as places of two bytes. Equal windows have equal grams, so
   a cell's count is never below the number of runs that hold any one window of those that fall into
   it. (Windows of different documents are in different runs; how often one repeats within a run is
   not counted, as no document removes its own words.) Which cells have two or more is a bitmap, sized
   by the text there is, 32 MB at most.
2. The second pass lets only runs through whose cells are repeated in both rows, and groups them
   exactly: first whole runs, by their words; then, where one gram has several different runs, their
   single windows. None is lost: a window that repeats has a gram that repeats.
3. Ranges of words to remove go back to their texts.

A fuller sketch only lets more runs through to the exact groups, which are narrow rows (about one for
16 words). Windows' places are known from the input alone, and groups are summed up before they
are shuffled, so that no group of copies meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import bitmap, bits_for, member, possible, spot
from .common import forget, in_arrow, saved
from .sketch import repeated_cells
from .words import PLAIN, anchors, mixed, pieces, range_hashes, runs, text_bytes, words

WINDOW, GRAM = 50, 20
#: Bytes of text for each run, about; two cells of the sketch are for a run.
RUN_BYTES = 100


def _cells(value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of hashes in the sketch's two rows of 2**bits cells."""
    h, low = mixed(value), np.uint64((1 << bits) - 1)
    return h & low, (h >> np.uint64(bits) & low) + np.uint64(1 << bits)


def _sketch(rows: DataFrame, window: int, gram: int, bits: int) -> np.ndarray:
    """The cells of the merged sketch that two runs or more fall into, as a bitmap."""

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in pieces(batches, "_text", 2 << 20):
            found = anchors(words(batch.column("_text"), PLAIN), window, gram)
            yield from _cells(found.value, bits)

    return repeated_cells(rows.select("_text"), cells_of, bits + 1)


def _repeated(rows: DataFrame, seen, window: int, gram: int, bits: int) -> DataFrame:
    """(id, text_key, value, d1, d2, at, n): runs that the sketch takes for repeated; d1, d2 hash their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text", 2 << 20):
            w = words(batch.column("_text"), PLAIN)
            found = anchors(w, window, gram)
            one, two = _cells(found.value, bits)
            keep = np.flatnonzero(member(seen.value, one) & member(seen.value, two))
            begin, n = found.begin[keep], found.count[keep]
            end = begin + n + window - 1
            of = np.searchsorted(w.at, begin, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(pa.array(of)), batch.column("_key").take(pa.array(of)), pa.array(found.value[keep].view(np.int64)), pa.array(range_hashes(w, begin, end, 1).view(np.int64)), pa.array(range_hashes(w, begin, end, 2).view(np.int64)), pa.array((begin - w.at[of]).astype(np.int64)), pa.array(n.astype(np.int64))],
                names=["id", "text_key", "value", "d1", "d2", "at", "n"],
            )

    kind = rows.schema["_id"].dataType.simpleString()
    return in_arrow(rows, run, f"id {kind}, text_key long, value long, d1 long, d2 long, at long, n long")


def _windows(asked: DataFrame, window: int) -> DataFrame:
    """(run, value, id, last, shift, h): each window of the runs asked for; ``asked`` has their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text", 1 << 20):
            w = words(batch.column("_text"), PLAIN)
            lists = batch.column("asked")
            flat = lists.flatten()
            of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            at, n = (flat.field(k).to_numpy() for k in ("at", "n"))
            begin = runs(w.at[of] + at, n)
            which = np.repeat(np.arange(len(n)), n)
            yield pa.RecordBatch.from_arrays(
                [*(flat.field(k).take(pa.array(which)) for k in ("run", "value")), batch.column("_id").take(pa.array(of[which])), flat.field("last").take(pa.array(which)), pa.array(runs(np.zeros(len(n), np.int64), n).astype(np.int32)), pa.array(range_hashes(w, begin, begin + window, 3).view(np.int64))],
                names=["run", "value", "id", "last", "shift", "h"],
            )

    kind = asked.schema["_id"].dataType.simpleString()
    return in_arrow(asked.select("_id", "_text", "asked"), run, f"run long, value long, id {kind}, last {kind}, shift int, h long")


def _kept(texts: DataFrame, id_col: str, without=None) -> DataFrame:
    """Texts without their ranges; with a bitmap, only rows whose ``_spot`` isn't in it (in one worker)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text", 2 << 20):
            if without is not None:
                batch = batch.filter(pa.array(~member(without.value, batch.column("_spot").to_numpy().view(np.uint64))))
            data, at = text_bytes(batch.column("_text"))
            raw = data.tobytes()
            total, removed, kept, spans = [], [], [], []
            for a, z, ranges in zip(at[:-1].tolist(), at[1:].tolist(), batch.column("ranges").to_pylist(), strict=True):
                every = raw[a:z].split()
                total.append(len(every))
                own: list[dict] = []
                if ranges:
                    step = np.zeros(len(every) + 1, np.int64)
                    np.add.at(step, [r["begin"] for r in ranges], 1)
                    np.add.at(step, [r["end"] for r in ranges], -1)
                    keep = np.cumsum(step[:-1]) == 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]])))
                    own = [{"begin": b, "end": e} for b, e in edge.reshape(-1, 2).tolist()]
                    every = list(compress(every, keep.tolist()))
                removed.append(total[-1] - len(every))
                kept.append(b" ".join(every))
                spans.append(own)
            span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, span)],
                names=[id_col, "n_words", "n_removed", "kept", "removed"],
            )

    kind = texts.schema["_id"].dataType.simpleString()
    return in_arrow(texts, run, f"`{id_col}` {kind}, n_words long, n_removed long, kept string, removed array<struct<begin: long, end: long>>")


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: id, n_words, n_removed, kept (text), removed (word spans, ends excluded).

    A word goes if a window that covers it, ``window`` words of one text in a row, also starts in a text
    with a smaller id. Kept words are joined by one space. A null text has no words; a null id neither
    removes nor loses words; rows that share an id don't remove each other's words, as none is smaller.
    Windows are judged on the input. Word sequences are compared by two 64-bit hashes of their words.
    Other columns are not read.
    """
    if not 0 < gram < window:
        raise ValueError("gram must be shorter than window")
    body = docs[text].cast("string")
    rows = docs.select(docs[id_col].alias("_id"), F.xxhash64(body).alias("_key"), body.alias("_text"))
    named = rows.where("_id is not null")
    size = named.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    bits = bits_for(size // RUN_BYTES) - 1
    seen = docs.sparkSession.sparkContext.broadcast(_sketch(named, window, gram, bits))
    found = saved(_repeated(named, seen, window, gram, bits), "runs")
    place = F.struct("id", "text_key", "at", "n")
    whole = found.groupBy("value", "d1", "d2").agg(F.min(place).alias("first"), F.max("id").alias("last"), F.count("*").alias("c"))
    whole = saved(whole.withColumn("run", F.monotonically_increasing_id()), "whole")
    several = whole.groupBy("value").agg(F.count("*").alias("k"), F.min("first.id").alias("lo"), F.max("last").alias("hi")).where("k > 1 and lo < hi").select("value")
    asked = whole.join(several, "value").groupBy(F.col("first.id").alias("_id"), F.col("first.text_key").alias("_key"))
    asked = saved(asked.agg(F.collect_list(F.struct("run", "value", "last", "first.at", "first.n")).alias("asked")), "asked")
    single = saved(_windows(_texts_of(named, asked).select("_id", "_text", "asked"), window), "windows")
    # Written, so that the join isn't tied to the groups' partitions: Spark then splits a window that very many runs have.
    first = saved(single.groupBy("value", "h").agg(F.min("id").alias("lo"), F.max("last").alias("hi")).where("lo < hi").select("value", "h", "lo"), "firsts")
    earlier = single.join(first, ["value", "h"]).where("lo < last").groupBy("run").agg(F.collect_list(F.struct("shift", "lo")).alias("windows"))
    # A run that stands once and has no window from elsewhere removes nothing.
    useful = whole.join(earlier, "run", "left").where("c > 1 or windows is not null").select("value", "d1", "d2", F.col("first.id").alias("lo"), "windows")
    marked = found.join(useful, ["value", "d1", "d2"])
    parts = F.transform(F.filter("windows", lambda x: x["lo"] < F.col("id")), lambda x: F.struct((F.col("at") + x["shift"]).alias("begin"), (F.col("at") + x["shift"] + window).alias("end")))
    everything = F.array(F.struct(F.col("at").alias("begin"), (F.col("at") + F.col("n") + window - 1).alias("end")))
    ranges = marked.select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), F.when(F.col("lo") < F.col("id"), everything).otherwise(parts).alias("r")).where("size(r) > 0")
    ranges = saved(ranges.groupBy("_id", "_key").agg(F.array_distinct(F.flatten(F.collect_list("r"))).alias("ranges")), "ranges")
    forget(found, whole, asked, single, first)
    wide = bits_for(ranges.count())
    touched = docs.sparkSession.sparkContext.broadcast(bitmap(ranges.select(spot("_id", "_key", bits=wide)), wide))
    spotted = rows.withColumn("_spot", spot("_id", "_key", bits=wide))
    changed = possible(spotted, touched, "_spot").join(ranges, ["_id", "_key"], "left").select("_id", "_text", "ranges")
    same = spotted.select("_id", "_text", "_spot", F.lit(None).cast(ranges.schema["ranges"].dataType).alias("ranges"))
    return _kept(changed, id_col).union(_kept(same, id_col, touched))


def _texts_of(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` joined with ``keys`` by (_id, _key); a bitmap keeps most other rows out of the shuffle."""
    bits = bits_for(keys.count())
    wanted = rows.sparkSession.sparkContext.broadcast(bitmap(keys.select(spot("_id", "_key", bits=bits)), bits))
    return possible(rows.withColumn("_spot", spot("_id", "_key", bits=bits)), wanted, "_spot").join(keys, ["_id", "_key"])
