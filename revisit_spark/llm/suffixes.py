"""Operator 3: passages that repeat across documents, by a sparse suffix array.

Of all suffixes of all texts (in words) those at minimiser positions stay: the smallest 20-word gram
of each window of 50 words, about one suffix for 16 words, chosen by content alone, so that equal
passages keep the same suffixes. A suffix is compared with its neighbours as far as windows that
have its minimiser reach to the left and to the right; what lies further has a minimiser of its own.

Suffixes that are equal over that reach are one entry, summed up before the shuffle; that they stand
in two documents already shows a repeat. Where entries with one gram differ, they are sorted by
what follows (and once more by what precedes, going left), range-partitioned so that a frequent gram
is spread over tasks; neighbours are compared, across the partitions' borders too, and their
common part is extended word by word to the left and right. Common parts of at least 50 words are
repeats in the documents of both entries.

Sorting shows how far at most an entry has anything in common with another to either side. Where
windows lie within that, but in no match with a neighbour (three or more entries that differ on both
sides), the windows of that gram's entries, as far as they lie within it, are grouped exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bitmap import bitmap, bits_for, possible, spot
from .common import in_arrow, saved
from .words import PLAIN, Words, anchors, grams, pieces, range_hashes, words

WINDOW, GRAM = 50, 20


def minimisers(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(value, begin, n, p): windows begin .. begin + n - 1 have their leftmost smallest gram at p."""
    found = anchors(w, window, gram)
    value, begin, n = found.value, found.begin, found.count
    if not len(begin):
        return value, begin, n, begin
    g, _ = grams(w, gram)
    ahead = np.arange(window - gram + 1)
    next_from = lambda at: at + (g[np.minimum(at[:, None] + ahead, len(g) - 1)] == value[:, None]).argmax(axis=1)
    last = begin + n - 1
    p = next_from(last)
    tied = np.flatnonzero(next_from(begin) != p)  # the gram stands more than once, in repetitive text
    if not len(tied):
        return value, begin, n, p
    parts, more = [np.delete(x, tied) for x in (value, begin, n, p)], []
    for i in tied.tolist():
        b, z = int(begin[i]), int(last[i])
        places = b + np.flatnonzero(g[b : int(p[i]) + 1] == value[i])
        starts = np.concatenate([[b], places[:-1] + 1])
        more.append((np.full(len(places), value[i]), starts, np.minimum(places, z) - starts + 1, places))
    return tuple(np.concatenate([x, *(m[k] for m in more)]) for k, x in enumerate(parts))


def _suffixes(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, text_key, n_words, value, d1, d2, at, n, p): minimisers; d1 and d2 hash the words within reach.

    ``at`` is the first of the n windows that have the minimiser at ``p``, all counted in words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            w = words(batch.column("_text"), PLAIN)
            value, begin, n, p = minimisers(w, window, gram)
            end = begin + n + window - 1
            of = np.searchsorted(w.at, begin, side="right") - 1
            first = w.at[of]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(pa.array(of)), batch.column("_key").take(pa.array(of)), pa.array(w.counts[of]), pa.array(value.view(np.int64)), pa.array(range_hashes(w, begin, end, 1).view(np.int64)), pa.array(range_hashes(w, begin, end, 2).view(np.int64)), pa.array(begin - first), pa.array(n), pa.array(p - first)],
                names=["id", "text_key", "n_words", "value", "d1", "d2", "at", "n", "p"],
            )

    kind = rows.schema["_id"].dataType.simpleString()
    return in_arrow(rows, run, f"id {kind}, text_key long, n_words long, value long, d1 long, d2 long, at long, n long, p long")


def _contexts(asked: DataFrame, window: int) -> DataFrame:
    """(run, value, lo, hi, n, shift, after, before): words from the minimiser on and, going left, before it.

    ``shift`` is the place of the minimiser within its reach of n windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text", 1 << 20):
            w = words(batch.column("_text"), PLAIN)
            h = (w.hash >> np.uint64(32)).astype(">u4")
            lists = batch.column("asked")
            flat = lists.flatten()
            of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            at, p = (flat.field(k).to_numpy() + w.at[of] for k in ("at", "p"))
            end = at + flat.field("n").to_numpy() + window - 1
            after = [h[a:z].tobytes() for a, z in zip(p.tolist(), end.tolist(), strict=True)]
            before = [h[a:z][::-1].tobytes() for a, z in zip(at.tolist(), p.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([flat.field("run"), flat.field("value"), batch.column("_id").take(pa.array(of)), flat.field("last"), flat.field("n"), pa.array(p - at), pa.array(after, pa.binary()), pa.array(before, pa.binary())], names=["run", "value", "lo", "hi", "n", "shift", "after", "before"])

    kind = asked.schema["_id"].dataType.simpleString()
    return in_arrow(asked, run, f"run long, value long, lo {kind}, hi {kind}, n long, shift long, after binary, before binary")


def _common(x: bytes, y: bytes) -> int:
    """How many words two sequences share from their beginning on."""
    n = min(len(x), len(y)) // 4
    unlike = np.flatnonzero(np.frombuffer(x, ">u4", n) != np.frombuffer(y, ">u4", n))
    return int(unlike[0]) if len(unlike) else n


#: Rows of a partition's borders: entries of the streaks that touch its beginning and its end, and for the
#: partitions beside it its last entry, the one before the last streak, its first, the one after the first streak.
HEAD, TAIL, LAST, BEFORE, FIRST, AFTER = range(6)


def _alone(x: tuple, y: tuple) -> bool:
    """Whether one and the same document has both entries (run, value, lo, hi, after, before) alone."""
    return x[2] == x[3] == y[2] == y[3]


def _matched(x: tuple, y: tuple) -> list[tuple]:
    right, left = _common(x[4], y[4]), _common(x[5], y[5])
    return [(x[0], left, right, y[2], y[3]), (y[0], left, right, x[2], x[3])]


def _compared(ordered: DataFrame) -> DataFrame:
    """Neighbours of sorted entries, in each partition, and its borders.

    A row (run, left, right, lo, hi) says: ``left`` words before the run's minimiser and ``right`` from it
    on also stand in an entry of the documents lo to hi, no word more. Rows with a role are whole entries
    (left is null), for the comparison across borders: four a partition, and the streaks at its ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        streak: list[tuple] = []  # entries with the last value that one and the same document has alone
        earlier = first = last = beyond = None  # earlier: the entry before the streak, of the same value
        heading = True  # the streak is the partition's first
        border = lambda e, role: (e[0], None, None, e[2], e[3], e[1], e[4], e[5], part, role)
        for batch in batches:
            out = []
            for entry in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                against: list[tuple] = []
                if last is None:
                    first, streak = entry, [entry]
                elif last[1] != entry[1]:
                    streak, earlier, heading = [entry], None, False
                elif not _alone(entry, last):
                    if heading:
                        beyond, heading = entry, False
                    against, earlier, streak = streak, last, [entry]
                else:
                    against = [earlier] if earlier is not None else []
                    streak.append(entry)
                for x in against:
                    out += [(*row, None, None, None, None, None) for row in _matched(x, entry)]
                if heading:
                    out.append(border(entry, HEAD))
                last = entry
            yield _batch_of(out, names, kinds)
        if first is not None:
            ends = ((last, LAST), (earlier, BEFORE), (first, FIRST), (beyond, AFTER))
            yield _batch_of([*(border(e, TAIL) for e in streak), *(border(e, role) for e, role in ends if e is not None)], names, kinds)

    kind = ordered.schema["lo"].dataType.simpleString()
    arrow_id = to_arrow_type(ordered.schema["lo"].dataType)
    columns = ("run", "value", "lo", "hi", "after", "before")
    names = ["run", "left", "right", "lo", "hi", "value", "after", "before", "part", "role"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), arrow_id, arrow_id, pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
    return in_arrow(ordered.select(*columns), run, f"run long, left long, right long, lo {kind}, hi {kind}, value long, after binary, before binary, part int, role int")


def _batch_of(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    parts = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(p, k) for p, k in zip(parts, kinds, strict=True)], names=names)


def _facing(ends: dict[int, dict[int, tuple]]) -> dict[tuple[int, int], tuple]:
    """(partition, HEAD or TAIL): the nearest entry beyond that border that its streak is compared with.

    A streak may go on over any number of partitions.
    """
    found: dict[tuple[int, int], tuple] = {}
    for role, order, own, near, far in ((HEAD, sorted(ends), FIRST, LAST, BEFORE), (TAIL, sorted(ends, reverse=True), LAST, FIRST, AFTER)):
        for next_part, part in zip(order, order[1:], strict=False):
            entry, other = ends[part][own], ends[next_part][near]
            if entry[1] != other[1]:
                continue
            if not _alone(entry, other):
                found[part, role] = other
            elif far in ends[next_part]:
                found[part, role] = ends[next_part][far]
            elif ends[next_part][FIRST][1] == ends[next_part][LAST][1] and (next_part, role) in found:
                found[part, role] = found[next_part, role]
    return found


def _across(borders: DataFrame, facing: dict[tuple[int, int], tuple]) -> DataFrame:
    """(run, left, right, lo, hi) of the streaks at the borders with the entries that they face."""
    sent = borders.sparkSession.sparkContext.broadcast(facing)
    kind = borders.schema["lo"].dataType.simpleString()
    kinds = [pa.int64(), pa.int64(), pa.int64(), *[to_arrow_type(borders.schema["lo"].dataType)] * 2]
    columns = ("run", "value", "lo", "hi", "after", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for *entry, part, role in zip(*(batch.column(c).to_pylist() for c in (*columns, "part", "role")), strict=True):
                other = sent.value.get((part, role))
                if other is not None and other[1] == entry[1]:
                    out += _matched(tuple(entry), other)
            yield _batch_of(out, ["run", "left", "right", "lo", "hi"], kinds)

    return in_arrow(borders.select(*columns, "part", "role"), run, f"run long, left long, right long, lo {kind}, hi {kind}")


def _beside(contexts: DataFrame) -> DataFrame:
    """(run, left, right, lo, hi) of neighbours in both orders."""
    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = []
    for side in ("after", "before"):
        ordered = contexts.repartitionByRange(parts, "value", side, "run").sortWithinPartitions("value", side, "run")
        within = saved(_compared(ordered), "neighbours")
        ends: dict[int, dict[int, tuple]] = {}
        # Four entries of each partition at most.
        for r in within.where(F.col("role") >= LAST).collect():
            ends.setdefault(r.part, {})[r.role] = (r.run, r.value, r.lo, r.hi, bytes(r.after), bytes(r.before))
        found += [within.where("left is not null").select("run", "left", "right", "lo", "hi"), _across(within.where(F.col("role") < LAST), _facing(ends))]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _open_windows(contexts: DataFrame, window: int) -> DataFrame:
    """(run, value, lo, hi, left, h): the windows s0 to s1 of each entry, by digest; ``left`` words precede the minimiser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, left, digest = [], [], []
            for i, (after, before, shift, s0, s1) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("after", "before", "shift", "s0", "s1")), strict=True)):
                whole = np.concatenate([np.frombuffer(before, ">u4")[::-1], np.frombuffer(after, ">u4")])
                for s in range(s0, s1 + 1):
                    which.append(i)
                    left.append(shift - s)
                    digest.append(hashlib.blake2b(whole[s : s + window].tobytes(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(which, pa.int64())) for c in ("run", "value", "lo", "hi")), pa.array(left, pa.int64()), pa.array(digest, pa.binary())], names=["run", "value", "lo", "hi", "left", "h"])

    kind = contexts.schema["lo"].dataType.simpleString()
    return in_arrow(contexts.select("run", "value", "lo", "hi", "after", "before", "shift", "s0", "s1"), run, f"run long, value long, lo {kind}, hi {kind}, left long, h binary")


def _matches(contexts: DataFrame, window: int) -> DataFrame:
    """(run, matches): for each entry the parts of at least ``window`` words that others have too."""
    part = F.struct("left", "right", "lo", "hi")
    enough = F.when(F.col("left") + F.col("right") >= window, part)
    beside = saved(_beside(contexts), "beside")
    per = saved(beside.groupBy("run").agg(F.max("left").alias("far_left"), F.max("right").alias("far_right"), F.array_distinct(F.collect_list(enough)).alias("matches")), "per-run")
    reach = contexts.join(per, "run").withColumn("s0", F.greatest(F.lit(0), F.col("shift") - F.col("far_left"))).withColumn("s1", F.least(F.col("n") - 1, F.col("shift") + F.col("far_right") - window)).where("s0 <= s1")
    inside = lambda s: F.exists("matches", lambda m: (F.col("shift") - s <= m["left"]) & (window - F.col("shift") + s <= m["right"]))
    unsure = reach.where("lo = hi").where(F.exists(F.sequence("s0", "s1"), lambda s: ~inside(s))).select("value").distinct()
    each = saved(_open_windows(reach.join(unsure, "value"), window), "open")
    groups = each.groupBy("value", "h").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).where("least < most")
    more = each.join(groups, ["value", "h"]).select("run", "left", (F.lit(window) - F.col("left")).alias("right"), F.col("least").alias("lo"), F.col("most").alias("hi"))
    more = more.groupBy("run").agg(F.collect_list(part).alias("further"))
    both = F.concat("matches", F.coalesce("further", F.array().cast(per.schema["matches"].dataType)))
    return per.join(more, "run", "left").select("run", both.alias("matches")).where("size(matches) > 0")


def _merged(spans: DataFrame, id_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_repeated, merged = [], []
            for ranges in batch.column("ranges").to_pylist():
                own: list[list[int]] = []
                for begin, end in sorted((r["begin"], r["end"]) for r in ranges):
                    if own and begin <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], end)
                    else:
                        own.append([begin, end])
                n_repeated.append(sum(e - b for b, e in own))
                merged.append([{"begin": b, "end": e} for b, e in own])
            span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), pa.array(n_repeated, pa.int64()), pa.array(merged, span)], names=[id_col, "n_words", "n_repeated", "passages"])

    kind = spans.schema["id"].dataType.simpleString()
    return in_arrow(spans.select("id", "n_words", "ranges"), run, f"`{id_col}` {kind}, n_words long, n_repeated long, passages array<struct<begin: long, end: long>>")


def repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per text that has a passage of ``window`` words or more that another document has too:

    its id, n_words, n_repeated (words inside such passages) and passages (word spans, ends excluded,
    merged). Words are runs of anything but the six ASCII spaces, unchanged. Null and shorter texts
    have none. Rows with a null id are left out; rows that share an id are one document, and identical
    ones of them give one row. Repeats within one document don't count. Words are compared by hashes:
    64 bits for grams and whole reaches, 32 bits for each word that a match is extended by. Other columns are not read.
    """
    if not 0 < gram < window:
        raise ValueError("gram must be shorter than window")
    body = docs[text].cast("string")
    rows = docs.select(docs[id_col].alias("_id"), F.xxhash64(body).alias("_key"), body.alias("_text")).where("_id is not null")
    found = saved(_suffixes(rows, window, gram), "suffixes")
    place = F.struct("id", "text_key", "at", "n", "p")
    entries = found.groupBy("value", "d1", "d2").agg(F.min(place).alias("first"), F.max("id").alias("last"))
    several = found.groupBy("value").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("value")
    entries = saved(entries.join(several, "value").withColumn("run", F.monotonically_increasing_id()), "entries")
    unlike = entries.groupBy("value").agg(F.count("*").alias("k")).where("k > 1").select("value")
    asked = entries.join(unlike, "value").groupBy(F.col("first.id").alias("_id"), F.col("first.text_key").alias("_key"))
    asked = saved(asked.agg(F.collect_list(F.struct("run", "value", "last", "first.at", "first.n", "first.p")).alias("asked")), "asked")
    bits = bits_for(asked.count())
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(asked.select(spot("_id", "_key", bits=bits)), bits))
    texts = possible(rows.withColumn("_spot", spot("_id", "_key", bits=bits)), wanted, "_spot").dropDuplicates(["_id", "_key"])
    contexts = saved(_contexts(texts.join(asked, ["_id", "_key"]).select("_id", "_text", "asked"), window), "contexts")
    known = entries.join(_matches(contexts, window), "run", "left").where("first.id < last or matches is not null")
    marked = found.join(known.select("value", "d1", "d2", F.col("first.id").alias("lo"), "last", "matches"), ["value", "d1", "d2"])
    everything = F.array(F.struct(F.col("at").alias("begin"), (F.col("at") + F.col("n") + window - 1).alias("end")))
    others = F.filter("matches", lambda m: (m["lo"] != F.col("id")) | (m["hi"] != F.col("id")))
    parts = F.transform(others, lambda m: F.struct((F.col("p") - m["left"]).alias("begin"), (F.col("p") + m["right"]).alias("end")))
    ranges = marked.select("id", "text_key", "n_words", F.when(F.col("lo") < F.col("last"), everything).otherwise(parts).alias("r")).where("size(r) > 0")
    ranges = ranges.groupBy("id", "text_key", "n_words").agg(F.array_distinct(F.flatten(F.collect_list("r"))).alias("ranges"))
    return _merged(ranges, id_col)
