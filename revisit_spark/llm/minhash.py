"""Operator 5: MinHash near-duplicates, with every candidate confirmed on the full shingle sets.

One permutation gives all of a document's hashes: its distinct shingles fall into bins by their
leading bits and each bin keeps its smallest. An empty bin copies the first full one in an order
of its own (optimal densification). Bins are cut into bands; documents that agree on a band share
a bucket.

Documents with equal sets are one class from the start. Buckets don't emit their pairs:

1. each class is confirmed against one bucket centre (the bucket's smallest id), the one it shares
   most bands with;
2. then against its other centres, and against its neighbours when buckets are sorted by the bands
   after their own, as far as they are not yet in one component;
3. what is left are members of a bucket in different components: those outside of the bucket's
   largest component are compared with the members they aren't linked with yet.

Before the full sets, step 3 compares sketches (4 bits of each bin): pairs that agree on fewer bins
than similar sets ever do go no further. In buckets of more than LARGE members it deals the members
into blocks of some BLOCK, joins blocks that meet in a bucket, and compares their members within
the task that has both, so that only confirmed links leave it. After step 3 every two members of a bucket are linked, not
similar enough, or in one component, so nothing is lost to the stars, and a bucket's cost is
(members) x (members that don't belong), not members squared.

With 32 bands of 4 bins, two sets at similarity 0.8 share no band with probability (1 - 0.8**4)**32,
about 5e-8, and agree on too few bins with one below 1e-9; that is the method's only loss.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import bits_for, bitmap, member, possible, spot, without
from .common import forget, free_name, in_arrow, saved, text_key
from .components import components
from .words import FOLDED, grams, mixed, pieces, ragged, words

BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
LARGE, BLOCK = 64, 256
#: Bytes of hashes that a block of members may have, about.
BLOCK_BYTES = 4 << 20
_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(57)).astype(np.uint64)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles; fewer words are one shingle."""
    w = words(texts, FOLDED)
    h, ok = grams(w, n)
    counts = w.counts
    first = w.at[:-1]
    for m in range(1, n):
        short = np.flatnonzero(counts == m)
        if len(short):
            g, _ = grams(w, m)
            h[first[short]] = g[first[short]]
            ok[first[short]] = True
    return [np.unique(h[a:z][ok[a:z]]) for a, z in zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS hashes for each set; a row of zeros for an empty one."""
    sig = np.zeros((len(sets), BINS), np.uint64)
    full = np.zeros((len(sets), BINS), bool)
    for i, u in enumerate(sets):
        if len(u):
            at = np.searchsorted(u, _EDGES)
            there = np.diff(at, append=len(u)) > 0
            full[i] = there
            sig[i, there] = u[at[there]]
    rows, cols = np.nonzero(~full & full.any(axis=1)[:, None])
    turn = 0
    while len(rows):
        turn += 1
        source = (mixed((cols + BINS * turn).astype(np.uint64)) % np.uint64(BINS)).astype(np.int64)
        got = full[rows, source]
        sig[rows[got], cols[got]] = sig[rows[got], source[got]]
        rows, cols = rows[~got], cols[~got]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, BANDS) keys; the band's number is part of the key."""
    parts = mixed(sig).reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return out


def sketches(sig: np.ndarray) -> np.ndarray:
    """(rows, BINS / 16): 4 bits of each bin's hash."""
    nibbles = (mixed(sig ^ np.uint64(0x5BD1E995)) & np.uint64(15)).reshape(len(sig), BINS // 16, 16)
    return np.bitwise_or.reduce(nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2)


def fewest_equal(percent: int, loss: float = 1e-9) -> int:
    """Sets at the least similarity agree on fewer than so many nibbles with a probability below ``loss``."""
    p = percent / 100 + (1 - percent / 100) / 16
    below, t = 0.0, 0
    while t < BINS and (below := below + math.comb(BINS, t) * p**t * (1 - p) ** (BINS - t)) < loss:
        t += 1
    return t


def _equal_nibbles(x: str, y: str) -> Column:
    """How many of BINS nibbles two sketch columns share."""
    unlike = F.lit(0)
    for i in range(BINS // 16):
        z = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        unlike = unlike + F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))
    return BINS - unlike


def _neighbours(rows: DataFrame) -> DataFrame:
    """(a, a_digest, b, b_digest): rows next to each other with one key and different parts.

    ``rows`` (id, digest, key, part) lie in order within their partitions. Neighbours in two partitions
    are left out; they come with the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            last = batch.slice(batch.num_rows - 1)
            one, two = batch.slice(0, batch.num_rows - 1), batch.slice(1)
            keep = pa.compute.and_(pa.compute.equal(one.column("key"), two.column("key")), pa.compute.not_equal(one.column("part"), two.column("part")))
            columns = [x.column(c).filter(keep) for x in (one, two) for c in ("id", "digest")]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "a_digest", "b", "b_digest"])

    kind = rows.schema["id"].dataType.simpleString()
    return in_arrow(rows.select("id", "digest", "key", "part"), run, f"a {kind}, a_digest binary, b {kind}, b_digest binary")


def _signed(docs: DataFrame, n: int) -> DataFrame:
    """(id, n_shingles, digest, keys, sketch) of each row; digest is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text", 1 << 20):
            sets = shingle_sets(batch.column("_text"), n)
            sig = signatures(sets)
            keys, sketch = band_keys(sig), sketches(sig)
            some = np.array([len(u) > 0 for u in sets])
            digest = [hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None for u in sets]
            at = np.concatenate([[0], np.cumsum(some)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array([len(u) for u in sets], pa.int64()), pa.array(digest, pa.binary()), *(ragged(x[some].ravel().view(np.int64), at * x.shape[1], pa.int64()) for x in (keys, sketch))],
                names=["id", "n_shingles", "digest", "keys", "sketch"],
            )

    kind = docs.schema["_id"].dataType.simpleString()
    return in_arrow(docs, run, f"id {kind}, n_shingles long, digest binary, keys array<long>, sketch array<long>")


def _sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, digest, hashes): the sets of documents whose id is in ``ids`` or shares a bit with one that is."""
    bits = bits_for(ids.count())
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(ids.select(spot("id", bits=bits)), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            keep = member(wanted.value, whole.column("_spot").to_numpy().view(np.uint64))
            for batch in pieces(iter([whole.filter(pa.array(keep))]), "_text", 1 << 20):
                sets = shingle_sets(batch.column("_text"), n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), pa.array([hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in sets], pa.binary()), pa.array([u.tobytes() for u in sets], pa.binary())],
                    names=["id", "digest", "hashes"],
                )

    kind = docs.schema["_id"].dataType.simpleString()
    return in_arrow(docs.where("_id is not null").withColumn("_spot", spot("_id", bits=bits)), run, f"id {kind}, digest binary, hashes binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of classes with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(u) > len(v):
                    u, v = v, u
                at = np.searchsorted(v, u)
                both = int((v[np.minimum(at, len(v) - 1)] == u).sum())
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("id").alias("a"), F.col("digest").alias("a_digest"), F.col("hashes").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("digest").alias("b_digest"), F.col("hashes").alias("y"))
    both = pairs.join(one, ["a", "a_digest"]).join(two, ["b", "b_digest"]).select("a", "b", "x", "y")
    kind = pairs.schema["a"].dataType.simpleString()
    return in_arrow(both, run, f"a {kind}, b {kind}")


def _confirmed_blocks(pairs: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the members of joined blocks that share a key and lie in different parts.

    ``pairs`` (x, y) has x <= y; ``contents`` (block, members) has some BLOCK structs for each block.
    """
    least = fewest_equal(percent)
    low = np.uint64(0x1111111111111111)

    def unpacked(members: pa.StructArray) -> dict:
        n = len(members)
        matrix = lambda c: members.field(c).flatten().to_numpy().view(np.uint64).reshape(n, -1)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in members.field("hashes")]
        part, id_col = members.field("part"), members.field("id")
        return {"keys": matrix("keys"), "sketch": matrix("sketch"), "sets": sets, "size": np.array([len(u) for u in sets]), "part": part.to_pylist(), "id": id_col}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                same = batch.column("x")[r].as_py() == batch.column("y")[r].as_py()
                one, two = (unpacked(batch.column(c)[r].values) for c in ("x_members", "y_members"))
                number = {p: i for i, p in enumerate(dict.fromkeys(one["part"] + two["part"]))}
                pa_, pb = (np.array([number[p] for p in d["part"]]) for d in (one, two))
                left, right = [], []
                for i, u in enumerate(one["sets"]):
                    ok = (pb != pa_[i]) & (two["keys"] == one["keys"][i]).any(axis=1)
                    ok &= np.minimum(two["size"], len(u)) * 100 >= np.maximum(two["size"], len(u)) * percent
                    if same:
                        ok[: i + 1] = False
                    at = np.flatnonzero(ok)
                    if not len(at):
                        continue
                    z = two["sketch"][at] ^ one["sketch"][i]
                    z |= z >> np.uint64(2)
                    z |= z >> np.uint64(1)
                    for j in at[BINS - np.bitwise_count(z & low).sum(axis=1, dtype=np.int64) >= least].tolist():
                        v = two["sets"][j]
                        place = np.searchsorted(v, u)
                        both = int((v[np.minimum(place, len(v) - 1)] == u).sum())
                        if 100 * both >= percent * (len(u) + len(v) - both):
                            left.append(i)
                            right.append(j)
                yield pa.RecordBatch.from_arrays([one["id"].take(pa.array(left, pa.int64())), two["id"].take(pa.array(right, pa.int64()))], names=["a", "b"])

    kind = contents.schema["members"].dataType.elementType["id"].dataType.simpleString()
    one, two = (contents.select(F.col("block").alias(c), F.col("members").alias(f"{c}_members")) for c in ("x", "y"))
    return in_arrow(pairs.join(one, "x").join(two, "y").select("x", "y", "x_members", "y_members"), run, f"a {kind}, b {kind}")


def _near_size(x: Column | str, y: Column | str, percent: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _centres_apart(split: DataFrame, percent: int) -> DataFrame:
    """(a, a_digest, b, b_digest): centres and the members of their buckets that are not in the centre's component.

    Only buckets of several components are looked at (``split``), so pairs that are linked already are never made.
    """
    home = split.where("id = centre.id and digest = centre.digest").select("key", F.col("part").alias("_home"))
    far = split.join(home, "key").where("part <> _home").where(_near_size("n", "centre.n", percent))
    return far.select(F.col("centre.id").alias("a"), F.col("centre.digest").alias("a_digest"), F.col("id").alias("b"), F.col("digest").alias("b_digest")).distinct()


def _grouped(docs: DataFrame, shingle: int, percent: int, text: str, id_col: str, large_from: int) -> tuple[DataFrame, DataFrame]:
    """Written tables (id, n_shingles, ..) of all rows, and (id, component) of ids with a link."""
    rows = docs.select(docs[id_col].alias("_id"), docs[text].cast("string").alias("_text"))
    signed = saved(_signed(rows, shingle), "signed")
    classes = signed.where("id is not null and n_shingles > 0").groupBy("digest")
    classes = saved(classes.agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "classes")
    same = signed.where("id is not null and n_shingles > 0").select(F.col("id").alias("a"), "digest").join(classes.select("digest", F.col("id").alias("b")), "digest").where("a <> b").select("a", "b").distinct()
    buckets = classes.select("id", "digest", "n", F.explode("keys").alias("key"))
    node = F.struct("id", "digest", "n")
    shared = buckets.groupBy("key").agg(F.min(node).alias("lo"), F.max(node).alias("hi")).where("lo <> hi").select("key", F.col("lo").alias("centre"))
    members = saved(buckets.join(shared, "key"), "members")
    others = members.where("centre.digest <> digest")
    stars = others.where(_near_size("n", "centre.n", percent)).groupBy(F.col("centre.id").alias("a"), F.col("centre.digest").alias("a_digest"), F.col("id").alias("b"), F.col("digest").alias("b_digest")).agg(F.count("*").alias("bands"))
    stars = saved(stars, "stars")
    best = stars.groupBy("b", "b_digest").agg(F.max(F.struct("bands", "a", "a_digest")).alias("best")).select("best.a", "best.a_digest", "b", "b_digest")
    ends = saved(members.select("id").distinct(), "ends")
    sets = saved(_sets_of(rows, ends, shingle), "sets")

    # A first grouping without rounds: each class hangs under its confirmed centre, and that one's centre.
    under = saved(_confirmed(best, sets, percent), "under")
    up = under.select(F.col("a").alias("_x"), F.col("b").alias("_y"))
    labels = saved(under.join(up, F.col("a") == F.col("_y"), "left").select(F.col("b").alias("id"), F.coalesce("_x", "a").alias("component")), "labels")
    split = _split_buckets(members, labels)
    place = F.array_position("keys", F.col("key")).cast("int")
    further = [F.col("keys")[(place + i) % BANDS] for i in range(2)]
    split = saved(split.join(classes.select("id", "digest", "sketch", "keys"), ["id", "digest"]).withColumns({"o1": further[0], "o2": further[1]}).drop("keys"), "split")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = split.repartitionByRange(parts, "key", "o1", "o2", "digest").sortWithinPartitions("key", "o1", "o2", "digest")
    edge = ["a", "a_digest", "b", "b_digest"]
    rest = _centres_apart(split, percent).join(best, edge, "left_anti").union(_neighbours(ordered)).distinct()
    links = same.union(under).union(_confirmed(rest, sets, percent))
    labels = saved(components(links), "labels")

    wide, split = split, saved(_split_buckets(split.drop("part", "largest"), labels), "split")
    forget(wide)
    whole, split = split, saved(split.join(split.groupBy("key").agg((F.count("*") > large_from).alias("large")), "key"), "split")
    forget(whole)
    sizes = ("id", "digest", "n", "part", "sketch")
    small = split.where(~F.col("large"))
    strange = small.where("part <> largest").select("key", *(F.col(c).alias("a" if c == "id" else f"a_{c}") for c in sizes))
    any_of = small.select("key", "largest", *(F.col(c).alias("b" if c == "id" else f"b_{c}") for c in sizes))
    once = (F.col("b_part") == F.col("largest")) | (F.col("a_digest") < F.col("b_digest"))
    alike = _near_size("a_n", "b_n", percent) & (_equal_nibbles("a_sketch", "b_sketch") >= fewest_equal(percent))
    pairs = strange.join(any_of, (strange["key"] == any_of["key"]) & (F.col("a_part") != F.col("b_part")) & once & alike).select(*edge).distinct()
    tried = stars.select(*edge)
    tried = tried.union(tried.select("b", "b_digest", "a", "a_digest"))
    last = _confirmed(pairs.join(tried, edge, "left_anti"), sets, percent)

    large = split.where("large")
    nodes = large.groupBy("id", "digest").agg(F.min("key").alias("home"), F.first("part").alias("part"), F.first("sketch").alias("sketch"), F.first("n").alias("n"))
    homes = nodes.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)).alias("blocks"))
    nodes = saved(nodes.join(homes, "home").withColumn("block", F.xxhash64("home", F.pmod(F.xxhash64("digest"), "blocks"))), "nodes")
    met = large.join(nodes.select("id", "digest", "block"), ["id", "digest"]).groupBy("key", "block").agg(F.max(F.col("part") != F.col("largest")).alias("strange"))
    met = saved(met, "met")
    first, second = met.where("strange").select("key", F.col("block").alias("p")), met.select("key", F.col("block").alias("q"))
    meet = saved(first.join(second, "key").select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct(), "meet")
    full = nodes.join(classes.select("id", "digest", "keys"), ["id", "digest"]).join(sets, ["id", "digest"])
    contents = saved(full.groupBy("block").agg(F.collect_list(F.struct("id", "part", "keys", "sketch", "hashes")).alias("members")), "blocks")
    labels = _joined(labels, saved(last.union(_confirmed_blocks(meet, contents, percent)), "last"))
    forget(classes, members, stars, ends, sets, under, split, nodes, met, meet, contents)
    return signed, labels


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", id_col: str = "doc_id", large_from: int = LARGE) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (smallest id reachable over links), kept.

    A link is 100 * intersection >= percent * union of two distinct shingle sets (``shingle`` words,
    A-Z lower-cased; a text of fewer words is one shingle). Texts without words and null texts have
    no links. An id is one node: rows that repeat an id share its component, whatever their texts. A
    null id has no links, its component is null and it is kept. Sets are compared by 64-bit hashes of
    their shingles. Other columns are not read. ``large_from`` is the bucket size from which members are
    compared in blocks; results are the same for any.
    """
    signed, labels = _grouped(docs, shingle, percent, text, id_col, large_from)
    out = signed.select("id", "n_shingles").join(labels, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _split_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that have several components, with their own (part) and the bucket's largest."""
    part = members.join(labels.select("id", "component"), "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    sizes = part.groupBy("key", "part").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("c", "part"))["part"].alias("largest")).where("parts > 1").drop("parts")
    return part.join(largest, "key")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links."""
    if links.isEmpty():
        return labels
    return saved(components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links)), "labels")


def without_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each group of near-duplicate rows of ``docs``, and all rows that are in none.

    Rows are grouped by their texts, whatever ids they have; the one with the smallest id stays (a null id
    comes after all others), of rows equal in id and text any one. Rows without words are in no group.
    Columns of any names pass through. 16 bytes stand for a text and for a row (its text and id), so the
    input isn't written again, and copies of one text with many ids are no key of their own.
    """
    body, id_ = docs[text].cast("string"), docs[id_col]
    key = text_key(body)
    row = text_key(F.concat(F.coalesce(F.hex(key), F.lit("")), F.when(id_.isNull(), F.lit("-")).otherwise(F.lit("=")), F.coalesce(id_.cast("string"), F.lit(""))))
    signed, labels = _grouped(docs.select(key.alias("key"), body.alias("text")), shingle, percent, "text", "key", LARGE)
    filled = signed.where("n_shingles > 0").select("id").distinct()
    groups = saved(filled.join(labels, "id", "left").select(F.col("id").alias("key"), F.coalesce("component", "id").alias("component_id")), "groups")
    forget(signed, labels)
    each = docs.select(row.alias("row"), key.alias("key"), id_.alias("id")).groupBy("row").agg(F.first("key").alias("key"), F.first("id").alias("id"), F.count("*").alias("c"))
    rows = saved(each.join(groups, "key").select("row", "id", "c", "component_id"), "grouped")
    first = rows.groupBy("component_id").agg(F.sum("c").alias("all"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    first = saved(first.where("all > 1").select("component_id", F.col("first.row").alias("stays")), "first")
    judged = rows.join(first, "component_id")
    gone = saved(judged.where("row <> stays").select("row"), "gone")
    again = saved(judged.where("row = stays and c > 1").select("row"), "again")
    forget(groups, rows, first)
    left = without(docs, row, gone)
    if again.isEmpty():
        return left
    k, s = free_name(docs, "_row"), free_name(docs, "_cell")
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(again.select(spot("row"))))
    keyed = without(docs.withColumn(k, row), F.col(k), gone).withColumn(s, spot(k))
    maybe, repeated = possible(keyed, sent, s), again.select(F.col("row").alias(k))
    one = maybe.join(repeated, k, "left_semi").dropDuplicates([k])
    return possible(keyed, sent, s, False).select(*docs.columns).union(maybe.join(repeated, k, "left_anti").select(*docs.columns)).union(one.select(*docs.columns))
