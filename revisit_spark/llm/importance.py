"""Operator 13: documents resampled towards a target distribution, by importance weights of hashed n-grams.

Words come from an untrained pre-tokeniser of the ``tokenizers`` library, a Split by a pattern over the text with
A-Z lower-cased, as offsets; windows of the offsets are the n-grams, counted by the CRC of their bytes into
buckets. Each document's counts are written once, sparse; histograms of the corpus and of the target are sums
of those, the gain of a bucket is the logarithm of their ratio, and a document's weight is the sum of gains over its
counts. A Gumbel-like term from the document's id makes the best scores a sample without replacement.

A histogram has BUCKETS numbers, whatever the data; tasks sum up before they send. Texts are read once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORD, forget, in_arrow, saved
from .ranks import ranked
from .words import pieces

BUCKETS, NGRAM, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Characters of a text that are split at a time, cut between words: the offsets of a very long text needn't be held at once.
STRETCH = 1 << 16
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_BREAK = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def splitter():
    """The pre-tokeniser: words by their pattern, what is between them dropped."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(ALNUM_WORD), behavior="removed", invert=True)


def stretches(text: str, most: int = STRETCH) -> Iterator[str]:
    """A text in stretches of about ``most`` characters that no word crosses; a longer word stays whole."""
    begin = 0
    while len(text) - begin > most:
        found = _BREAK.search(text, begin + most)
        if found is None:
            break
        yield text[begin : found.start()]
        begin = found.end()
    yield text[begin:] if begin else text


def counted(text: str | None, split, ngram: int = NGRAM, buckets: int = BUCKETS) -> tuple[int, np.ndarray, np.ndarray]:
    """Words of a text, and the buckets of its windows of 1 to ``ngram`` words with how many fall into each."""
    n, windows, last = 0, Counter(), []
    for part in stretches((text or "").encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")):
        spans = [span for _, span in split.pre_tokenize_str(part)]
        n += len(spans)
        words = [part[a:b] for a, b in spans]
        windows.update(words)
        for k in range(2, ngram + 1):
            tail = last[len(last) - k + 1 :] if len(last) >= k - 1 else last
            joined = tail + words
            windows.update(" ".join(joined[i : i + k]) for i in range(len(joined) - k + 1))
        last = (last + words)[-max(ngram - 1, 0) :] if ngram > 1 else []
    if not windows:
        return n, np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in windows), np.int64, len(windows))
    own, back = np.unique(at, return_inverse=True)
    return n, own, np.bincount(back, np.fromiter(windows.values(), np.int64, len(windows))).astype(np.int64)


def histograms(rows: DataFrame, text: str = "text", id_col: str | None = "doc_id", ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """(row, id, n_words, bucket, times): each row's counts, ``bucket`` and ``times`` as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        for batch in pieces(batches, "_text"):
            words, own, times = zip(*(counted(t, split, ngram, buckets) for t in batch.column("_text").to_pylist()), strict=True)
            at = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(x), kind)) for x, kind in ((own, pa.int32()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(words, pa.int64()), *lists], names=["row", "id", "n_words", "bucket", "times"])

    named = rows[id_col] if id_col else F.lit(None).cast("long")
    read = rows.select(F.monotonically_increasing_id().alias("row"), named.alias("id"), rows[text].cast("string").alias("_text"))
    return in_arrow(read, run, f"row long, id {read.schema['id'].dataType.simpleString()}, n_words long, bucket array<int>, times array<long>")


def totals(counts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, total): sums over all rows of ``histograms``; each task sends a row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(whole, batch.column("bucket").flatten().to_numpy(), batch.column("times").flatten().to_numpy())
        own = np.flatnonzero(whole)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(whole[own])], names=["bucket", "total"])

    return in_arrow(counts.select("bucket", "times"), run, "bucket int, total long").groupBy("bucket").agg(F.sum("total").alias("total"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), t and s its totals in target and corpus.

    The driver gets ``buckets`` rows of each at most.
    """
    s, t = np.zeros(buckets), np.zeros(buckets)
    for rows, into in ((corpus, s), (target, t)):
        for r in rows.toLocalIterator():
            into[r["bucket"]] = r["total"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(counts: DataFrame, gain: np.ndarray) -> DataFrame:
    """(row, id, n_words, n_features, weight): the sum of gains over each row's windows, repeats counted."""
    sent = counts.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("bucket")
            at = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))]) if len(lists) else np.zeros(1, np.int64)
            times = batch.column("times").flatten().to_numpy()
            each = sent.value[lists.flatten().to_numpy()] * times
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[at]) for x in (times, each)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "n_words")), *(pa.array(x.astype(np.int64)) for x in sums)], names=["row", "id", "n_words", "n_features", "weight"])

    kind = counts.schema["id"].dataType.simpleString()
    return in_arrow(counts, run, f"row long, id {kind}, n_words long, n_features long, weight long")


def luck(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln(u))), u from the first 8 hex digits of sha256(``seed:doc_id``); a null id counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, text: str = "text", id_col: str = "doc_id", target_text: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: its id, n_features, weight, score, rank (1 for the best of those drawn, null for others).

    Of rows with ``least_words`` words or more, ``percent`` of a hundred are drawn, rounded down: the highest
    scores, of equal ones the smaller id (null last). Null and empty texts have no windows and the weight 0; very
    long ones are read whole; repeated rows have equal scores and ranks of their own. An empty table has no
    rows; without targets gains only even out. Other columns are not read, whatever their names.
    """
    counts = saved(histograms(docs, text, id_col, ngram, buckets), "histograms")
    gain = gains(totals(counts, buckets), totals(histograms(target, target_text, None, ngram, buckets), buckets), buckets)
    scored = saved(weighed(counts, gain).withColumn("score", F.col("weight") + luck(F.col("id"), seed)), "scored")
    forget(counts)
    able = scored.where(F.col("n_words") >= least_words).select("row", "id", "score", F.lit("all").alias("group"))
    placed = ranked(able, "group", F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row"))
    drawn = placed.where(F.col("rank") < F.floor(F.col("size") * percent / 100)).select("row", (F.col("rank") + 1).alias("rank"))
    return scored.join(drawn, "row", "left").select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
