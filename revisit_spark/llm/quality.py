"""Operator 6: quality by hashed word n-grams in a logistic regression.

Features are 1- and 2-grams of tokens (runs of letters, digits or signs, lower-cased) and 1- to
3-grams of the tokens' shapes (case, kind, and whether a word repeats the one before), hashed into
2**18 places; a feature's value is its share of the text's n-grams. Weights are learnt by
follow-the-regularised-leader updates, one text at a time; a score is a sparse dot product, the mean
weight over the text's n-grams.

Training takes a bounded sample of labelled rows: its ids are sent to the scan, the hashed features
of the sample meet in one task, and weights of fixed size come back. Scoring is one pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, in_arrow
from .words import mixed, pieces, powers, ragged, text_bytes

PLACES = 1 << 18
#: Bound of the sample: labelled rows to learn from, about.
SAMPLE = 6000
SCALE = 20.0

_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[0x30:0x3A] = 2
_LOW = np.arange(256, dtype=np.uint64)
_LOW[0x41:0x5B] += 32


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of all n-grams of the texts, one text after the other, and the n+1 offsets of the texts."""
    data, at = text_bytes(texts)
    kind = _KIND[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[at] = True
    edge = np.flatnonzero(change)
    begin, end = edge[:-1], edge[1:]
    real = kind[begin] != 0 if len(begin) else np.zeros(0, bool)
    begin, end = begin[real], end[real]
    pw, inv = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOW[data] + np.uint64(1)) * pw[: len(data)], out=total[1:])
    token = mixed((total[end] - total[begin]) * inv[begin] + np.uint64(1))
    upper = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 0x41) & (data <= 0x5A), out=upper[1:])
    n_upper, length = upper[end] - upper[begin], end - begin
    first_upper = upper[begin + 1] - upper[begin] if len(begin) else n_upper
    kinds = kind[begin]
    shape = np.select([kinds == 2, (kinds == 3) & (length == 1), kinds == 3, n_upper == 0, (n_upper == length) & (length > 1), (n_upper == 1) & (first_upper == 1)], [1, 2, 3, 4, 5, 6], 7).astype(np.uint64)
    of = np.searchsorted(at, begin, side="right") - 1
    word = np.flatnonzero(kinds == 1)
    again = (token[word][1:] == token[word][:-1]) & (of[word][1:] == of[word][:-1])
    shape[word[1:][again]] += np.uint64(8)
    shape = mixed(shape)
    parts, owners = [], []
    step = np.uint64(0x9E3779B97F4A7C15)
    for h, most in ((token, 2), (shape, 3)):
        gram = h
        for n in range(1, most + 1):
            if n > 1:
                gram = gram[:-1] * step + h[n - 1 :]
            m = len(gram)
            inside = of[:m] == of[n - 1 :] if m else np.zeros(0, bool)
            parts.append((mixed(gram + np.uint64(n if most == 2 else 16 + n)) % np.uint64(PLACES))[inside].astype(np.int32))
            owners.append(of[:m][inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(parts)[order], np.searchsorted(owner[order], np.arange(len(at)))


@dataclass
class Weights:
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        place, at = features(texts)
        total = np.zeros(len(place) + 1)
        np.cumsum(self.weights[place], out=total[1:])
        n = np.diff(at)
        mean = np.where(n > 0, (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1), 0.0)
        return 1 / (1 + np.exp(-np.clip(self.bias + SCALE * mean, -60, 60)))


class Leader:
    """Follow-the-regularised-leader, one example at a time; the last place is the bias, unregularised."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0005, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -60, 60)))
        g = (p - label) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def _trained(examples: DataFrame, epochs: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            lists = batch.column("places")
            flat, edge = lists.values.to_numpy(), lists.offsets.to_numpy()
            for a, z, label in zip(edge[:-1].tolist(), edge[1:].tolist(), batch.column("label").to_pylist(), strict=True):
                at, c = np.unique(flat[a:z], return_counts=True)
                rows.append((np.append(at, PLACES), np.append(SCALE * c / max(z - a, 1), 1.0).astype(np.float32), label))
        leader = Leader()
        for _ in range(epochs):
            for at, x, label in rows:
                leader.learn(at, x, label)
        w = leader.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["place", "weight"])

    one = examples.repartition(1).sortWithinPartitions("spot", "id").select("places", "label")
    return in_arrow(one, run, "place long, weight double")


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, epochs: int = 4) -> Weights:
    """Weights from about ``sample`` of the labelled rows, chosen by their ids' hashes.

    Only rows of ``docs`` whose id has a label of exactly 0 or 1 take part; null ids, labels and texts don't,
    nor ids with both labels. Rows that repeat an id are learnt from each. Without any label, all weights
    are 0 and every score is 0.5.
    """
    marked = labels.select(labels[id_col].alias("_key"), labels[label].cast("double").alias("label")).where("_key is not null and label in (0, 1)")
    marked = marked.groupBy("_key").agg(F.min("label").cast("int").alias("label"), F.max("label").alias("_most")).where("label = _most").drop("_most")
    spot = F.shiftrightunsigned(F.xxhash64(F.col("_key").cast("string"), F.lit(6)), 11) / float(1 << 53)
    rows = docs.select(docs[id_col].alias("_id"), docs[text].cast("string").alias("_text")).where("_id is not null and _text is not null")
    every = marked.join(rows.select(F.col("_id").alias("_key")).distinct(), "_key", "left_semi").count()
    chosen = marked.withColumn("spot", spot).where(F.col("spot") < min(1.0, sample / max(every, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text", 1 << 20):
            place, at = features(batch.column("_text"))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("spot"), batch.column("label"), ragged(place, at, pa.int32())], names=["id", "spot", "label", "places"])

    kind = rows.schema["_id"].dataType.simpleString()
    joined = rows.join(F.broadcast(chosen), F.col("_id") == F.col("_key")).select("_id", "spot", "label", "_text")
    examples = in_arrow(joined, run, f"id {kind}, spot double, label int, places array<int>")
    got = _trained(examples, epochs).toPandas()
    w = np.zeros(PLACES + 1)
    w[got["place"].to_numpy(np.int64)] = got["weight"].to_numpy(float)
    return Weights(w[:-1].astype(np.float32), float(w[-1]))


def scored(docs: DataFrame, model: Weights, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score of 0 to 1 under ``name``; null counts as the empty text.

    If ``docs`` has that name already, the new one gets underscores before it. Ids aren't looked at.
    """
    name = free_name(docs, name)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, 1 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.scores(batch.column(text)))], names=[*batch.schema.names, name])

    return in_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
