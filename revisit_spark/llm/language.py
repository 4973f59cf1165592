"""Operator 9: language identification, words first, backing off to shorter and shorter character n-grams.

The model has, for each language, the log frequency of frequent words and of frequent n-grams of 1
to 4 characters (words' edges count as a character). A known word scores by its own frequencies;
an unseen word by those of its known 4-grams, if it has none by its 3-grams, and so on. A text's
languages are weighed by the sums over its words. Beside this rank there is a fit, which tells how well
the likeliest language covers the text at all: the share of its words that this language has, where an
unseen word counts by half the share of its 4-grams.

The model is learnt by Spark from all labelled texts. Each language has its own most
frequent entries, so a small one isn't outvoted; there are no more than ENTRIES in all, so the model is
sent to every task. Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, free_name, in_arrow, saved
from .words import mixed, pieces, powers, runs

LONGEST = 4
#: Bounds of the model: words, and n-grams of each length, of a language; and all entries, which very many
#: languages share equally.
WORDS, GRAMS, ENTRIES = 60_000, 30_000, 4_000_000
#: Entries that a task holds while it counts, at 16 bytes each.
HELD = 500_000
#: What an unseen word's 4-grams count next to a known word, in the fit.
NEAR = 0.5
_POINTS = 0x33480  # code points with letters


@cache
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which code points are letters, which are letters or the marks on them, and each one's lower case."""
    chars = [chr(i) for i in range(_POINTS)]
    low = np.arange(_POINTS, dtype=np.uint32)
    for i, c in enumerate(chars):
        if c != (x := c.lower()) and len(x) == 1:
            low[i] = ord(x)
    letter = np.array([c.isalpha() for c in chars])
    return letter, letter | np.array([unicodedata.category(c)[0] == "M" for c in chars]), low


@dataclass
class LetterWords:
    """Runs of letters and the marks after them, lower-cased, each with a space on either side, in one array of code points.

    A word begins at a letter: marks that follow none are in no word.
    """

    points: np.ndarray
    begin: np.ndarray  # of the space before each word
    length: np.ndarray  # with both spaces
    at: np.ndarray  # text i has the words at[i]:at[i+1]

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        pw, inv = powers(len(self.points) + 1)
        total = np.zeros(len(self.points) + 1, np.uint64)
        np.cumsum((self.points.astype(np.uint64) + np.uint64(1)) * pw[: len(self.points)], out=total[1:])
        return total, inv

    def hashes(self, sums, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        total, inv = sums
        return mixed((total[begin + length] - total[begin]) * inv[begin] + length.astype(np.uint64))


def letter_words(texts: list[str | None]) -> LetterWords:
    is_letter, in_word, low = _letters()
    points = np.frombuffer("\n".join(t or "" for t in texts).encode("utf-32-le", "replace"), np.uint32)
    points = np.where(points < _POINTS, points, 0)
    inside = np.concatenate([[False], in_word[points], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    letters = np.append(np.flatnonzero(is_letter[points]), len(points))
    begin = letters[np.searchsorted(letters, begin)]
    begin, end = begin[begin < end], end[begin < end]
    starts = np.cumsum([0] + [len(t or "") + 1 for t in texts])
    length = end - begin + 2
    out = np.full(int(length.sum()), 32, np.uint32)
    first = np.cumsum(length) - length
    inner = runs(first + 1, length - 2)
    out[inner] = low[points[runs(begin, length - 2)]]
    return LetterWords(out, first, length, np.searchsorted(begin, starts))


def gram_places(words: LetterWords, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where n-grams of the chosen words begin, and the place in ``which`` that each belongs to.

    One space is no 1-gram.
    """
    begin, length = words.begin[which], words.length[which]
    if n == 1:
        begin, length = begin + 1, length - 2
    many = np.maximum(length - n + 1, 0)
    return runs(begin, many), np.repeat(np.arange(len(which)), many)


@dataclass
class Table:
    """Entries of words, or of n-grams of one length: sorted hashes, and for each the languages that have it.

    Entry i is in the languages lang[start[i]:start[i + 1]], with a log frequency of ``gain`` over ``base``,
    the log frequency of what a language doesn't have.
    """

    keys: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    base: np.ndarray

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it isn't there."""
        if not len(self.keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)

    def spread(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of lang and gain of these entries, and which of the entries each belongs to."""
        many = self.start[place + 1] - self.start[place]
        return runs(self.start[place], many), np.repeat(np.arange(len(place)), many)


@dataclass
class Model:
    """Languages by name; tables[0] has words, tables[n] n-grams."""

    languages: list[str]
    tables: list[Table] = field(default_factory=list)

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, languages) sums of log frequencies and of covered words, and the number of words of each text."""
        w = letter_words(texts)
        counts, many = np.diff(w.at), len(self.languages)
        text = np.repeat(np.arange(len(texts)), counts)
        total, covered = np.zeros(len(texts) * many), np.zeros(len(texts) * many)
        plain = np.zeros((len(texts), many))
        sums = w.sums()
        place = self.tables[0].find(w.hashes(sums, w.begin, w.length))
        seen = np.flatnonzero(place >= 0)
        rows, of = self.tables[0].spread(place[seen])
        cell = text[seen][of] * many + self.tables[0].lang[rows]
        total += np.bincount(cell, self.tables[0].gain[rows], len(total))
        covered += np.bincount(cell, minlength=len(total))
        plain += np.bincount(text[seen], minlength=len(texts))[:, None] * self.tables[0].base
        open_words = np.flatnonzero(place < 0)
        for n in range(LONGEST, 0, -1):
            if not len(open_words):
                break
            begin, of_word = gram_places(w, open_words, n)
            place = self.tables[n].find(w.hashes(sums, begin, np.full(len(begin), n)))
            known = np.flatnonzero(place >= 0)
            times = np.bincount(of_word[known], minlength=len(open_words))
            rows, of = self.tables[n].spread(place[known])
            word = of_word[known][of]
            cell = text[open_words[word]] * many + self.tables[n].lang[rows]
            total += np.bincount(cell, self.tables[n].gain[rows] / times[word], len(total))
            if n == LONGEST:
                grams = np.bincount(of_word, minlength=len(open_words))
                covered += np.bincount(cell, NEAR / grams[word], len(total))
            plain += np.bincount(text[open_words[times > 0]], minlength=len(texts))[:, None] * self.tables[n].base
            open_words = open_words[times == 0]
        return total.reshape(plain.shape) + plain, covered.reshape(plain.shape), counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Each text's likeliest language, its share and its fit; ``und`` and 0 without a letter or a language."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        sums, covered, counts = self.scores(texts)
        best = sums.argmax(axis=1)
        share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        fit = covered[np.arange(len(best)), best] / np.maximum(counts, 1)
        there = counts > 0
        return [self.languages[k] if n else "und" for k, n in zip(best.tolist(), counts.tolist(), strict=True)], np.where(there, share, 0.0), np.where(there, fit, 0.0)


def _counts(docs: DataFrame) -> DataFrame:
    """(n, key, lang, c): words (n = 0) and n-grams of the labelled texts (lang, _text).

    A task adds up what it has counted until it holds HELD entries, then sends it; most repeats end there.
    """

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        key, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return key, np.bincount(at, np.concatenate([c for _, c in held]), len(key)).astype(np.int64)

    def sent(cells: dict) -> Iterator[pa.RecordBatch]:
        for (name, n), held in cells.items():
            key, c = added(held)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), n, np.int32)), pa.array(key.view(np.int64)), pa.array([name], pa.string()).take(pa.array(np.zeros(len(key), np.int32))), pa.array(c)], names=["n", "key", "lang", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        many = lambda: sum(len(k) for held in cells.values() for k, _ in held)
        for batch in pieces(batches, "_text", 1 << 18):
            langs = batch.column("lang").to_pylist()
            w = letter_words(batch.column("_text").to_pylist())
            lang, sums = np.repeat(np.arange(len(langs)), np.diff(w.at)), w.sums()
            names = {x: k for k, x in enumerate(sorted(set(langs)))}
            number = np.array([names[x] for x in langs], np.int64)
            lang = number[lang] if len(lang) else lang
            for name, k in names.items():
                mine = np.flatnonzero(lang == k)
                for n in range(LONGEST + 1):
                    if n:
                        begin, _ = gram_places(w, mine, n)
                        h = w.hashes(sums, begin, np.full(len(begin), n))
                    else:
                        h = w.hashes(sums, w.begin[mine], w.length[mine])
                    cells.setdefault((name, n), []).append(np.unique(h, return_counts=True))
            if many() > HELD:
                cells = {at: [added(held)] for at, held in cells.items()}
                if many() > HELD // 2:
                    yield from sent(cells)
                    cells = {}
        yield from sent(cells)

    return in_arrow(docs.select("lang", "_text"), run, "n int, key long, lang string, c long").groupBy("n", "key", "lang").agg(F.sum("c").alias("c"))


def _least_counts(counts: DataFrame, words: int, grams: int, entries: int) -> tuple[dict, dict]:
    """For each (n, language): the least count that the model keeps, so that not more entries than allowed
    have it, and all counts' sum.

    Found from how many entries have each count; entries of one count stay or go together. A window holds
    one row for each count that occurs, whatever the number of entries.
    """
    levels = counts.groupBy("n", "lang", "c").agg(F.count("*").alias("m"))
    languages = max(1, counts.select("lang").distinct().count())
    share = max(1, entries // (languages * (LONGEST + 1)))
    room = F.when(F.col("n") > 0, min(grams, share)).otherwise(min(words, share))
    above = F.sum("m").over(Window.partitionBy("n", "lang").orderBy(F.desc("c")))
    kept = levels.withColumn("kept", above <= room).groupBy("n", "lang").agg(F.coalesce(F.min(F.when(F.col("kept"), F.col("c"))), F.max("c") + 1).alias("least"), F.sum(F.col("c") * F.col("m")).alias("every"))
    found = kept.collect()
    return {(r.n, r.lang): r.least for r in found}, {(r.n, r.lang): r.every for r in found}


def labelled(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, _text) of all labelled documents; null languages and texts are left out. Ids aren't looked at."""
    rows = docs.select(docs[lang].cast("string").alias("lang"), docs[text].cast("string").alias("_text"))
    return rows.where("lang is not null and _text is not null")


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", words: int = WORDS, grams: int = GRAMS, entries: int = ENTRIES) -> Model:
    """A model of all labelled texts: each language's ``words`` most frequent words and ``grams`` most frequent
    n-grams of each length, less if all were more than ``entries``.

    No language is left out. Without any labelled text the model has none. Five rows for each language come
    to the driver, then the model's entries.
    """
    counts = saved(_counts(labelled(docs, text, lang)), "language")
    least, every = _least_counts(counts, words, grams, entries)
    if not least:
        return Model([])
    names = sorted({k for _, k in least})
    place = {k: i for i, k in enumerate(names)}
    limits = counts.sparkSession.createDataFrame([(n, k, place[k], c) for (n, k), c in least.items()], "n int, lang string, place int, least long")
    got = counts.join(F.broadcast(limits), ["n", "lang"]).where("c >= least").select("n", "key", "place", "c").toArrow()  # numbers only: no object for each entry
    forget(counts)
    tables = []
    for n in range(LONGEST + 1):
        mine = got.filter(pa.compute.equal(got.column("n"), n))
        h, of, c = mine.column("key").to_numpy().view(np.uint64), mine.column("place").to_numpy(), mine.column("c").to_numpy().astype(float)
        order = np.lexsort((of, h))
        h, of, c = h[order], of[order], c[order]
        keys, start = np.unique(h, return_index=True)
        whole = np.array([every.get((n, k), 0) for k in names], float)
        tables.append(Table(keys, np.append(start, len(h)), of, np.log(2 * c + 1).astype(np.float32), np.log(0.5 / (whole + 0.5 * max(len(keys), 1)))))
    return Model(names, tables)


NAMES = ("lang_pred", "lang_score", "lang_fit")


def identified(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = NAMES) -> DataFrame:
    """``docs`` with the predicted language, its score and its fit (both 0 to 1) under ``names``.

    A name that ``docs`` has already gets underscores before it (see ``result_names``). A text that is
    null or has no letter is ``und`` with score and fit 0. Ties go to the first language by name. Ids
    aren't looked at: null and repeated ones get their texts' results.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    made = result_names(docs, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, 1 << 18):
            pred, score, fit = sent.value.predict(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(fit, pa.float64())], names=[*batch.schema.names, *made])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(made, (T.StringType(), T.DoubleType(), T.DoubleType()), strict=True))])
    return in_arrow(docs, run, schema)


def result_names(docs: DataFrame, names: tuple[str, ...] = NAMES) -> tuple[str, ...]:
    """The names that ``identified`` gives its columns beside those of ``docs``."""
    return tuple(free_name(docs, n) for n in names)


def least_fits(found: DataFrame, lang: str = "lang", names: tuple[str, str, str] = NAMES, share: float = 0.5, low: float = 0.01) -> dict[str, float]:
    """For each language the fit that a text of it has for sure: ``share`` of what all but the ``low`` part of its
    labelled texts reach that are identified (``found``, under ``names``) as it.

    All of them count, by fits in ten-thousandths; one row for each language comes to the driver.
    """
    pred, _, fit = map(F.col, names)
    right = found.where(pred == F.col(lang).cast("string"))
    levels = right.groupBy(pred.alias("lang"), F.floor(fit * 10_000).alias("level")).agg(F.count("*").alias("m"))
    by_lang = Window.partitionBy("lang")
    below = F.sum("m").over(by_lang.orderBy("level"))
    reached = levels.withColumns({"below": below, "all": F.sum("m").over(by_lang)}).where(F.col("below") >= F.col("all") * low)
    return {r.lang: share * r.level / 10_000 for r in reached.groupBy("lang").agg(F.min("level").alias("level")).collect()}


def has_language(pred: Column, score: Column, fit: Column, fits: dict[str, float], least: float = 0.5) -> Column:
    """Whether a prediction names a language, with at least that score, that also fits."""
    known = F.create_map(*(F.lit(x) for kv in fits.items() for x in kv)) if fits else F.lit(None).cast("map<string,double>")
    return (pred != "und") & (score >= least) & (fit >= F.coalesce(F.try_element_at(known, pred), F.lit(0.0)))
