"""Search of jobs by words: postings with positions, dealt by word, of which a search reads its own words' alone."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.normalize import search_words

TEXTS = ("summary", "description", "symptoms", "diagnosis", "resolution")
#: Partitions of an index; one word's postings lie in one of them, in order of words within its files.
BUCKETS = 256
#: Files that a partition may have: very common words' postings are written by several tasks.
SPREAD = 8
#: Bytes of rows that are sent to a Python worker at a time, unless the session names its own bound.
BATCH = "4m"


def bucket(word: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def _packed(jobs: DataFrame, texts: tuple[str, ...], buckets: int) -> DataFrame:
    """(organization_id, id, bucket, words, ats): a job's postings of one partition as two texts, words and their places.

    A job's words are grouped where the job is, so they don't move for it, and what they are sent with is sent once for many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            org, key, words, homes = b.columns
            row, size = words.value_parent_indices().to_numpy(), words.value_lengths().fill_null(0).to_numpy()
            place, home = np.arange(len(row)) - (np.cumsum(size) - size)[row], homes.flatten().to_numpy()
            word = words.flatten().cast(pa.string()).dictionary_encode()
            code = word.indices.to_numpy()
            order = np.lexsort((code, home, row))  # stable: places stay in order
            row, home, code = row[order], home[order], code[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (home[1:] != home[:-1])
            posting = new.copy()
            posting[1:] |= code[1:] != code[:-1]
            at, first = np.flatnonzero(posting), np.flatnonzero(new)
            joined = lambda starts, end, x, by: pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, end).astype(np.int32)), x), by)
            ats, lists = joined(at, len(row), pa.array(place[order]).cast(pa.string()), ","), np.searchsorted(at, first)
            columns = [org.take(pa.array(row[first])), key.take(pa.array(row[first])), pa.array(home[first]), joined(lists, len(at), word.dictionary.take(pa.array(code[at])), " "), joined(lists, len(at), ats, " ")]
            yield pa.RecordBatch.from_arrays(columns, names=["organization_id", "id", "bucket", "words", "ats"])

    conf, key = jobs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, BATCH)
    words = search_words(*(F.col(c) for c in texts if c in jobs.columns))
    rows = jobs.select("organization_id", "id", words.alias("words")).withColumn("homes", F.transform("words", lambda w: bucket(w, buckets)))
    schema = StructType([*rows.schema.fields[:2], StructField("bucket", IntegerType()), StructField("words", StringType()), StructField("ats", StringType())])
    return rows.mapInArrow(run, schema)


def _each(packed: DataFrame) -> DataFrame:
    one = packed.select("organization_id", "id", "bucket", F.explode(F.arrays_zip(F.split("words", " ").alias("word"), F.split("ats", " ").alias("at"))).alias("p"))
    return one.select("organization_id", "id", F.col("p.word").alias("word"), F.split("p.at", ",").cast("array<int>").alias("at"), "bucket")


def postings(jobs: DataFrame, texts: tuple[str, ...] = TEXTS) -> DataFrame:
    """(organization_id, id, word, at): each word of each job, with its places (from 0) in all of the texts, in order.

    Null texts have no words; those of further texts go on counting.
    """
    return _each(_packed(jobs, texts, 1)).drop("bucket")


def write_index(jobs: DataFrame, path: str, texts: tuple[str, ...] = TEXTS, buckets: int = BUCKETS) -> None:
    """Replaces the index. Files are sorted by word, so that within a partition other words' row groups are skipped.

    Postings move once, packed, to their partition's file, where they are unpacked.
    """
    rows = _each(_packed(jobs, texts, buckets).repartition("bucket", F.pmod(F.xxhash64("organization_id", "id"), F.lit(SPREAD))))
    rows.sortWithinPartitions("bucket", "word", "organization_id", "id").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)


def asked_words(spark: SparkSession, asked: str, buckets: int = BUCKETS) -> tuple[list[list[str]], dict[str, int]]:
    """The words of a search, those in double quotes as a phrase, and each one's partition."""
    parts = [p for p in re.split(r'"', asked)]
    found = spark.createDataFrame([(i, p) for i, p in enumerate(parts)], "i int, x string").select("i", search_words(F.col("x")).alias("w")).select("i", "w", F.transform("w", lambda w: bucket(w, buckets)).alias("b"))
    phrases, homes = [], {}
    for r in sorted(found.collect(), key=lambda r: r.i):
        homes |= dict(zip(r.w, r.b, strict=True))
        phrases += [list(r.w)] if r.i % 2 else [[w] for w in r.w]
    return [p for p in phrases if p], homes


def search(spark: SparkSession, path: str, asked: str, organization_id=None, buckets: int = BUCKETS) -> DataFrame:
    """(organization_id, id) of jobs with all words of ``asked``, and with those in double quotes side by side.

    Only the partitions and row groups of these words are read. A search without words finds nothing.
    """
    phrases, homes = asked_words(spark, asked, buckets)
    rows = spark.read.parquet(path)
    if organization_id is not None:
        rows = rows.where(F.col("organization_id") == organization_id)
    rows = rows.where(F.col("bucket").isin(sorted(set(homes.values()))) & F.col("word").isin(sorted(homes)))
    words = sorted(homes)
    of = [F.max_by("at", F.when(F.col("word") == w, 1)).alias(f"at{i}") for i, w in enumerate(words)]
    both = rows.groupBy("organization_id", "id").agg(*of or [F.count("*").alias("n")])
    if not words:
        return both.where("false").select("organization_id", "id")
    at = {w: F.col(f"at{i}") for i, w in enumerate(words)}
    every = reduce(lambda x, y: x & y, (c.isNotNull() for c in at.values()))

    def beside(phrase: list[str]) -> Column:
        return F.exists(at[phrase[0]], lambda x: reduce(lambda a, b: a & b, (F.array_contains(at[w], x + k) for k, w in enumerate(phrase))))

    side = [beside(p) for p in phrases if len(p) > 1]
    return both.where(reduce(lambda x, y: x & y, side, every)).select("organization_id", "id")
