"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Word characters' complements, as Java patterns.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of rows that are sent to a Python worker at a time.
BATCH = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where none is named (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master.startswith("local"):
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", found)
        return found
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def saved(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: lineage ends there.

    The written rows are what every later pass sees, so that a pass that runs twice (a lost
    executor, a second use) can't see other row ids or another order.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``saved`` that nothing reads any more, so that a long job's folder doesn't grow by each step.

    Only for tables whose readers have been written themselves: those need no lineage behind them.
    """
    for df in tables:
        path = df.__dict__.get("_written_to")
        if path is not None:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def in_arrow(rows: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` in batches of ``BATCH`` bytes, unless the session names its own bound.

    By Spark's own bound (10,000 rows or 64 MB) each task holds some batches of that size in the JVM and again in Python.
    """
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, BATCH)
    return rows.mapInArrow(run, schema)


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text, the same wherever it is; null for null."""
    return F.unhex(F.md5(text.cast("binary")))


def id_remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of its names."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = "_" + name
    return name
