"""Files known by their bytes, whatever their size."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Digests are combined as a polynomial modulo a prime of 255 bits, at a point that no one chooses lines for.
_PRIME = (1 << 255) - 19
_POINT = int.from_bytes(hashlib.sha256(b"combined digests of lines").digest(), "big") % _PRIME


def _blocks(lines: DataFrame) -> DataFrame:
    """(file, size, block, n, sum): the lines of each block of a file, in order, as one number modulo the prime."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, total = None, 0, 0
        done: list[tuple] = []
        for batch in batches:
            keys = zip(batch.column("file").to_pylist(), batch.column("size").to_pylist(), batch.column("block").to_pylist(), strict=True)
            for key, line in zip(keys, batch.column("line"), strict=True):
                if key != at:
                    if at is not None:
                        done.append((*at, n, total))
                    at, n, total = key, 0, 0
                total = (total * _POINT + int.from_bytes(hashlib.sha256(line.as_buffer()).digest(), "big")) % _PRIME
                n += 1
        if at is not None:
            done.append((*at, n, total))
        columns = list(zip(*done, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:4]), pa.array([x.to_bytes(32, "big") for x in columns[4]], pa.binary())], names=["file", "size", "block", "n", "sum"])

    return lines.mapInArrow(run, "file string, size long, block long, n long, sum binary")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, digest): a digest of each file's bytes, the same for the same bytes, however a file is cut.

    Blocks of a file are digested by many tasks, line by line, and combined: the combination doesn't depend on where
    the cuts are, so files beyond what one task can hold work, and digests of different runs compare. Empty
    files, which have no blocks, have the digest of no lines.
    """
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")]
    lines = spark.read.option("lineSep", "\n").text(path).select(*meta, F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))

    def combined(part: pd.DataFrame) -> pd.DataFrame:
        total = 0
        for n, x in part.sort_values("block")[["n", "sum"]].itertuples(index=False):
            total = (total * pow(_POINT, int(n), _PRIME) + int.from_bytes(x, "big")) % _PRIME
        size = int(part["size"].iloc[0])
        return pd.DataFrame({"file": part["file"].iloc[:1], "size": [size], "digest": [hashlib.sha256(f"{size}:{total:064x}".encode()).hexdigest()]})

    found = _blocks(lines).groupBy("file").applyInPandas(combined, "file string, size long, digest string")
    none = hashlib.sha256(f"0:{0:064x}".encode()).hexdigest()
    return found.union(spark.createDataFrame([(name, 0, none) for name in _empty(spark, path)], found.schema))


def _empty(spark: SparkSession, path: str) -> list[str]:
    """Files without bytes, which no scan has a block of, by their names alone."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return [re.sub("^file:/(?!/)", "file:///", s.getPath().toUri().toString()) for s in found if s.isFile() and s.getLen() == 0]
