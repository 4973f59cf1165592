"""Tables dealt into partitions by a month and a key's hash, of which a job reads and replaces only those it touches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns that a row's partition is told by.
PARTS = ["month", "bucket"]


def month(day: Column) -> Column:
    """2024-05; a row without a day is in ``none``."""
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("none"))


def bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(buckets)).cast("int")


def of(rows: DataFrame) -> list[tuple[str, int]]:
    """The partitions that rows (month, bucket) are in; at most the calendar's months times the buckets."""
    return sorted((r.month, r.bucket) for r in rows.select(*PARTS).distinct().collect())


def _within(parts: list[tuple[str, int]]) -> Column:
    by: dict[str, list[int]] = {}
    for m, b in parts:
        by.setdefault(m, []).append(b)
    return reduce(lambda x, y: x | y, ((F.col("month") == m) & F.col("bucket").isin(bs) for m, bs in by.items()), F.lit(False))


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def there(spark: SparkSession, path: str) -> bool:
    fs, at = _folder(spark, path)
    return fs.exists(at)


def _files(spark: SparkSession, path: str) -> set[str]:
    fs, at = _folder(spark, f"{path}/month=*/bucket=*/*")
    return {f.getPath().toString() for f in fs.globStatus(at) or ()}


def read(spark: SparkSession, path: str, schema: StructType, parts: list[tuple[str, int]] | None = None, months: list[str] | None = None) -> DataFrame:
    """Rows of these partitions, or months (all if neither is given); none where the table isn't there yet.

    Files of other partitions aren't opened: the conditions are on partition columns alone.
    """
    if not there(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path)
    if parts is not None:
        rows = rows.where(_within(parts))
    return rows if months is None else rows.where(F.col("month").isin(months))


def replace(rows: DataFrame, path: str, parts: list[tuple[str, int]]) -> None:
    """The partitions ``parts`` hold ``rows`` from now on, and nothing where there are none; no other one is touched.

    ``rows`` may come from the same partitions: Spark moves files to their places when all of them are written. A row of
    any other partition fails the write before that. Run again, it leaves the same.
    """
    spark, before = rows.sparkSession, _files(rows.sparkSession, path)
    month = F.when(_within(parts), F.col("month")).otherwise(F.raise_error(F.lit("a row of a partition that was not read")))
    told = rows.withColumn("month", month).repartition(*PARTS)
    told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(path)
    filled = {f.rpartition("/")[0] for f in _files(spark, path) - before}  # files of each write have names of their own
    for m, b in parts:
        fs, at = _folder(spark, f"{path}/month={m}/bucket={b}")
        if not any(f.endswith(f"/month={m}/bucket={b}") for f in filled):
            fs.delete(at, True)
