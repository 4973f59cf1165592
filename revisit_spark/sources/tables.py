"""Tables of the data model on Parquet, and stages of long jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def write(df: DataFrame, root: str, name: str, by: str | None = None) -> None:
    """Replaces a table, or with ``by`` those of its partitions that ``df`` has rows of (run again, same result)."""
    if by is None:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    else:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{root}/{name}")


def stage_path(spark: SparkSession, name: str = "stage") -> str:
    """A new path in the shared folder of the cluster; a local one only where none is named (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="spark-stage-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written into the shared folder of the cluster and read again, so that plans stay short.

    With zstd: rows of imports are digests in hex for a large part, which snappy leaves as they are.
    """
    spark, path = df.sparkSession, stage_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(stage: DataFrame) -> None:
    """Deletes a table of ``staged`` whose only readers have been written themselves."""
    path = stage.__dict__.get("_written_to")
    if path is not None:
        at = stage.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(stage.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def bucketed(df: DataFrame, keys: list[str]) -> DataFrame:
    """``staged``, dealt by ``keys`` into as many buckets as shuffles have partitions: joins on the keys don't move it again.

    A bucket is one file, in order of the keys. The table is known to this session alone, by a name that is never used again.
    """
    spark, path = df.sparkSession, stage_path(df.sparkSession, "buckets")
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"buckets_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return spark.table(name)
