"""Imports as they arrive: duplicates over chunks, and detection for what a batch touched."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..operators import candidates, pairs, resolve, scoring, signals, validate
from ..sources import parts
from ..sources.tables import staged

KEYS = ["organization_id", "id"]


def first_rows(rows: DataFrame, time: str = "arrived_at", gap: str = "7 days") -> DataFrame:
    """A stream's rows but for those whose (batch_id, row_hash) arrived before.

    State is kept for ``gap``, which must exceed the longest pause between parts of one batch; ``Seen`` keeps it
    for as long as the batch lasts.
    """
    have = rows if "row_hash" in rows.columns else rows.withColumn("row_hash", validate.row_hash(F.col("raw")))
    return have.withWatermark(time, gap).dropDuplicatesWithinWatermark(["batch_id", "row_hash"])


@dataclass(frozen=True)
class Seen:
    """Row hashes of batches that haven't ended, stored under ``root`` by batch: a duplicate is known however late it comes."""

    root: str

    def marked(self, rows: DataFrame, number: int) -> DataFrame:
        """A micro-batch's rows; those whose hash came before, in it or in an earlier one, are skipped_duplicate.

        Only hashes of this micro-batch's own batches are read. A micro-batch that runs twice finds the same.
        """
        spark, have = rows.sparkSession, rows if "row_hash" in rows.columns else rows.withColumn("row_hash", validate.row_hash(F.col("raw")))
        have = staged(have)
        own = have.groupBy("batch_id", "row_hash").agg(F.min("row_number").alias("_first"))
        earlier = own.select("batch_id", "row_hash").limit(0)
        if parts.there(spark, self.root):
            batches = [r[0] for r in have.select("batch_id").distinct().collect()]
            earlier = spark.read.schema("row_hash string, batch_id string, number int").parquet(self.root).where(F.col("batch_id").isin(*map(str, batches)) & (F.col("number") < number)).select("batch_id", "row_hash").distinct()
        known = earlier.select(F.col("batch_id").cast(have.schema["batch_id"].dataType).alias("batch_id"), "row_hash", F.lit(True).alias("_known"))
        first = staged(own.join(known, ["batch_id", "row_hash"], "left"))
        new = first.where("_known is null").select(F.col("batch_id").cast("string").alias("batch_id"), F.lit(number).alias("number"), "row_hash")
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "number").parquet(self.root)
        both = have.join(first, ["batch_id", "row_hash"])
        again = F.coalesce("_known", F.lit(False)) | (F.col("row_number") > F.col("_first"))
        issues = F.when(again, F.concat(F.col("issues").cast(validate.n.ISSUES), F.array(validate.n.issue("DUPLICATE_ROW_IN_FILE", "info")))).otherwise(F.col("issues"))
        return both.withColumns({"status": F.when(again, "skipped_duplicate").otherwise(F.col("status")), "issues": issues}).drop("_known", "_first")

    def ended(self, spark: SparkSession, batch_id: str) -> None:
        """Forgets a batch that is complete."""
        fs, at = parts._folder(spark, f"{self.root}/batch_id={batch_id}")
        fs.delete(at, True)


@dataclass(frozen=True)
class Snapshots:
    """Jobs and candidates under ``root``, dealt by month and key, which arriving jobs change where they touch them.

    Jobs lie by the month of their date and their key's bucket, candidates by their prior's. An index has
    each key's months, a few bytes per arrival, appended; so a job that moves to another date is found. Of the
    tables only those partitions are read that hold arriving keys, or visits within ``window`` days of them.
    """

    root: str
    window: int = 30
    cap: int = 25
    buckets: int = 16
    rules: tuple[signals.Rule, ...] = signals.DEFAULT_RULES
    order: str = "arrived_at"

    def arrive(self, rows: DataFrame, number: int, equipment: DataFrame | None = None, line_items: DataFrame | None = None) -> dict[str, list[tuple[str, int]]]:
        """Upserts a micro-batch and detects what it affects; gives the partitions replaced, by table.

        A micro-batch that runs twice leaves the same: jobs and candidates are replaced, index and scores lie
        under its number.
        """
        name, spark = f"batch-{number}", rows.sparkSession
        new = staged(self._dealt(resolve.jobs_upserted(None, rows, KEYS, name, order=self.order).drop("change")))
        written, touched = self._upserted(spark, new, name, number)
        self._run(spark, new.schema, touched, name, number, written, equipment, line_items)
        return written

    def jobs(self, spark: SparkSession, schema: StructType) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{self.root}/jobs")

    def candidates(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/candidates").drop("month", "bucket")

    def _dealt(self, jobs: DataFrame) -> DataFrame:
        return jobs.withColumns({"month": parts.month(F.col("service_date")), "bucket": parts.bucket(KEYS, self.buckets)})

    def _upserted(self, spark: SparkSession, new: DataFrame, name: str, number: int) -> tuple[dict, DataFrame]:
        """Writes the jobs; the partitions replaced, and the touched jobs as they were and as they are."""
        path, index = f"{self.root}/jobs", f"{self.root}/index"
        keys = {k: new.schema[k].dataType for k in KEYS}
        homes = parts.of(new)
        if parts.there(spark, index):
            known = spark.read.parquet(index).where(F.col("bucket").isin(sorted({b for _, b in homes})) & (F.col("number") < number))
            known = known.select(*(F.col(k).cast(t).alias(k) for k, t in keys.items()), "month", "bucket").join(new.select(*KEYS), KEYS, "left_semi")
            homes = sorted({*homes, *parts.of(known)})
        old = parts.read(spark, path, new.schema, homes)
        # A job may lie in two partitions only after this batch's own run broke off between them; its own rows don't count then.
        own = old.where(F.col("last_import_batch_id") == name)
        if not own.isEmpty():
            before = old.where(F.col("last_import_batch_id") != name)
            old = before.unionByName(own.join(before.select(*KEYS), KEYS, "left_anti").select(*old.columns))
        narrow = [*KEYS, "customer_id", "equipment_id", "location_id", "service_date", "status", "month", "bucket"]
        touched = staged(new.select(*narrow, F.lit(True).alias("now")).union(old.join(new.select(*KEYS), KEYS, "left_semi").select(*narrow, F.lit(False))))
        plain = new.drop("month", "bucket", "first_import_batch_id", "last_import_batch_id")
        merged = resolve.jobs_upserted(old.drop("month", "bucket"), plain, KEYS, name, unique=True)
        parts.replace(self._dealt(merged.drop("change")).select(*new.columns), path, homes)
        new.select(*KEYS, "month", "bucket", F.lit(number).alias("number")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("number", "bucket").parquet(index)
        return {"jobs": homes}, touched

    def _run(self, spark: SparkSession, schema: StructType, touched: DataFrame, name: str, number: int, written: dict, equipment: DataFrame | None, line_items: DataFrame | None) -> None:
        day, days = F.col("service_date"), self.window
        months = lambda first, last: F.explode(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month")))
        near = touched.where("service_date is not null").select(months(F.date_sub(day, days), day).alias("first")).distinct()
        ahead = near.select(months(F.col("first"), F.date_add(F.last_day("first"), days)).alias("first")).distinct()
        wide = sorted(r[0] for r in ahead.select(parts.month(F.col("first"))).collect())  # months of a calendar
        scope = pairs.visits(parts.read(spark, f"{self.root}/jobs", schema, months=wide))  # written just now, and not changed below
        own = touched.where(F.col("now") & F.col("status").isin(*pairs.VISITED))
        affected, neighbours = touched.select(*KEYS), None
        for key in pairs.KEYS:
            at = touched.where(F.col(key).isNotNull()).select("organization_id", key, F.col("service_date").alias("_at")).distinct().alias("t")
            near_in_time = (F.col("s.service_date") <= F.col("t._at")) & (F.col("s.service_date") >= F.date_sub("t._at", days))
            same = (F.col("s.organization_id") == F.col("t.organization_id")) & (F.col(f"s.{key}") == F.col(f"t.{key}"))
            affected = affected.union(scope.alias("s").join(at, same & near_in_time, "left_semi").select(*KEYS))
        affected = staged(affected.distinct())
        priors = scope.join(affected, KEYS, "left_semi")
        for key in pairs.KEYS:
            found = scope.join(priors.where(F.col(key).isNotNull()).select("organization_id", key).distinct(), ["organization_id", key], "left_semi").select(*KEYS)
            neighbours = found if neighbours is None else neighbours.union(found)
        small = staged(scope.join(neighbours.union(affected).distinct(), KEYS, "left_semi"))
        prior_ids = affected.withColumnRenamed("id", "prior_id")
        found = staged(pairs.candidate_pairs(small, days, self.cap).join(prior_ids, ["organization_id", "prior_id"], "left_semi"))
        self._snapshot(spark, found, affected, scope.select(*KEYS).union(own.select(*KEYS)), touched, scope, name, written)
        context = signals.pair_context(found, small, equipment, line_items, days)
        scored = scoring.scored(signals.evaluated(context, self.rules), self.rules)
        scored.withColumn("number", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("number").parquet(f"{self.root}/scores")

    def _snapshot(self, spark: SparkSession, found: DataFrame, affected: DataFrame, present: DataFrame, touched: DataFrame, scope: DataFrame, name: str, written: dict) -> None:
        path = f"{self.root}/candidates"
        now = scope.select(*KEYS, "month", "bucket").union(touched.select(*KEYS, "month", "bucket")).join(affected, KEYS, "left_semi")
        homes = parts.of(now)
        lie = scope.select(*KEYS, "month").union(touched.where("now").select(*KEYS, "month")).distinct()
        current = lie.select("organization_id", F.col("id").alias("prior_id"), F.col("month").alias("_month"))
        schema = StructType([*candidates.upserted(None, found, name).drop("change").schema.fields, *(f for f in scope.schema.fields if f.name in parts.PARTS)])
        old = parts.read(spark, path, schema, homes)
        lies = old.select(*candidates.KEYS, F.col("month").alias("_old_month"))
        after = candidates.upserted(old.drop(*parts.PARTS), found, name)
        after = candidates.out_of_window(after, present, name, priors=affected).drop("change")
        after = after.join(lies, candidates.KEYS, "left").join(current, ["organization_id", "prior_id"], "left")
        bucket = F.pmod(F.xxhash64(F.col("organization_id").cast("string"), F.col("prior_id").cast("string")), F.lit(self.buckets)).cast("int")
        after = after.withColumns({"month": F.coalesce("_month", "_old_month"), "bucket": bucket}).drop("_month", "_old_month")
        parts.replace(after, path, homes)
        written["candidates"] = homes


def on_arrival(jobs: DataFrame, store: Snapshots, checkpoint: str, equipment: DataFrame | None = None, line_items: DataFrame | None = None) -> DataStreamWriter:
    """Upserts each micro-batch of a stream of jobs into ``store`` and detects what it affects."""
    return jobs.writeStream.foreachBatch(lambda rows, number: store.arrive(rows, number, equipment, line_items) and None).trigger(availableNow=True).option("checkpointLocation", checkpoint)
