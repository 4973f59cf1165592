"""Resolution into operational tables: snapshots in, snapshots out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as n


def resolved(old: DataFrame | None, rows: DataFrame, keys: list[str], columns: list[str], order: str = "row_number") -> DataFrame:
    """One row per key. Of new rows the first value that isn't null counts; what the snapshot has stays.

    Aggregates sum up before the shuffle, so a key with very many rows is no task of its own.
    """
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    new = rows.groupBy(*keys).agg(*first) if first else rows.select(*keys).distinct()
    if old is None:
        return new
    more = [c for c in old.columns if c not in keys and c not in columns]
    both = old.alias("o").join(new.alias("n"), keys, "full_outer")
    return both.select(*keys, *(F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in columns), *(F.col(f"o.{c}") for c in more))


def latest(old: DataFrame | None, rows: DataFrame, keys: list[str], columns: list[str], order: str = "row_number") -> DataFrame:
    """One row per key; the last row's value counts, and new ones go before old ones."""
    new = rows.groupBy(*keys).agg(*(F.max_by(c, order).alias(c) for c in columns))
    if old is None:
        return new
    return old.alias("o").join(new.alias("n"), keys, "full_outer").select(*keys, *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in columns))


def rollup(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("service_date").alias("first_seen"), F.max("service_date").alias("last_seen"), F.count("*").alias("job_count"))


def rolled(snapshot: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Merges first and last dates and adds up counts."""
    names = ["first_seen", "last_seen", "job_count"]
    new = seen.select(*keys, *(F.col(c).alias(f"_{c}") for c in names))
    both = snapshot.join(new, keys, "left")
    old = lambda c: F.col(c) if c in snapshot.columns else F.lit(None)
    merged = {"first_seen": F.least(old("first_seen"), "_first_seen"), "last_seen": F.greatest(old("last_seen"), "_last_seen"), "job_count": F.coalesce(old("job_count"), F.lit(0)) + F.coalesce("_job_count", F.lit(0))}
    if "first_seen" not in snapshot.columns:
        merged = {"first_seen": F.col("_first_seen"), "last_seen": F.col("_last_seen"), "job_count": F.coalesce("_job_count", F.lit(0))}
    return both.select(*(c for c in snapshot.columns if c not in names), *(c.alias(k) for k, c in merged.items()))


def jobs_upserted(old: DataFrame | None, rows: DataFrame, keys: list[str], batch_id: str, order: Column | str = "row_number", by_natural_key: bool | str = False, unique: bool = False) -> DataFrame:
    """The job table after a batch, with change: created, updated, possible_duplicate or kept.

    Of a key's rows in the batch the last one counts and its fields win, nulls too; the first batch that
    a job came with is kept. A batch that meets a job by its natural key may be a duplicate; ``by_natural_key`` tells
    whether that is the key, or names the column that does. With ``unique`` no key comes twice, and ``order`` isn't asked.
    """
    columns = [c for c in rows.columns if c not in keys]
    new = rows if unique else rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("r")).select(*keys, "r.*")
    if old is None:
        return new.select("*", F.lit(batch_id).alias("first_import_batch_id"), F.lit(batch_id).alias("last_import_batch_id"), F.lit("created").alias("change"))
    both = old.withColumn("_old", F.lit(True)).alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), keys, "full_outer")
    seen, known = F.col("n._new").isNotNull(), F.col("o._old").isNotNull()
    natural = F.col(f"n.{by_natural_key}") if isinstance(by_natural_key, str) else F.lit(by_natural_key)
    met = F.when(natural, "possible_duplicate").otherwise("updated")
    return both.select(
        *keys,
        *(F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns),
        F.coalesce("o.first_import_batch_id", F.lit(batch_id)).alias("first_import_batch_id"),
        F.when(seen, F.lit(batch_id)).otherwise(F.col("o.last_import_batch_id")).alias("last_import_batch_id"),
        F.when(seen & known, met).when(seen, "created").otherwise("kept").alias("change"),
    )


def job_id(keys: list[str]) -> Column:
    """A job's id: the same for the same key, whichever batch it comes with."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)), 256)


def row_outcomes(rows: DataFrame, jobs: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows with job_id and final status: imported, updated, or warning for a possible duplicate.

    ``by`` names shorter columns that tell jobs apart as ``keys`` do, for rows and jobs to be joined by. Rows that weren't written (errors, skipped ones, those of no job) keep their status and have no job.
    """
    by = by or keys
    change = jobs.where("change <> 'kept'").select(*by, F.col("change").alias("_change"))
    written = F.col("_change").isNotNull() & F.col("status").isin("pending", "warning")
    status = F.when(F.col("_change") == "created", "imported").when(F.col("_change") == "updated", "updated").when(F.col("_change") == "possible_duplicate", "warning")
    out = rows.join(change, by, "left").withColumns({"job_id": F.when(written, job_id(keys)), "status": F.when(written, status).otherwise(F.col("status"))})
    if "issues" in rows.columns:
        again = F.col("job_id").isNotNull() & (F.col("_change") == "possible_duplicate")
        out = out.withColumn("issues", F.when(again, F.concat(F.col("issues").cast(n.ISSUES), F.array(n.issue("POSSIBLE_DUPLICATE", "warning")))).otherwise(F.col("issues").cast(n.ISSUES)))
    return out.drop("_change")


def notes(old: DataFrame | None, rows: DataFrame) -> DataFrame:
    """One note per tenant, job and body; those already there stay."""
    keys = ["organization_id", "job_id", "content_hash"]
    hashed = rows.withColumn("content_hash", F.sha2("body", 256))
    new = hashed.groupBy(*keys).agg(F.min("note_id").alias("note_id"))
    if old is None:
        return new
    return old.select(*keys, "note_id").unionByName(new.join(old, keys, "left_anti"))


def batch_range(jobs: DataFrame) -> DataFrame:
    """Per batch the dates of the live jobs that it touched last; a batch without any has no row, and no run."""
    live = jobs.where("deleted_at is null") if "deleted_at" in jobs.columns else jobs
    return live.groupBy("batch_id").agg(F.min("service_date").alias("date_from"), F.max("service_date").alias("date_to"))
