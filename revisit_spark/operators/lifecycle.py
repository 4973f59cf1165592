"""What is kept and what goes: evidence, payloads, jobs, imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["organization_id", "prior_id", "followup_id"]


def evidence_retained(evidence: DataFrame, order: str = "run_no", earlier: int = 2) -> DataFrame:
    """Evidence of each candidate's current run and the ``earlier`` runs before it that it was in."""
    runs = Window.partitionBy(*PAIR).orderBy(F.desc(order))
    return evidence.withColumn("_run", F.dense_rank().over(runs)).where(F.col("_run") <= 1 + earlier).drop("_run")


def jobs_retained(jobs: DataFrame, tenants: DataFrame, today: str) -> DataFrame:
    """Jobs within their tenant's retention (months); a tenant that isn't listed keeps all of them."""
    months = tenants.select("organization_id", F.col("retention_months").alias("_months"))
    first = F.add_months(F.lit(today).cast("date"), -F.col("_months"))
    return jobs.join(months, "organization_id", "left").where(F.col("_months").isNull() | (F.col("service_date") >= first)).drop("_months")


def pairs_retained(pairs: DataFrame, kept_jobs: DataFrame) -> DataFrame:
    """Candidates whose both jobs are kept."""
    for side in ("prior_id", "followup_id"):
        pairs = pairs.join(kept_jobs.select("organization_id", F.col("id").alias(side)), ["organization_id", side], "left_semi")
    return pairs


def hanging_on(rows: DataFrame, kept_pairs: DataFrame) -> DataFrame:
    """Evidence, scores, reviews or costs of candidates that are kept."""
    return rows.join(kept_pairs.select(*PAIR), PAIR, "left_semi")


def delete_preview(jobs: DataFrame, pairs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per tenant and import batch what its deletion would do: jobs_deleted (came with it, and no other batch
    touched them), jobs_retained, candidates_deleted (a job of theirs goes) and reviews_destroyed."""
    first, last = F.col("first_import_batch_id"), F.col("last_import_batch_id")
    touched = F.explode(F.array_distinct(F.array(first, last))).alias("batch_id")
    each = jobs.select("organization_id", "id", (first.eqNullSafe(last)).alias("goes"), touched).where("batch_id is not null")
    counts = each.groupBy("organization_id", "batch_id").agg(F.count_if("goes").alias("jobs_deleted"), F.count_if(~F.col("goes")).alias("jobs_retained"))
    gone = each.where("goes").select("organization_id", "id", "batch_id")
    hit = None
    for side in ("prior_id", "followup_id"):
        part = pairs.select(*PAIR).join(gone.withColumnRenamed("id", side), ["organization_id", side]).select(*PAIR, "batch_id")
        hit = part if hit is None else hit.union(part)
    hit = hit.distinct()
    told = reviews.groupBy(*PAIR).agg(F.count("*").alias("_reviews"))
    lost = hit.join(told, PAIR, "left").groupBy("organization_id", "batch_id").agg(F.count("*").alias("candidates_deleted"), F.coalesce(F.sum("_reviews"), F.lit(0)).alias("reviews_destroyed"))
    return counts.join(lost, ["organization_id", "batch_id"], "left").fillna(0, ["candidates_deleted", "reviews_destroyed"])
