"""Human reviews: rules, supersession, taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normalize import stripped

#: Default categories by outcome, and default root causes.
CATEGORIES = {"rework": ("confirmed_callback", "warranty", "workmanship", "misdiagnosis", "failed_part", "incomplete_repair"), "not_rework": ("scheduled_followup", "customer_caused", "unrelated"), "uncertain": ("unsure",)}
ROOT_CAUSES = ("workmanship", "diagnosis", "part_quality", "parts_availability", "access_or_scheduling", "customer_behaviour", "system_design", "documentation", "other")
_OUTCOME = {"confirmed": "rework", "rejected": "not_rework", "uncertain": "uncertain"}


def categories(spark: SparkSession) -> DataFrame:
    """(key, outcome, counts_toward_cost, active) of the default taxonomy."""
    return spark.createDataFrame([(k, o, o == "rework", True) for o, keys in CATEGORIES.items() for k in keys], "key string, outcome string, counts_toward_cost boolean, active boolean")


def missing_defaults(existing: DataFrame, defaults: DataFrame, keys: list[str] = ["key"]) -> DataFrame:  # noqa: B006
    """Default rows that a tenant doesn't have; what it has under the same key stays as it is."""
    return defaults.join(existing.select(*keys), keys, "left_anti")


def judged(log: DataFrame, taxonomy: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Reviews with ``refused``: null where a review is fine, else the first rule that it breaks.

    ``taxonomy`` is per tenant (organization_id, key, ..), as keys are unique within one; without organization_id it
    holds for all. ``candidates`` (candidate_id, suppressed, maybe basis_points and rule_set) tells which may be reviewed;
    what they have of score and rule set is kept with the review as it was then.
    """
    on = [c for c in ("organization_id",) if c in taxonomy.columns] + ["category"]
    rows = log.join(taxonomy.select(*on[:-1], F.col("key").alias("category"), "outcome", "active"), on, "left")
    there = F.lit(None).cast("string")
    if candidates is not None:
        then = [c for c in ("basis_points", "rule_set") if c in candidates.columns]
        rows = rows.join(candidates.select("candidate_id", F.col("suppressed").alias("_suppressed"), *(F.col(c).alias(f"{c}_at_review") for c in then)), "candidate_id", "left")
        there = F.when(F.col("_suppressed").isNull(), "unknown_candidate").when(F.col("_suppressed"), "candidate_suppressed")
    wanted = F.create_map(*(F.lit(x) for kv in _OUTCOME.items() for x in kv))[F.col("decision")]
    refused = (
        F.when(wanted.isNull(), "unknown_decision")
        .when((F.col("decision") == "confirmed") & F.col("category").isNull(), "category_required")
        .when(F.col("category").isNotNull() & ~F.coalesce("active", F.lit(False)), "unknown_category")
        .when(F.col("category").isNotNull() & (F.col("outcome") != wanted), "category_does_not_fit")
        .when(F.col("root_cause").isNotNull() & (F.col("decision") != "confirmed"), "root_cause_not_allowed")
    )
    return rows.withColumns({"refused": F.coalesce(there, refused), "note": F.when(stripped(F.col("note")) != "", F.col("note"))}).drop("_suppressed")


def chained(log: DataFrame) -> DataFrame:
    """Each review with the one that supersedes it; the last of a candidate is current."""
    order = Window.partitionBy("candidate_id").orderBy("decided_at", "id")
    return log.withColumn("superseded_by", F.lead("id").over(order)).withColumn("current", F.col("superseded_by").isNull())


def history(log: DataFrame, candidate_id=None) -> DataFrame:
    """Reviews with ``place``: 1 for a candidate's latest; of one candidate only if asked."""
    own = log if candidate_id is None else log.where(F.col("candidate_id") == candidate_id)
    return own.withColumn("place", F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.desc("decided_at"), F.desc("id"))))


def causes(spark: SparkSession) -> DataFrame:
    """(key, active) of the default root causes."""
    return spark.createDataFrame([(k, True) for k in ROOT_CAUSES], "key string, active boolean")
