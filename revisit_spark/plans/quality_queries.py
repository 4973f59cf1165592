"""Queries of reviews, usage, audit, analytics and retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, audit, lifecycle, queue, reviews, usage
from . import testviews as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, days: tuple[str, ...] = ()):
    """Registers a query; its columns ``days`` are shown as text on both sides."""

    def add(f):
        def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = f(spark, sf_dir)
            return found.withColumns({c: F.col(c).cast("date").cast("string") for c in days}) if days else found

        QUERIES[f.__name__] = shown
        if sql and days:
            SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'{c}::DATE::VARCHAR AS {c}' for c in days)}) FROM ({sql})"
        elif sql:
            SQL[f.__name__] = sql
        return f

    return add


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as reviews of their conversation."""
    c = v.table(spark, sf_dir, "conversations")
    decision = F.when(F.col("role") == "user", "confirmed").when(F.col("role") == "assistant", "rejected").otherwise("uncertain")
    category = F.when(F.col("turn") % 4 == 0, F.lit(None)).when(F.col("role") == "user", "warranty").when(F.col("role") == "assistant", "unrelated").otherwise("unsure")
    return c.select(F.col("conv_id").alias("candidate_id"), F.col("turn").cast("long").alias("id"), F.col("turn").cast("long").alias("decided_at"), decision.alias("decision"), category.alias("category"), F.when(F.col("turn") % 3 == 0, "other").alias("root_cause"), F.col("text").alias("note"))


_LOG = """WITH r AS (SELECT DISTINCT conv_id AS candidate_id, turn::BIGINT AS id, CASE role WHEN 'user' THEN 'confirmed' WHEN 'assistant' THEN 'rejected' ELSE 'uncertain' END AS decision,
 CASE WHEN turn % 4 = 0 THEN NULL WHEN role = 'user' THEN 'warranty' WHEN role = 'assistant' THEN 'unrelated' ELSE 'unsure' END AS category, CASE WHEN turn % 3 = 0 THEN 'other' END AS root_cause FROM conversations)"""


@query(_LOG + " SELECT candidate_id, id, decision, CASE WHEN decision = 'confirmed' AND category IS NULL THEN 'category_required' WHEN root_cause IS NOT NULL AND decision <> 'confirmed' THEN 'root_cause_not_allowed' END AS refused FROM r")
def reviews_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.judged(review_log(spark, sf_dir), reviews.categories(spark)).select("candidate_id", "id", "decision", "refused").distinct()


@query(_LOG + " SELECT candidate_id, id, lead(id) OVER (PARTITION BY candidate_id ORDER BY id) AS superseded_by, lead(id) OVER (PARTITION BY candidate_id ORDER BY id) IS NULL AS current FROM r")
def review_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = review_log(spark, sf_dir).dropDuplicates(["candidate_id", "id"])
    return reviews.chained(log).select("candidate_id", "id", "superseded_by", "current")


@query("SELECT event_type AS metric, user_id AS organization_id, date_trunc('month', ts + INTERVAL 8 HOUR)::DATE AS month, count(*) AS amount FROM events GROUP BY ALL", days=("month",))
def usage_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.table(spark, sf_dir, "events").select(F.col("user_id").alias("organization_id"), F.col("event_type").alias("metric"), F.col("ts").cast("timestamp").alias("at"), F.lit(1).alias("amount"), F.lit("Asia/Manila").alias("zone"))
    return usage.monthly(e)


@query("""SELECT user_id AS organization_id, n AS current, CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN 50 ELSE 5000 END::BIGINT AS most, user_id % 3 <> 1 OR n + 10 <= 50 AS allowed FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)""")
def limit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = v.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("organization_id")).agg(F.count("*").alias("current"))
    org = F.col("organization_id")
    overrides = used.where(org % 3 == 0).select("organization_id", F.lit("jobs_imported").alias("metric"), F.lit(None).cast("long").alias("most"), F.lit(None).cast("timestamp").alias("expires_at"))
    plans = used.where(org % 3 == 1).select("organization_id", F.lit("jobs_imported").alias("metric"), F.lit(50).cast("long").alias("most"), F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("past_due_since"))
    asked = used.select("organization_id", F.lit("jobs_imported").alias("metric"), "current", F.lit(10).alias("amount"))
    limits = usage.limits(asked.select("organization_id", "metric"), overrides, plans, "2026-01-01")
    return usage.checked(asked, limits).select("organization_id", "current", "most", "allowed")


_RATED = f"{v.JOBS_SQL}, t AS (SELECT organization_id, technician_id, count(*) AS jobs, count_if(is_warranty) AS confirmed FROM jobs WHERE technician_id IS NOT NULL GROUP BY 1, 2)"


@query(_RATED + " SELECT organization_id, technician_id, jobs, CASE WHEN jobs >= 25 THEN round(confirmed * 10000 / jobs)::BIGINT END AS rate FROM t")
def technician_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.technician_rates(v.jobs(spark, sf_dir), F.col("is_warranty"))


@query(f"""{v.JOBS_SQL}, m AS (SELECT n_regionkey AS organization_id, 12 * (n_regionkey + 3) AS months FROM nation WHERE n_regionkey < 4 GROUP BY 1) SELECT jobs.organization_id, id FROM jobs LEFT JOIN m USING (organization_id) WHERE months IS NULL OR service_date >= DATE '2001-08-01' - to_months(months::INTEGER)""")
def jobs_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    org = F.col("n_regionkey")
    tenants = v.table(spark, sf_dir, "nation").where(org < 4).select(org.alias("organization_id"), ((org + 3) * 12).alias("retention_months")).distinct()
    return lifecycle.jobs_retained(v.jobs(spark, sf_dir), tenants, "2001-08-01").select("organization_id", "id")


@query(f"{v.JOBS_SQL} SELECT id, CASE WHEN service_date < DATE '1998-01-01' AND id % 5 IN (0, 1, 2) THEN NULL ELSE raw_job_type END AS raw_data FROM jobs")
def raw_payload_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.get(F.array(*map(F.lit, ["imported", "updated", "skipped_duplicate", "error", "warning"])), (F.col("id") % 5).cast("int"))
    return v.jobs(spark, sf_dir).select("id", analytics.pruned(F.col("raw_job_type"), F.col("service_date"), status, "1998-04-01").alias("raw_data"))


@query(_LOG + " SELECT candidate_id, id, row_number() OVER (PARTITION BY candidate_id ORDER BY id DESC)::INTEGER AS place FROM r")
def review_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.history(review_log(spark, sf_dir).dropDuplicates(["candidate_id", "id"])).select("candidate_id", "id", "place")


@query(_LOG + " SELECT candidate_id, id, CASE WHEN candidate_id % 5 = 0 THEN 'unknown_candidate' WHEN candidate_id % 5 = 1 THEN 'candidate_suppressed' WHEN decision = 'confirmed' AND category IS NULL THEN 'category_required' WHEN root_cause IS NOT NULL AND decision <> 'confirmed' THEN 'root_cause_not_allowed' END AS refused, CASE WHEN candidate_id % 5 > 0 THEN candidate_id * 7 END AS basis_points_at_review FROM r")
def reviews_of_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of candidates that are open, suppressed or not there."""
    log = review_log(spark, sf_dir)
    c = F.col("candidate_id")
    known = log.select("candidate_id").distinct().where(c % 5 != 0).select("candidate_id", (c % 5 == 1).alias("suppressed"), (c * 7).alias("basis_points"))
    return reviews.judged(log, reviews.categories(spark), known).select("candidate_id", "id", "refused", "basis_points_at_review").distinct()


_DEFAULTS = ", ".join(f"('{k}', '{o}')" for o, keys in reviews.CATEGORIES.items() for k in keys)


@query(f"WITH d(key, outcome) AS (VALUES {_DEFAULTS}), o AS (SELECT DISTINCT n_nationkey AS organization_id FROM nation) SELECT organization_id, key, outcome FROM o, d WHERE NOT (organization_id % 3 = 0 AND outcome = 'rework') AND NOT (organization_id % 2 = 0 AND key = 'unsure')")
def taxonomy_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default categories that tenants lack: some have all of an outcome, some have one of their own under a default's key."""
    org = F.col("organization_id")
    tenants = v.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("organization_id"))
    defaults = reviews.categories(spark)
    every = tenants.withColumn("one", F.lit(1)).join(F.broadcast(defaults.withColumn("one", F.lit(1))), "one").drop("one")
    have = every.where(((org % 3 == 0) & (F.col("outcome") == "rework")) | ((org % 2 == 0) & (F.col("key") == "unsure")))
    return reviews.missing_defaults(have, every, ["organization_id", "key"]).select("organization_id", "key", "outcome")


@query("""WITH u AS (SELECT DISTINCT user_id AS k FROM events) SELECT k AS organization_id, CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN 5000 WHEN 2 THEN 900 WHEN 3 THEN 900 WHEN 4 THEN 5000 WHEN 5 THEN 900 ELSE 5000 END::BIGINT AS most FROM u""")
def limits_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0: an override without a limit, 1: an expired one, 2 to 5: plans (active, past due for 5 and for 40 days, trialing), 6: none."""
    org = F.col("organization_id")
    used = v.table(spark, sf_dir, "events").select(F.col("user_id").alias("organization_id"), F.lit("jobs_imported").alias("metric")).distinct()
    at = lambda day: F.lit(day).cast("timestamp")
    overrides = used.where(org % 7 < 2).select("organization_id", "metric", F.when(org % 7 == 1, 77).cast("long").alias("most"), F.when(org % 7 == 1, at("2025-12-31")).alias("expires_at"))
    state = F.when(org % 7 == 2, "active").when(org % 7 == 5, "trialing").otherwise("past_due")
    since = F.when(org % 7 == 3, at("2025-12-27")).when(org % 7 == 4, at("2025-11-22"))
    plans = used.where((org % 7).between(2, 5)).select("organization_id", "metric", F.lit(900).cast("long").alias("most"), state.alias("status"), since.alias("past_due_since"))
    return usage.limits(used, overrides, plans, "2026-01-01").select("organization_id", "most")


@query("SELECT event_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 51")
def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("action"), F.col("ts").cast("timestamp").alias("occurred_at"))
    kept = audit.filtered(e, action="error", occurred_from="2024-01-05", occurred_to="2024-01-20")
    return queue.ascending(kept, ["occurred_at", "event_id"], descending=True).select("event_id")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN user_id::VARCHAR WHEN 'view' THEN event_type END AS name, CASE event_type WHEN 'click' THEN left(repeat('x', (event_id % 300)::INTEGER), 200) END AS slug FROM events")
def audit_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("event_id"), F.col("event_type")
    kind = F.when(t == "click", "organization").when(t == "view", "organization").when(t == "error", "nothing")
    changes = F.when(t == "click", F.create_map(F.lit("name"), F.col("user_id").cast("string"), F.lit("slug"), F.repeat(F.lit("x"), (k % 300).cast("int")), F.lit("password"), F.lit("p"))).otherwise(F.create_map(F.lit("name"), t))
    rows = v.table(spark, sf_dir, "events").select(k, audit.sanitized(kind, changes).alias("c"))
    return rows.select("event_id", F.try_element_at("c", F.lit("name")).alias("name"), F.try_element_at("c", F.lit("slug")).alias("slug"))
