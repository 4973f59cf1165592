"""Queries of costs, breakdowns, queues and exports, each tenant by itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, costs, queue, reviews
from ..sources import delimited
from ..sources.tables import stage_path
from . import detection_queries as d
from . import quality_queries as q
from . import testviews as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def tenant_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxonomies of all tenants: to those of an odd number ``warranty`` is no rework, ``unsure`` counts toward cost, and there is no ``unrelated``."""
    org, key = F.col("organization_id"), F.col("key")
    every = v.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("organization_id"), F.explode(F.array(*map(F.lit, ["warranty", "unrelated", "unsure"]))).alias("key"))
    outcome = F.when(key == "unrelated", "not_rework").when(key == "unsure", "uncertain").when(org % 2 == 1, "not_rework").otherwise("rework")
    counts = F.when(org % 2 == 1, key == "unsure").otherwise(key == "warranty")
    return every.where((org % 2 == 0) | (key != "unrelated")).select(org, key, outcome.alias("outcome"), counts.alias("counts_toward_cost"), F.lit(True).alias("active"))


def reviewed_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of pairs with category, root cause, equipment and model."""
    _, found, spent = d._costs(spark, sf_dir)
    k = F.col("followup_id")
    gear = v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("equipment_id"), F.col("p_brand").alias("model"))
    rows = spent.join(found.select(*costs.PAIR, "equipment_id"), costs.PAIR).join(gear, "equipment_id", "left")
    return rows.select("organization_id", "equipment_id", "model", "total_cents", F.when(k % 3 == 0, "warranty").when(k % 3 == 1, "unrelated").otherwise("unsure").alias("category"), F.when(k % 3 == 0, F.when(k % 2 == 0, "workmanship").otherwise("other")).alias("root_cause"))


_COSTED = d.PAIRS + d._COST.format(hourly=4550, n=1)
_REVIEWED = _COSTED + """, c AS (SELECT c.*, q.equipment_id, p_brand AS model, CASE c.followup_id % 3 WHEN 0 THEN 'warranty' WHEN 1 THEN 'unrelated' ELSE 'unsure' END AS category, CASE WHEN c.followup_id % 3 = 0 THEN CASE WHEN c.followup_id % 2 = 0 THEN 'workmanship' ELSE 'other' END END AS root_cause
 FROM cost1 c JOIN pairs q USING (organization_id, prior_id, followup_id) LEFT JOIN part ON p_partkey = q.equipment_id),
b AS (SELECT *, CASE category WHEN 'unrelated' THEN CASE WHEN organization_id % 2 = 0 THEN 'not_rework' END WHEN 'unsure' THEN 'uncertain' ELSE CASE WHEN organization_id % 2 = 0 THEN 'rework' ELSE 'not_rework' END END AS outcome,
 CASE WHEN category = CASE WHEN organization_id % 2 = 0 THEN 'warranty' ELSE 'unsure' END THEN total_cents ELSE 0 END AS counted FROM c)
SELECT organization_id, outcome, {0}, count(*) AS pairs, sum(counted)::BIGINT AS cost_cents FROM b GROUP BY GROUPING SETS ((organization_id, outcome, {0}), (organization_id, outcome), (organization_id))"""


def _broken_down(by: str) -> None:
    def found(spark: SparkSession, sf_dir: str) -> DataFrame:
        return costs.breakdown(reviewed_costs(spark, sf_dir), by, tenant_categories(spark, sf_dir))

    found.__name__ = {"root_cause": "cause_breakdown", "equipment_id": "equipment_breakdown"}.get(by, f"{by}_breakdown")
    query(_REVIEWED.replace("{0}", by))(found)


for _by in ("root_cause", "category", "equipment_id", "model"):
    _broken_down(_by)


@query(f"{v.JOBS_SQL}, b AS (SELECT *, CASE WHEN category_id = '5-LOW' THEN NULL WHEN category_id = '1-URGENT' THEN 'rework' WHEN organization_id = 0 THEN 'uncertain' ELSE 'not_rework' END AS outcome, CASE WHEN category_id = '1-URGENT' THEN coalesce((revenue * 100)::BIGINT, 0) ELSE 0 END AS counted FROM jobs) SELECT organization_id, outcome, category_id AS category, count(*) AS pairs, sum(counted)::BIGINT AS cost_cents FROM b GROUP BY GROUPING SETS ((organization_id, outcome, category_id), (organization_id, outcome), (organization_id))")
def breakdown_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All jobs as reviewed ones by priority, under tenants' own meanings of priorities; one priority has none."""
    jobs = v.jobs(spark, sf_dir)
    rows = jobs.select("organization_id", F.col("category_id").alias("category"), F.coalesce((F.col("revenue") * 100).cast("long"), F.lit(0)).alias("total_cents"))
    org, key = F.col("organization_id"), F.col("key")
    means = jobs.select("organization_id", F.col("category_id").alias("key")).distinct().where(key != "5-LOW")
    taxonomy = means.select(org, key, F.when(key == "1-URGENT", "rework").when(org == 0, "uncertain").otherwise("not_rework").alias("outcome"), (key == "1-URGENT").alias("counts_toward_cost"))
    return costs.breakdown(rows, "category", taxonomy)


@query(_COSTED + """, c AS (SELECT organization_id, followup_id AS id, total_cents FROM cost1 WHERE followup_id % 3 = 0)
SELECT j.organization_id, date_trunc('month', j.service_date)::DATE::VARCHAR AS period, count(*) AS jobs, count(n) AS confirmed, coalesce(sum(n), 0)::BIGINT AS cost FROM jobs j LEFT JOIN (SELECT organization_id, id, sum(total_cents) AS n FROM c GROUP BY 1, 2) USING (organization_id, id) GROUP BY 1, 2""")
def trend_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by month, those among them that confirmed pairs follow up with, and what these cost."""
    jobs, _, spent = d._costs(spark, sf_dir)
    yes = spent.where("followup_id % 3 = 0").groupBy("organization_id", F.col("followup_id").alias("id")).agg(F.sum("total_cents").alias("cents"))
    rows = jobs.select("organization_id", "id", "service_date").join(yes, ["organization_id", "id"], "left")
    return analytics.trend(rows, F.col("cents").isNotNull(), F.coalesce("cents", F.lit(0))).withColumn("period", F.col("period").cast("string"))


@query(d.PAIRS + " SELECT organization_id, p_brand AS what, count(*) AS pairs, row_number() OVER (PARTITION BY organization_id ORDER BY count(*) DESC, p_brand)::INTEGER AS place FROM pairs JOIN part ON p_partkey = equipment_id WHERE followup_id % 3 = 0 GROUP BY 1, 2 QUALIFY place <= 5")
def repeat_equipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = d.detected(spark, sf_dir)
    confirmed = d.truth(found).where("decision = 'confirmed'").join(found, ["organization_id", "prior_id", "followup_id"])
    gear = v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("model"))
    return costs.repeat_equipment(confirmed, gear, "model", most=5)


@query(q._LOG.replace("FROM conversations)", "FROM conversations), t AS (SELECT candidate_id % 2 AS organization_id, * FROM r)") + """ SELECT organization_id, candidate_id, id, CASE WHEN decision = 'confirmed' AND category IS NULL THEN 'category_required' WHEN organization_id = 1 AND category = 'unrelated' THEN 'unknown_category' WHEN organization_id = 1 AND category = 'warranty' THEN 'category_does_not_fit'
 WHEN root_cause IS NOT NULL AND decision <> 'confirmed' THEN 'root_cause_not_allowed' END AS refused FROM t""")
def reviews_by_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tenants with the same keys of categories: to the second ``warranty`` is no rework, and ``unrelated`` isn't active."""
    log = q.review_log(spark, sf_dir).withColumn("organization_id", F.col("candidate_id") % 2)
    every = reviews.categories(spark).select(F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("organization_id"), "key", "outcome", "active")
    second, key = F.col("organization_id") == 1, F.col("key")
    taxonomy = every.select("organization_id", "key", F.when(second & (key == "warranty"), "not_rework").otherwise(F.col("outcome")).alias("outcome"), (~second | (key != "unrelated")).alias("active"))
    return reviews.judged(log, taxonomy).select("organization_id", "candidate_id", "id", "refused").distinct()


@query(d.QUEUE + " SELECT candidate_id, basis_points FROM q WHERE suppressed_by IS NULL AND organization_id = 2 ORDER BY basis_points DESC, candidate_id DESC LIMIT 51")
def queue_of_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.page(d.open_queue(spark, sf_dir), organization_id=2).select("candidate_id", "basis_points")


@query(d.QUEUE + """ SELECT candidate_id, CASE followup_id % 3 WHEN 0 THEN 'confirmed' ELSE 'rejected' END AS decision, basis_points::VARCHAR AS basis_points, CASE followup_id % 3 WHEN 0 THEN chr(39) || '=x, "y"' ELSE '' END AS note FROM q WHERE followup_id % 3 < 2""")
def review_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of candidates as they are exported, read back from the files."""
    made = d.detected(spark, sf_dir)
    told = d.truth(made[1]).where("decision <> 'uncertain'")
    rows = d.open_queue(spark, sf_dir, made).join(told, ["organization_id", "prior_id", "followup_id"]).select("candidate_id", "decision", "basis_points", F.when(F.col("decision") == "confirmed", '=x, "y"').alias("note"))
    path = stage_path(spark, "export")
    delimited.write_export(rows, path)
    return spark.read.csv(path, header=True, escape='"').fillna("")


@query(v.JOBS_SQL + " SELECT organization_id::VARCHAR AS organization_id, id::VARCHAR AS id, coalesce(equipment_id::VARCHAR, '') AS equipment_id, service_date::VARCHAR AS service_date, status, coalesce(revenue::VARCHAR, '') AS revenue, coalesce(raw_job_type, '') AS raw_job_type FROM jobs")
def job_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs as they are exported, read back from the files."""
    path = stage_path(spark, "export")
    delimited.write_export(v.jobs(spark, sf_dir).select("organization_id", "id", "equipment_id", "service_date", "status", "revenue", "raw_job_type"), path)
    return spark.read.csv(path, header=True, escape='"').fillna("")
