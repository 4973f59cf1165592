"""Monthly usage and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits of the free plan.
FREE = {"jobs_imported": 5_000, "jobs_retained": 10_000, "retention_months": 6, "imports_per_month": 3, "concurrent_imports": 1, "team_members": 2, "exports_per_month": 5}
GRACE_DAYS = 14


def monthly(events: DataFrame) -> DataFrame:
    """(organization_id, metric, month, amount): sums per calendar month in the tenant's zone."""
    month = F.trunc(F.from_utc_timestamp("at", F.col("zone")).cast("date"), "month")
    return events.groupBy("organization_id", "metric", month.alias("month")).agg(F.sum("amount").alias("amount"))


def limits(asked: DataFrame, overrides: DataFrame, plans: DataFrame, today: str) -> DataFrame:
    """(organization_id, metric, most): an override that holds, else the plan's, else the free plan's.

    A null limit is no limit, so presence decides, not the value.
    """
    now = F.lit(today).cast("timestamp")
    on = ["organization_id", "metric"]
    o = overrides.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select(*on, F.struct("most").alias("_o"))
    paying = F.col("status").isin("active", "trialing") | ((F.col("status") == "past_due") & (F.col("past_due_since") > F.date_sub(now.cast("date"), GRACE_DAYS)))
    p = plans.where(paying).select(*on, F.struct("most").alias("_p"))
    free = F.create_map(*(F.lit(x) for kv in FREE.items() for x in kv))[F.col("metric")].cast("long")
    rows = asked.join(o, on, "left").join(p, on, "left")
    most = F.when(F.col("_o").isNotNull(), F.col("_o.most")).when(F.col("_p").isNotNull(), F.col("_p.most")).otherwise(free)
    return rows.select(*on, most.alias("most"))


def checked(asked: DataFrame, found: DataFrame) -> DataFrame:
    """Whether (current + amount) is within the limit, and why not."""
    rows = asked.join(found, ["organization_id", "metric"])
    fine = F.col("most").isNull() | (F.col("current") + F.col("amount") <= F.col("most"))
    return rows.withColumns({"allowed": fine, "reason": F.when(~fine, F.concat(F.lit("limit of "), F.col("most").cast("string"), F.lit(" reached")))})
