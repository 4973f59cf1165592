"""What repeat visits cost: visit costs, snapshots, summaries."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["organization_id", "prior_id", "followup_id"]


@dataclass(frozen=True)
class CostModel:
    """A version of a tenant's cost model. Amounts are decimal texts; ``custom`` has (amount, visit or hour)."""

    version: int
    hourly: str
    dispatch: str = "0"
    overhead: str = "0"
    opportunity: str = "0"
    default_minutes: int = 90
    include_parts: bool = True
    custom: tuple[tuple[str, str], ...] = ()
    currency: str = "USD"

    def checked(self) -> CostModel:
        amounts = [self.hourly, self.dispatch, self.overhead, self.opportunity, *(a for a, _ in self.custom)]
        if any(Decimal(a) < 0 or Decimal(a) != round(Decimal(a), 2) for a in amounts) or self.default_minutes < 0:
            raise ValueError("amounts have two decimals at most and are not below zero")
        if any(per not in ("visit", "hour") for _, per in self.custom):
            raise ValueError("a custom factor is per visit or per hour")
        return self

    def cents(self, per: str) -> int:
        return sum(int(Decimal(a) * 100) for a, p in self.custom if p == per)


def _rounded(sixtieths: Column) -> Column:
    """Cents from sixtieths of a cent, half up (they are not below zero)."""
    return F.floor((sixtieths * 2 + 60) / 120).cast("long")


def visit_costs(pairs: DataFrame, jobs: DataFrame, technicians: DataFrame, line_items: DataFrame, model: CostModel) -> DataFrame:
    """Per pair what its follow-up cost, in cents: labor, dispatch, overhead, opportunity, parts, custom and total.

    A missing duration is the model's, a technician's own rate goes before the model's. The total is made of
    sixtieths of cents and rounded once. A job in another currency than the model's is an error.
    """
    model.checked()
    cents = lambda x: int(Decimal(x) * 100)
    visits = jobs.select("organization_id", F.col("id").alias("followup_id"), "duration_minutes", "technician_id", *(["currency_code"] if "currency_code" in jobs.columns else []))
    rates = technicians.select(F.col("id").alias("technician_id"), (F.col("hourly_cost_amount").cast("decimal(14,2)") * 100).cast("long").alias("_rate"))
    parts = line_items.where(F.col("kind") == "part").groupBy(F.col("job_id").alias("followup_id")).agg((F.sum(F.col("amount").cast("decimal(14,2)")) * 100).cast("long").alias("_parts"))
    rows = pairs.select(*PAIR).join(visits, ["organization_id", "followup_id"]).join(rates, "technician_id", "left").join(parts, "followup_id", "left")
    if "currency_code" in jobs.columns:
        wrong = F.raise_error(F.concat(F.lit(f"a job is not in {model.currency} but in "), F.col("currency_code"))).cast("long")
        rows = rows.withColumn("_parts", F.when(F.col("currency_code").isNotNull() & (F.col("currency_code") != model.currency), wrong).otherwise(F.col("_parts")))
    minutes = F.coalesce("duration_minutes", F.lit(model.default_minutes)).cast("long")
    rate = F.coalesce("_rate", F.lit(cents(model.hourly)))
    spent = F.coalesce("_parts", F.lit(0)) if model.include_parts else F.lit(0)
    sixtieths = {
        "labor": minutes * rate, "dispatch": F.lit(60 * cents(model.dispatch)), "overhead": F.lit(60 * cents(model.overhead)), "opportunity": minutes * cents(model.opportunity),
        "parts": spent * 60, "custom": minutes * model.cents("hour") + 60 * model.cents("visit"),
    }
    total = sum(sixtieths.values(), F.lit(0))
    return rows.select(*PAIR, F.lit(model.version).alias("model_version"), F.lit(model.currency).alias("currency_code"), *(_rounded(c).alias(f"{k}_cents") for k, c in sixtieths.items()), _rounded(total).alias("total_cents"))


def snapshots(old: DataFrame | None, costs: DataFrame) -> DataFrame:
    """Costs as they were first worked out for each pair and model version; later ones don't change them."""
    if old is None:
        return costs
    return old.unionByName(costs.join(old.select(*PAIR, "model_version"), [*PAIR, "model_version"], "left_anti"))


def summary(jobs: DataFrame, candidates: DataFrame, reviews: DataFrame, costs: DataFrame) -> DataFrame:
    """One row per tenant: jobs considered, candidates reviewed, pending and confirmed, confirmed ones per ten
    thousand jobs, and the confirmed ones' cost with the latest model version in it.

    ``reviews`` has the current decision of pairs; only confirmed ones count as repeat work.
    """
    one = ["organization_id"]
    considered = jobs.groupBy(*one).agg(F.count("*").alias("jobs_considered"))
    known = candidates.select(*PAIR).join(reviews.select(*PAIR, "decision"), PAIR, "left").join(costs.select(*PAIR, "model_version", "total_cents"), PAIR, "left")
    yes = F.col("decision") == "confirmed"
    found = known.groupBy(*one).agg(F.count_if(F.col("decision").isNotNull()).alias("reviewed"), F.count_if(F.col("decision").isNull()).alias("pending"), F.count_if(yes).alias("confirmed"), F.sum(F.when(yes, F.col("total_cents"))).alias("cost_cents"), F.max("model_version").alias("cost_model_version"))
    rows = considered.join(found, one, "left").fillna(0, ["reviewed", "pending", "confirmed", "cost_cents"])
    return rows.withColumn("rework_rate", F.expr("(confirmed * 10000) div jobs_considered"))


def breakdown(rows: DataFrame, by: str, taxonomy: DataFrame, cost: str = "total_cents") -> DataFrame:
    """Per tenant reviewed pairs by outcome, whether the category counts toward cost, and a column (root cause, category,
    equipment, model): their number and cost; also for all values of the column, and for all of the tenant.

    ``rows`` have organization_id, category, the column and ``cost``; categories are known by what they mean to the
    tenant, not by key: ``taxonomy`` is per tenant, unless it has no organization_id (defaults of all).
    """
    on = [c for c in ("organization_id",) if c in taxonomy.columns] + ["category"]
    known = taxonomy.select(*on[:-1], F.col("key").alias("category"), "outcome", "counts_toward_cost")
    both = rows.select(*dict.fromkeys(("organization_id", "category", by, cost))).join(known, on, "left")
    spent = F.sum(F.when(F.col("counts_toward_cost"), F.col(cost)).otherwise(0))
    found = both.rollup("organization_id", "outcome", by).agg(F.count("*").alias("pairs"), spent.alias("cost_cents"), F.grouping("organization_id").alias("_all"))
    return found.where("_all = 0").drop("_all")


def repeat_equipment(confirmed: DataFrame, equipment: DataFrame, by: str = "id", most: int = 50) -> DataFrame:
    """Each tenant's ``most`` pieces of equipment (or models, ``by`` model) with the most confirmed pairs; ties by name."""
    rows = confirmed.where("equipment_id is not null").select("organization_id", "equipment_id").join(equipment.select(F.col("id").alias("equipment_id"), F.col(by).alias("what")), "equipment_id")
    order = Window.partitionBy("organization_id").orderBy(F.desc("pairs"), "what")
    return rows.groupBy("organization_id", "what").agg(F.count("*").alias("pairs")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
