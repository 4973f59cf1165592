"""Trends, rates and retention. Every result is per tenant: rows of two tenants never meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import search_tokens


ORG = "organization_id"


def trend(rows: DataFrame, confirmed: Column, cost: Column, period: str = "month") -> DataFrame:
    """Per tenant and period: jobs, confirmed repeat visits and their cost."""
    return rows.groupBy(ORG, F.trunc("service_date", period).alias("period")).agg(F.count("*").alias("jobs"), F.count_if(confirmed).alias("confirmed"), F.sum(cost).alias("cost"))


def technician_rates(rows: DataFrame, confirmed: Column, least: int = 25) -> DataFrame:
    """Confirmed per ten thousand jobs; null for technicians with few jobs."""
    n = rows.where("technician_id is not null").groupBy(ORG, "technician_id").agg(F.count("*").alias("jobs"), F.count_if(confirmed).alias("_c"))
    return n.select(ORG, "technician_id", "jobs", F.when(F.col("jobs") >= least, F.round(F.col("_c") * 10000 / F.col("jobs")).cast("long")).alias("rate"))


def pruned(raw: Column, day: Column, status: Column, today: str, days: int = 90) -> Column:
    """Raw payload, null after ``days`` for rows that are done with."""
    old = day < F.date_sub(F.lit(today).cast("date"), days)
    return F.when(~(old & status.isin("imported", "updated", "skipped_duplicate")), raw)


_PAIR = ["organization_id", "prior_id", "followup_id"]


def _reviewed(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """Rows of pairs with their current decision, where there is one."""
    return rows.join(reviews.select(*_PAIR, "decision"), _PAIR)


def precision_by_band(scored: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per tenant and band: confirmed, rejected and confirmed per ten thousand of both."""
    n = _reviewed(scored, reviews).groupBy(ORG, "band").agg(F.count_if(F.col("decision") == "confirmed").alias("confirmed"), F.count_if(F.col("decision") == "rejected").alias("rejected"))
    return n.withColumn("precision", F.expr("(confirmed * 10000) div nullif(confirmed + rejected, 0)"))


def calibration(scored: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per tenant and ten points of score: reviewed pairs and those confirmed."""
    bucket = F.least(F.expr("basis_points div 1000"), F.lit(9))
    return _reviewed(scored, reviews).groupBy(ORG, bucket.cast("int").alias("bucket")).agg(F.count("*").alias("reviewed"), F.count_if(F.col("decision") == "confirmed").alias("confirmed"))


def signal_lift(evidence: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per tenant and signal: reviewed and confirmed pairs where it matched and where it didn't."""
    of = lambda outcome, *more: F.count_if((F.col("outcome") == outcome) & (more[0] if more else F.lit(True)))
    yes = F.col("decision") == "confirmed"
    return _reviewed(evidence, reviews).groupBy(ORG, "key").agg(of("matched").alias("matched"), of("matched", yes).alias("matched_confirmed"), of("not_matched").alias("not_matched"), of("not_matched", yes).alias("not_matched_confirmed"))


def failing_parts(context: DataFrame) -> DataFrame:
    """Per tenant part codes by the number of pairs that used them on both visits."""
    both = F.explode(F.array_intersect("prior_codes", "followup_codes")).alias("code")
    return context.select(ORG, both).groupBy(ORG, "code").agg(F.count("*").alias("pairs"))


def related_visits(pairs: DataFrame, jobs: DataFrame) -> DataFrame:
    """(id, other_id): visits paired with each of the jobs, on either side. Two equi-joins, not an OR."""
    ids = jobs.select("organization_id", "id")
    sides = []
    for own, other in (("prior_id", "followup_id"), ("followup_id", "prior_id")):
        sides.append(pairs.select("organization_id", F.col(own).alias("id"), F.col(other).alias("other_id")).join(ids, ["organization_id", "id"], "left_semi"))
    return sides[0].union(sides[1]).distinct()


def suppression_error(suppressed: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per tenant and reason: suppressed pairs, those that people took back, those then confirmed, and these per ten
    thousand suppressed ones. ``suppressed`` has reason and taken_back."""
    rows = suppressed.join(reviews.select(*_PAIR, "decision"), _PAIR, "left")
    wrong = F.col("taken_back") & (F.col("decision") == "confirmed")
    n = rows.groupBy(ORG, "reason").agg(F.count("*").alias("suppressed"), F.count_if("taken_back").alias("taken_back"), F.count_if(wrong).alias("confirmed"))
    return n.withColumn("error", F.expr("(confirmed * 10000) div suppressed"))


def top_share(scored: DataFrame, parts: int = 10) -> DataFrame:
    """``scored`` with in_top: whether fewer than one ``parts``-th of the tenant's rows have a higher score.

    Each tenant's rows are counted by score (10,001 scores at most), and a tenant has one threshold, so no task
    ranks a tenant's rows.
    """
    counts = scored.groupBy(ORG, "basis_points").agg(F.count("*").alias("_n"))
    tenant = Window.partitionBy(ORG)
    above = F.coalesce(F.sum("_n").over(tenant.orderBy(F.desc("basis_points")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select(ORG, "basis_points", (above * parts < F.sum("_n").over(tenant)).alias("_top"))
    least = placed.groupBy(ORG).agg(F.min(F.when(F.col("_top"), F.col("basis_points"))).alias("_least"))
    return scored.join(least, ORG).withColumn("in_top", F.col("basis_points") >= F.col("_least")).drop("_least")


def label_evaluation(scored: DataFrame, labels: DataFrame, surface: int = 40) -> DataFrame:
    """Per tenant and kind of labelled pair (callback, maintenance, unrelated): how many there are, are in the top
    tenth of the tenant's scores, are vetoed, and lie under the surface threshold."""
    rows = top_share(scored).join(labels.select(*_PAIR, "kind"), _PAIR)
    return rows.groupBy(ORG, "kind").agg(F.count("*").alias("pairs"), F.count_if("in_top").alias("top_tenth"), F.count_if(F.col("suppressed_by").isNotNull()).alias("vetoed"), F.count_if(F.col("basis_points") < surface * 100).alias("under_surface"))


def whatif(before: DataFrame, after: DataFrame, most: int = 20) -> DataFrame:
    """Each tenant's pairs among its first ``most`` under either of two rule sets, with their ranks (null: not among them).

    Tasks keep ``most`` rows of a tenant before any are sent, so a tenant of any size is ranked by few rows.
    """

    def ranked(rows: DataFrame, name: str) -> DataFrame:
        order = Window.partitionBy(ORG).orderBy(F.desc("basis_points"), "prior_id", "followup_id")
        return rows.select(*_PAIR, "basis_points").withColumn(name, F.row_number().over(order)).where(F.col(name) <= most).drop("basis_points")

    return ranked(before, "rank_before").join(ranked(after, "rank_after"), _PAIR, "full_outer")


def job_search(jobs: DataFrame, asked: str | None = None, texts: tuple[str, ...] = ("summary", "description", "symptoms", "diagnosis", "resolution"), **equal) -> DataFrame:
    """Jobs with all words of ``asked`` in their texts, dated date_from to date_to, and equal in other columns given.

    Every text is read; where searches are many, ``search`` has an index.
    """
    for column, value in equal.items():
        if column == "date_from":
            jobs = jobs.where(F.col("service_date") >= F.lit(value).cast("date"))
        elif column == "date_to":
            jobs = jobs.where(F.col("service_date") <= F.lit(value).cast("date"))
        elif value is not None:
            jobs = jobs.where(F.col(column) == value)
    if asked:
        have = search_tokens(*(F.col(c) for c in texts if c in jobs.columns))
        jobs = jobs.where(F.size(F.array_except(search_tokens(F.lit(asked)), have)) == 0)
    return jobs
