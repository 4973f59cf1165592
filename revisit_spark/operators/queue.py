"""The review queue: filters, keyset pages, and a page's details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import staged

SORTS = ("basis_points", "days_between", "first_detected_run")
PAGE, MOST = 50, 200


def ready(snapshot: DataFrame, scored: DataFrame) -> DataFrame:
    """Candidates that have a score, with a veto shown as a suppression."""
    both = snapshot.join(scored.drop("run_id"), ["organization_id", "prior_id", "followup_id"])
    return both.withColumn("suppressed", F.col("suppressed") | F.col("suppressed_by").isNotNull())


def filtered(rows: DataFrame, jobs: DataFrame | None = None, *, organization_id=None, status: str | None = None, suppressed: bool = False, min_basis_points: int | None = None, band: str | None = None, customer_id=None, equipment_id=None, technician_id=None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """A date range is of the follow-up, of live jobs, both ends included; a technician may be on either side.

    People see their tenant's queue (``organization_id``); without one, rows of all tenants are left.
    """
    if organization_id is not None:
        rows = rows.where(F.col("organization_id") == organization_id)
    if not suppressed:
        rows = rows.where(~F.col("suppressed"))
    if status is not None:
        rows = rows.where(F.col("workflow_status") == status)
    if min_basis_points is not None:
        rows = rows.where(F.col("basis_points") >= min_basis_points)
    for column, value in (("band", band), ("customer_id", customer_id), ("equipment_id", equipment_id)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if technician_id is not None:
        rows = rows.where((F.col("prior_technician_id") == technician_id) | (F.col("followup_technician_id") == technician_id))
    if date_from is not None or date_to is not None:
        live = jobs.where("deleted_at is null") if "deleted_at" in jobs.columns else jobs
        if date_from is not None:
            live = live.where(F.col("service_date") >= F.lit(date_from).cast("date"))
        if date_to is not None:
            live = live.where(F.col("service_date") <= F.lit(date_to).cast("date"))
        rows = rows.join(live.select("organization_id", F.col("id").alias("followup_id")), ["organization_id", "followup_id"], "left_semi")
    return rows


def page(rows: DataFrame, by: str = "basis_points", cursor: tuple | None = None, size: int = PAGE, suppressed: bool = False, organization_id=None) -> DataFrame:
    """The next ``size`` rows and one more (it tells that there are further ones), largest first.

    ``cursor`` is the last row's (value, candidate_id). Top-k per partition, no full sort.
    """
    if by not in SORTS or not 1 <= size <= MOST:
        raise ValueError("unknown sort or page size")
    rows = filtered(rows, organization_id=organization_id, suppressed=suppressed)
    if cursor is not None:
        value, last = cursor
        rows = rows.where((F.col(by) < value) | ((F.col(by) == value) & (F.col("candidate_id") < last)))
    return rows.orderBy(F.desc(by), F.desc("candidate_id")).limit(size + 1)


def ascending(rows: DataFrame, by: list[str], cursor: tuple | None = None, size: int = PAGE, descending: bool = False) -> DataFrame:
    """A keyset page by several columns, all up or all down."""
    key = F.struct(*by)
    if cursor is not None:
        at = F.struct(*(F.lit(x).cast(rows.schema[c].dataType).alias(c) for x, c in zip(cursor, by, strict=True)))
        rows = rows.where(key < at if descending else key > at)
    return rows.orderBy(*(F.desc(c) if descending else F.asc(c) for c in by)).limit(size + 1)


def proof(rows: DataFrame, most: int = 50) -> DataFrame:
    """The ``most`` highest unsuppressed candidates with their signals, by score, then id."""
    return filtered(rows).orderBy(F.desc("basis_points"), "candidate_id").limit(most)


def hydrated(page_rows: DataFrame, jobs: DataFrame, customers: DataFrame | None = None, technicians: DataFrame | None = None, reviews: DataFrame | None = None) -> DataFrame:
    """A page with both jobs as structs (pairs without either drop out), names and the current review.

    A page has MOST + 1 rows at most, which is checked here as it is worked out; so it is sent to the large
    tables' scans, not the other way. Longer tables are joined as they are.
    """
    rows = staged(page_rows)
    few = rows.count() <= MOST + 1
    sent = F.broadcast if few else (lambda x: x)
    small = sent(rows)
    columns = [c for c in jobs.columns if c not in ("organization_id", "id")]
    for side in ("prior", "followup"):
        part = jobs.select("organization_id", F.col("id").alias(f"{side}_id"), F.struct(*columns).alias(side))
        small = sent(part.join(small, ["organization_id", f"{side}_id"]))
    out = small
    if customers is not None:
        out = out.join(customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name")), "customer_id", "left")
    if technicians is not None:
        for side in ("prior", "followup"):
            out = out.join(technicians.select(F.col("id").alias(f"{side}_technician_id"), F.col("name").alias(f"{side}_technician_name")), f"{side}_technician_id", "left")
    if reviews is not None:
        out = out.join(reviews.select("candidate_id", F.struct(*(c for c in reviews.columns if c != "candidate_id")).alias("review")), "candidate_id", "left")
    return out


def top_signals(evidence: DataFrame, most: int = 3) -> DataFrame:
    """The first signals of each pair by contribution, then key."""
    return evidence.where(F.col("rank") <= most)
