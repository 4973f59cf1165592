"""Candidates as snapshots: stable identity over runs, and suppression of pairs that fell out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["organization_id", "prior_id", "followup_id"]
_SHARED = ["customer_id", "location_id", "equipment_id", "prior_technician_id", "followup_technician_id", "days_between"]
#: Columns of a snapshot.
COLUMNS = ["candidate_id", *KEYS, *_SHARED, "run_id", "first_detected_run", "workflow_status", "suppressed", "suppressed_reason"]


def candidate_id() -> Column:
    return F.sha2(F.concat_ws("|", *(F.col(k).cast("string") for k in KEYS)), 256)


def upserted(old: DataFrame | None, found: DataFrame, run_id: str) -> DataFrame:
    """The snapshot after a run that found these pairs, with ``change``: created, updated or kept.

    A pair keeps its id, its first run and its workflow status; everything else comes from the run, and a
    suppression is lifted. Pairs that the run didn't find stay as they were.
    """
    new = found.select(*KEYS, *_SHARED)
    if old is None:
        rows = new.select("*", candidate_id().alias("candidate_id"), F.lit(run_id).alias("run_id"), F.lit(run_id).alias("first_detected_run"), F.lit("pending").alias("workflow_status"), F.lit(False).alias("suppressed"), F.lit(None).cast("string").alias("suppressed_reason"), F.lit("created").alias("change"))
        return rows.select(*COLUMNS, "change")
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in KEYS]
    both = o.join(n, on, "full_outer")
    seen, known = F.col("n._new").isNotNull(), F.col("o.candidate_id").isNotNull()
    pick = {c: F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in [*KEYS, *_SHARED]}
    rows = both.select(
        *(c.alias(k) for k, c in pick.items()),
        F.when(seen, F.lit(run_id)).otherwise(F.col("o.run_id")).alias("run_id"),
        F.coalesce("o.first_detected_run", F.lit(run_id)).alias("first_detected_run"),
        F.coalesce("o.workflow_status", F.lit("pending")).alias("workflow_status"),
        F.when(seen, False).otherwise(F.col("o.suppressed")).alias("suppressed"),
        F.when(~seen, F.col("o.suppressed_reason")).alias("suppressed_reason"),
        F.when(seen & known, "updated").when(seen, "created").otherwise("kept").alias("change"),
        F.col("o.candidate_id").alias("_id"),
    )
    return rows.withColumn("candidate_id", F.coalesce("_id", candidate_id())).select(*COLUMNS, "change")


def out_of_window(snapshot: DataFrame, scope: DataFrame, run_id: str, priors: DataFrame | None = None) -> DataFrame:
    """Suppresses candidates that this run didn't touch though both of their jobs are in its scope.

    ``scope`` has (organization_id, id) of the run's jobs; of a run over some priors alone, ``priors`` has those. None is deleted.
    """
    for side, jobs in (("prior", scope if priors is None else priors), ("followup", scope)):
        ids = jobs.select("organization_id", "id").distinct()
        flag = ids.select("organization_id", F.col("id").alias(f"{side}_id"), F.lit(True).alias(f"_{side}"))
        snapshot = snapshot.join(flag, ["organization_id", f"{side}_id"], "left")
    gone = (F.col("run_id") != run_id) & F.col("_prior").isNotNull() & F.col("_followup").isNotNull() & ~F.col("suppressed")
    change = [F.when(gone, "suppressed").otherwise(F.col("change")).alias("change")] if "change" in snapshot.columns else []
    return snapshot.select(*(c for c in COLUMNS if c not in ("suppressed", "suppressed_reason")), F.when(gone, True).otherwise(F.col("suppressed")).alias("suppressed"), F.when(gone, "out_of_window").otherwise(F.col("suppressed_reason")).alias("suppressed_reason"), *change).select(*COLUMNS, *(["change"] if change else []))
