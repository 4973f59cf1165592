"""Candidate pairs: a visit and a later one that shares its customer, equipment or location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import casefold, stripped

KEYS = ("customer_id", "equipment_id", "location_id")
VISITED = ("completed", "unknown")
_CARRIED = ("customer_id", "location_id", "equipment_id", "technician_id")


def order_ts(started_at: Column | str = "started_at", service_date: Column | str = "service_date") -> Column:
    """Start, or midnight UTC of the service date."""
    return F.coalesce(started_at, F.col(service_date).cast("timestamp") if isinstance(service_date, str) else service_date.cast("timestamp"))


def visits(jobs: DataFrame, date_from: str | None = None, date_to: str | None = None, window: int = 0) -> DataFrame:
    """Live jobs that took place, dated from ``window`` days before the scope to its end."""
    found = jobs.where(F.col("status").isin(*VISITED))
    if "deleted_at" in jobs.columns:
        found = found.where("deleted_at is null")
    if date_from is not None:
        found = found.where(F.col("service_date") >= F.date_sub(F.lit(date_from).cast("date"), window))
    if date_to is not None:
        found = found.where(F.col("service_date") <= F.lit(date_to).cast("date"))
    return found


def _ahead(rows: DataFrame, key: str, window: int, cap: int) -> DataFrame:
    """For each row, the next ``cap`` rows of its tenant and key, at most ``window`` days later.

    Days are cut into spans, and a row early in a span also comes with the span before, where the rows
    that look ahead to it are. So a key's window is as large as its visits in one span, not in all time.
    """
    span = max(360, 12 * window)
    day = F.unix_date("service_date")
    home = F.floor(day / span)
    spans = F.array_distinct(F.array(home, F.floor((day - window) / span)))
    dealt = rows.where(F.col(key).isNotNull()).withColumn("_home", home).withColumn("_span", F.explode(spans))
    w = Window.partitionBy("organization_id", key, "_span").orderBy("service_date", "order_ts", "id").rowsBetween(1, cap)
    other = F.struct("service_date", "order_ts", "id", *_CARRIED)
    pairs = dealt.withColumn("_next", F.collect_list(other).over(w)).where("_home = _span")
    near = F.filter("_next", lambda x: x["service_date"] <= F.date_add("service_date", window))
    return pairs.select("organization_id", F.struct("service_date", "order_ts", "id", *_CARRIED).alias("p"), F.explode(near).alias("f"))


def candidate_pairs(jobs: DataFrame, window: int = 30, cap: int = 25, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Pairs (prior_id, followup_id) with days_between, shared ids and both technicians.

    Both visits are of one tenant and in scope; the follow-up is 0 to ``window`` days later and behind the
    prior in (date, start, id); a prior keeps its ``cap`` nearest follow-ups. No join is needed: each key
    looks ahead along its own order, and the nearest follow-ups of all keys are among those of each.
    """
    rows = visits(jobs, date_from, date_to, window).withColumn("order_ts", order_ts())
    rows = rows.select("organization_id", "id", "service_date", "order_ts", *_CARRIED)
    found = None
    for key in KEYS:
        part = _ahead(rows, key, window, cap)
        found = part if found is None else found.unionByName(part)
    # Dealt by prior once: the same partitioning serves the distinct pairs and the cap.
    found = found.withColumn("_prior", F.col("p.id")).repartition("organization_id", "_prior").dropDuplicates(["organization_id", "_prior", "p", "f"])
    nearest = Window.partitionBy("organization_id", "_prior").orderBy("f.service_date", "f.order_ts", "f.id")
    kept = found.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= cap)
    shared = [F.coalesce(f"f.{c}", f"p.{c}").alias(c) for c in _CARRIED[:3]]
    return kept.select("organization_id", F.col("p.id").alias("prior_id"), F.col("f.id").alias("followup_id"), *shared, F.col("p.technician_id").alias("prior_technician_id"), F.col("f.technician_id").alias("followup_technician_id"), F.datediff("f.service_date", "p.service_date").alias("days_between"))


def recurrence(jobs: DataFrame, window: int = 30, wanted: DataFrame | None = None) -> DataFrame:
    """(organization_id, id, visits): visits of a job's customer or equipment from its date on, itself
    included, up to ``window`` days later: by customer, and by equipment, less those by both.

    Visits are counted once by (customer, equipment, day); the counts by customer and by equipment are sums of
    these. A range window has a row for each day of a key at most, and keys that are missing are in none.
    ``wanted`` has the (organization_id, id) to be told; all visits are counted.
    """
    org, both = "organization_id", ["customer_id", "equipment_id"]
    rows = visits(jobs).select(org, "id", *both, F.unix_date("service_date").alias("day"))
    cells = rows.groupBy(org, *both, "day").agg(F.count("*").alias("n"))

    def ahead(counts: DataFrame, *keys: str) -> Column:
        return F.sum("n").over(Window.partitionBy(org, *keys).orderBy("day").rangeBetween(0, window))

    total = None
    for keys, sign in ((both[:1], 1), (both[1:], 1), (both, -1)):
        known = cells.dropna(subset=list(keys))
        days = known if len(keys) == 2 else known.groupBy(org, *keys, "day").agg(F.sum("n").alias("n"))
        days = days.select(org, *keys, "day", (ahead(days, *keys) * sign).alias("n"))
        if len(keys) == 1:  # back to the cells of that key's day
            days = known.select(org, *both, "day").join(days, [org, *keys, "day"])
        total = days.select(org, *both, "day", "n") if total is None else total.unionByName(days.select(org, *both, "day", "n"))
    known = total.groupBy(org, *both, "day").agg(F.sum("n").alias("visits"))
    rows = rows if wanted is None else rows.join(wanted, [org, "id"], "left_semi")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in (org, *both, "day")]
    return rows.alias("r").join(known.alias("k"), same, "left").select(f"r.{org}", "r.id", F.coalesce("k.visits", F.lit(0)).cast("long").alias("visits"))


def part_codes(line_items: DataFrame) -> DataFrame:
    """(job_id, codes): distinct trimmed, lower-cased part codes of each job, sorted."""
    code = stripped(F.col("code").cast("string"))  # folded behind the filter, so that the helper sees each code once
    return line_items.where((F.col("kind") == "part") & (code != "")).groupBy("job_id").agg(F.array_sort(F.collect_set(casefold(code))).alias("codes"))
