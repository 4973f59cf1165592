"""One import as a chain: read, vote on dates, validate, find duplicates, resolve, upsert, tell each row's outcome, count."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import resolve, validate
from ..sources.tables import staged

JOB = ["organization_id", "digest"]
#: For each table of entities: its key in a record, and the fields that it has of it.
ENTITIES = {
    "customers": ("customer_key", {"name": "customer_name", "email": "customer_email", "phone": "customer_phone_e164"}), "locations": ("location_key", {"address": "address_line1", "city": "city", "postal_code": "postal_code"}),
    "equipment": ("equipment_key", {"serial": "equipment_serial", "model": "equipment_model"}), "technicians": ("technician_key", {"name": "technician_name"}),
}


#: The keys that a record has; their digests move between tasks as bytes, half of what their text has.
KEYS = ("customer_key", "location_key", "equipment_key", "technician_key", "job_key")


def _digests(rows: DataFrame, to: Callable[[Column], Column]) -> DataFrame:
    """Rows (digest, record) with all digests changed by ``to``."""
    record = F.col("record")
    for k in KEYS:
        record = record.withField(f"{k}.digest", to(F.col(f"record.{k}.digest")))
    return rows.withColumns({"digest": to(F.col("digest")), "record": record})


def _as_bytes(rows: DataFrame) -> DataFrame:
    return _digests(rows, F.unhex)


def _as_text(rows: DataFrame) -> DataFrame:
    return _digests(rows, lambda d: F.lower(F.hex(d)))


@dataclass(frozen=True)
class Import:
    """What an import leaves: rows with their outcome, the tables after it, and one row of counters for each batch."""

    rows: DataFrame
    jobs: DataFrame
    counters: DataFrame
    entities: dict[str, DataFrame] = field(default_factory=dict)


def run_import(raw: DataFrame, mapping: validate.Mapping, name: str, today: str, jobs: DataFrame | None = None, entities: dict[str, DataFrame] | None = None, source: str = "source") -> Import:
    """Raw rows (organization_id, batch_id, row_number, raw, maybe issues) into the tables ``jobs`` and ``entities``.

    Dates are read in the order that their batch's cells vote for. Repeated rows are known before rows are judged, while these are
    narrow. Rows are judged once and written; all else is made of what is written. Records move once, to their job's key. Every row ends with a status; those with errors, skipped ones and repeated ones
    change no table.
    """
    voted = validate.with_firsts(validate.with_date_orders(raw, mapping.fields["service_date"]))
    rows = validate.duplicates_marked(validate.validated(voted, mapping, today, F.col("date_order"), source))
    good = rows.where(F.col("status").isin("pending", "warning"))
    key = F.col("record.job_key")
    new = good.select("organization_id", key["digest"].alias("digest"), "batch_id", "row_number", "record", (key["strategy"] != "external_id").alias("natural"))
    old = None if jobs is None else _as_bytes(jobs)
    after = staged(_as_text(resolve.jobs_upserted(old, _as_bytes(new), JOB, name, order=F.struct("batch_id", "row_number"), by_natural_key="natural")))
    short = lambda r: r.withColumn("_key", F.unhex("digest"))
    told = resolve.row_outcomes(short(rows.withColumn("digest", key["digest"])), short(after), JOB, ["organization_id", "_key"]).drop("_key")
    found = {}
    for table, (entity, columns) in ENTITIES.items():
        have = good.schema["record"].dataType.fieldNames()
        known = {c: f for c, f in columns.items() if f in have}
        own = good.where(F.col(f"record.{entity}").isNotNull()).select("organization_id", F.col(f"record.{entity}.digest").alias("digest"), F.struct("batch_id", "row_number").alias("at"), *(F.col(f"record.{f}").alias(c) for c, f in known.items()))
        found[table] = resolve.resolved((entities or {}).get(table), own, JOB, list(known), order="at")
    return Import(told, after.drop("change"), validate.counters(told), found)
