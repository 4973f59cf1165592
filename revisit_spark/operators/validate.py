"""Validation of raw rows: mapping, skip filters, issues, statuses, duplicates, counters, report."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity
from ..functions import normalize as n
from ..sources.tables import forget, staged
from . import transforms
from .profile import SYNONYMS, TYPES

#: Statuses a job may have.
STATUSES = ("scheduled", "in_progress", "completed", "cancelled", "unknown")
MAX_CELL = 32 * 1024


@dataclass(frozen=True)
class Skip:
    """A filter that skips rows: equals, not_equals, contains, is_empty or is_not_empty."""

    column: str
    operator: str
    value: str | None = None


@dataclass(frozen=True)
class Mapping:
    """Target fields and the columns they come from; ``transforms`` has the settings of single fields (see transforms).

    The formats, separators and zone given here hold for fields without settings of their own.
    """

    fields: dict[str, str]
    retain: tuple[str, ...] = ()
    skip: tuple[Skip, ...] = ()
    status_map: dict[str, str] = field(default_factory=dict)
    date_format: str | None = None
    decimal: str | None = None
    thousands: str | None = None
    zone: str = "UTC"
    transforms: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def from_document(cls, document: dict[str, Any], zone: str = "UTC") -> Mapping:
        """A mapping from its stored document: version, fields (source_column, transform), retain_unmapped, skip_rows_where."""
        if odd := set(document) - {"version", "fields", "retain_unmapped", "skip_rows_where"}:
            raise ValueError(f"a mapping has no {sorted(odd)}")
        if document.get("version") != 1:
            raise ValueError("a mapping's version is 1")
        for target, f in document["fields"].items():
            if set(f) - {"source_column", "transform"} or not f.get("source_column"):
                raise ValueError(f"a field has a source_column and a transform: {target}")
        made = {t: transforms.from_document(f["transform"]) for t, f in document["fields"].items() if f.get("transform")}
        skip = tuple(Skip(**s) for s in document.get("skip_rows_where", ()))
        return cls({t: f["source_column"] for t, f in document["fields"].items()}, tuple(document.get("retain_unmapped", ())), skip, zone=zone, transforms=made).checked()

    def settings(self, target: str, kind: str) -> Any:
        """A field's own settings, or those of the whole mapping."""
        if target in self.transforms:
            return self.transforms[target]
        if kind == "money":
            return transforms.Amount(self.decimal, self.thousands)
        return transforms.When(self.date_format) if kind == "date" else None

    def checked(self, columns: list[str] | None = None) -> Mapping:
        if set(self.fields) - set(SYNONYMS):
            raise ValueError(f"no such target: {sorted(set(self.fields) - set(SYNONYMS))}")
        named = {*self.fields.values(), *self.retain, *(s.column for s in self.skip)}
        if columns is not None and named - set(columns):
            raise ValueError(f"no such column: {sorted(named - set(columns))}")
        if "service_date" not in self.fields:
            raise ValueError("service_date must be mapped")
        if not {"customer_name", "customer_external_id"} & set(self.fields):
            raise ValueError("a customer's name or id must be mapped")
        for s in self.skip:
            if s.operator not in ("equals", "not_equals", "contains", "is_empty", "is_not_empty"):
                raise ValueError(f"no such filter: {s.operator}")
            if s.operator in ("equals", "not_equals", "contains") and s.value is None:
                raise ValueError("a comparison needs a value")
        if set(self.transforms) - set(self.fields):
            raise ValueError(f"a transform without a field: {sorted(set(self.transforms) - set(self.fields))}")
        if self.decimal and self.decimal == self.thousands:
            raise ValueError("separators must differ")
        return self


def shape_issues(raw_fields: Column, expected: int) -> Column:
    """Issues of a row's number of fields."""
    size = F.size(raw_fields)
    return n.issues_of((size > expected, n.issue("TOO_MANY_COLUMNS", "error")), (size < expected, n.issue("TOO_FEW_COLUMNS", "error")))


def cell_issues(raw: Column, most: int = MAX_CELL) -> Column:
    """Issues of cells, by column: replaced characters, too many bytes."""
    made = lambda code, e: n.issue(code, "warning", e["key"], e["value"])
    replaced = lambda e: F.when(F.contains(e["value"], F.lit("\ufffd")), made("ENCODING_REPLACEMENT", e))
    long = lambda e: F.when(F.octet_length(e["value"]) > most, made("FIELD_TOO_LONG", e))
    odd = F.map_filter(raw, lambda k, v: F.contains(v, F.lit("\ufffd")) | (F.octet_length(v) > most))
    return F.array_compact(F.flatten(F.transform(F.array_sort(F.map_entries(odd)), lambda e: F.array(replaced(e), long(e)))))


def row_hash(raw: Column) -> Column:
    """Equal for equal maps, whatever the order of their keys."""
    return F.sha2(F.to_json(F.array_sort(F.map_entries(raw))), 256)


def _skipped(mapping: Mapping) -> Column:
    """Whether a filter hits; cells and values are compared stripped and case-folded."""
    if not mapping.skip:
        return F.lit(False)
    cells = n.casefold_all([n.stripped(F.coalesce(F.col("raw")[s.column], F.lit(""))) for s in mapping.skip])
    hit = F.lit(False)
    for i, s in enumerate(mapping.skip):
        cell, value = F.get(cells, F.lit(i)), (s.value or "").strip().casefold()
        hit = hit | {"equals": cell == value, "not_equals": cell != value, "contains": F.contains(cell, F.lit(value)), "is_empty": cell == "", "is_not_empty": cell != ""}[s.operator]
    return hit


#: Text fields that natural keys compare, folded.
_COMPARED = ("customer_name", "postal_code", "address_line1", "equipment_manufacturer", "equipment_model", "equipment_type", "technician_code", "technician_name", "summary", "description", "invoice_number")


def validated(rows: DataFrame, mapping: Mapping, today: str, order: Column | str = "ambiguous", source: str = "source", write: bool = True) -> DataFrame:
    """Rows (organization_id, batch_id, row_number, raw map, maybe issues) with issues, status, record and row_hash.

    Issues of the row's own first. Skip filters then (no field counts after a hit), every field's transform, the status, then
    customer and equipment identity. An error leaves no record. No shuffle: each step is a projection of plain columns.
    ``order`` is the date order, or a column with that of each row's batch (see ``with_date_orders``).
    The result is written into the shared folder (it is the outcome table of the import): a later filter on
    issues or status would otherwise be pushed through every step, and make one huge expression of them. With ``write``
    False the caller writes it, before any such filter.
    """
    mapping.checked()
    raw = lambda t: F.col("raw")[mapping.fields[t]] if t in mapping.fields else F.lit(None).cast("string")
    kinds = {t: TYPES.get(t, "text") for t in SYNONYMS if t in mapping.fields or t == "service_date" or TYPES.get(t) == "boolean"}
    given = transforms.Given(today, order, mapping.zone)
    texts = [t for t, kind in kinds.items() if kind == "text" and t != "job_status"]
    have = rows if "issues" in rows.columns else rows.withColumn("issues", n.no_issues())
    keep = [c for c in have.columns if c != "issues"]
    out = have.select(*keep, F.concat(F.col("issues").cast(n.ISSUES), cell_issues(F.col("raw"))).alias("_before"), _skipped(mapping).alias("_skip"))
    out = n.parsed(out, {f"_{t}": transforms.steps(kind, raw(t), mapping.settings(t, kind), given, t) for t, kind in kinds.items() if kind != "text"})
    retained = {f"_keep_{i}": F.col("raw")[c] for i, c in enumerate(mapping.retain)}
    out = n.clean_texts(out, {f"_{t}": raw(t) for t in texts} | {"_job_status": raw("job_status")} | retained)
    own = mapping.transforms.get("job_status")
    status_map = own.map if isinstance(own, transforms.Values) else mapping.status_map
    words = F.create_map(*(F.lit(x) for kv in status_map.items() for x in kv)) if status_map else F.lit(None).cast("map<string,string>")
    status = F.lower(F.coalesce(F.try_element_at(words, F.col("_job_status")), F.col("_job_status")))
    bounded = {f"_{t}": n.bounded_text(F.col(f"_{t}"), raw(t), field=t) for t in texts} | {f"_keep_{i}": n.bounded_text(F.col(f"_keep_{i}"), F.col("raw")[c], field=c) for i, c in enumerate(mapping.retain)}
    out = out.select(*(c for c in out.columns if c not in bounded), status.alias("_status"), *(c.alias(t) for t, c in bounded.items()))
    known = F.col("_status").isNull() | F.col("_status").isin(*STATUSES)
    said = n.result(F.when(F.col("_status").isNotNull() & known, F.col("_status")).otherwise("unknown"), (~known, n.issue("UNKNOWN_ENUM_VALUE", "warning", "job_status", raw("job_status"))))
    kinds["job_status"] = "text"
    parsed = out = staged(out.withColumn("_job_status", said))  # parsed once; keys and issues below use each value many times
    value = lambda t: F.col(f"_{t}.value") if t in kinds else F.lit(None).cast("string")
    compared = [t for t in _COMPARED if t in kinds]
    out = out.withColumn("_e164", n.phone(value("customer_phone")))
    if compared:
        out = out.withColumn("_folds", n.casefold_all([value(t) for t in compared]))
    folded = lambda t: F.get("_folds", F.lit(compared.index(t))) if t in compared else F.lit(None).cast("string")
    org, src = F.col("organization_id"), F.lit(source)
    customer = identity.customer(org, src, value("customer_external_id"), F.col("_e164"), folded("customer_name"), folded("postal_code"), ready=True)
    place = identity.location(org, src, value("location_external_id"), F.col("_customer.digest"), folded("address_line1"), folded("postal_code"), ready=True)
    gear = identity.equipment(org, src, value("equipment_external_id"), value("equipment_serial"), F.col("_location.digest"), folded("equipment_manufacturer"), folded("equipment_model"), folded("equipment_type"), ready=True)
    worker = identity.technician(org, src, value("technician_external_id"), folded("technician_code"), folded("technician_name"), ready=True)
    task = identity.job(org, src, value("external_job_id"), F.col("_customer.digest"), value("service_date"), folded("summary"), folded("description"), folded("invoice_number"), ready=True)
    out = out.withColumn("_customer", customer).withColumns({"_location": place, "_technician": worker, "_job": task}).withColumn("_equipment", gear)
    late = n.issues_of((F.col("_customer").isNull(), n.issue("UNRESOLVABLE_CUSTOMER", "error")), (F.col("_equipment").isNull(), n.issue("EQUIPMENT_NOT_RESOLVED", "info")))
    ordered = [t for t in SYNONYMS if t in kinds and t != "job_status"] + ["job_status"]
    every = F.concat("_before", *(F.col(f"_{t}.issues") for t in ordered), *(F.col(f"{t}.issues") for t in retained), late)
    out = out.withColumn("issues", F.when(F.col("_skip"), F.concat("_before", F.array(n.issue("ROW_SKIPPED_BY_FILTER", "info")))).otherwise(every))
    has = lambda s: F.exists("issues", lambda i: i["severity"] == s)
    out = out.withColumn("status", F.when(F.col("_skip"), "skipped_filtered").when(has("error"), "error").when(has("warning"), "warning").otherwise("pending"))
    extra = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, mapping.retain)), F.array(*(F.col(f"{t}.value") for t in retained))), lambda k, v: v.isNotNull()) if retained else F.lit(None).cast("map<string,string>")
    labels = {"customer_label": n.label(*map(value, ("customer_name", "customer_external_id", "customer_phone"))), "technician_label": n.label(*map(value, ("technician_name", "technician_code", "technician_external_id"))), "is_no_charge": n.no_charge(value("revenue_amount").cast("decimal(14,2)"))}
    record = F.struct(*(value(t).alias(t) for t in ordered), F.col("_e164").alias("customer_phone_e164"), extra.alias("extra_fields"), *(c.alias(k) for k, c in labels.items()), *(F.col(f"_{k}").alias(f"{k}_key") for k in ("customer", "location", "equipment", "technician", "job")))
    judged = out.select(*keep, "issues", "status", F.when(F.col("status").isin("pending", "warning"), record).alias("record"), row_hash(F.col("raw")).alias("row_hash"))
    if not write:
        return judged
    written = staged(judged)
    forget(parsed)
    return written


def record_json(record: Column) -> Column:
    """A normalized record as JSON text; what is null stays out."""
    return F.to_json(record, {"ignoreNullFields": "true", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})


def record_from_json(payload: Column, schema: str) -> Column:
    """The record of ``record_json``, of the type ``schema`` (a struct's DDL)."""
    return F.from_json(payload, schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})


def with_firsts(rows: DataFrame) -> DataFrame:
    """Raw rows with ``_first``, the number of the first row of their batch with the same cells, for ``duplicates_marked``.

    Raw rows move once for it; judged ones, which are several times as wide, don't. By 16 bytes of the row hash.
    """
    same = Window.partitionBy("batch_id", "_cells")
    return rows.withColumn("_cells", F.unhex(F.substring(row_hash(F.col("raw")), 1, 32))).withColumn("_first", F.min("row_number").over(same)).drop("_cells")


def duplicates_marked(rows: DataFrame) -> DataFrame:
    """The first row of each (batch, row hash) stays, others become skipped_duplicate, whatever they were.

    The first is that of ``with_firsts`` where rows come with it. Else it is found by an aggregation on hash and number alone.
    """
    have = rows if "row_hash" in rows.columns else rows.withColumn("row_hash", row_hash(F.col("raw")))
    both = have
    if "_first" not in rows.columns:
        first = have.groupBy("batch_id", "row_hash").agg(F.min("row_number").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        both = have.join(first, ["batch_id", "row_hash"], "left")
    again = F.coalesce(F.col("row_number") > F.col("_first"), F.lit(False))
    issues = F.when(again, F.concat(F.col("issues").cast(n.ISSUES), F.array(n.issue("DUPLICATE_ROW_IN_FILE", "info")))).otherwise(F.col("issues"))
    return both.withColumns({"issues": issues, "status": F.when(again, "skipped_duplicate").otherwise(F.col("status"))}).drop("_first")


def counters(rows: DataFrame) -> DataFrame:
    """Per batch: total, errors, warnings, skipped, created, updated, importable and the batch's status."""
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    out = rows.groupBy("batch_id").agg(F.count("*").alias("total"), of("error").alias("errors"), of("warning").alias("warnings"), of("skipped_filtered", "skipped_duplicate").alias("skipped"), of("imported").alias("created"), of("updated").alias("updated"))
    return out.withColumns({"importable": F.col("total") - F.col("errors") - F.col("skipped"), "batch_status": F.when(F.col("errors") > 0, "completed_with_errors").otherwise("completed")})


def issue_report(rows: DataFrame) -> DataFrame:
    """One line per issue, cells safe for spreadsheets."""
    each = rows.where(F.size("issues") > 0).select("batch_id", "row_number", "status", F.posexplode("issues").alias("at", "i"))
    safe = lambda c: n.csv_safe(c.cast("string"))
    return each.select("batch_id", "row_number", "at", safe(F.col("status")).alias("status"), safe(F.col("i.code")).alias("error_code"), safe(F.col("i.field")).alias("field"), safe(F.col("i.message")).alias("message"), safe(F.col("i.raw_value")).alias("raw_value"))


def date_orders(values: DataFrame, most: int = 200) -> DataFrame:
    """(batch_id, date_order): a vote of each batch's first ``most`` values that aren't blank."""
    place = Window.partitionBy("batch_id").orderBy("row_number")
    few = values.where(n.stripped(F.col("value")) != "").withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= most)
    part = lambda k: F.regexp_extract(n.stripped(F.col("value")), r"^(\d{1,2})[/.-](\d{1,2})[/.-]\d{2,4}(?:\s|$)", k).try_cast("int") > 12
    return few.groupBy("batch_id").agg(n.date_order(part(1), part(2)).alias("date_order"))


def with_date_orders(rows: DataFrame, column: str) -> DataFrame:
    """Raw rows with ``date_order``, the vote of their batch's cells in ``column``; batches of no vote are ambiguous.

    There is one vote for each batch, which all tasks get, so no row moves to its batch's task.
    """
    votes = date_orders(rows.select("batch_id", "row_number", F.col("raw")[column].alias("value")))
    return rows.join(F.broadcast(votes), "batch_id", "left").withColumn("date_order", F.coalesce("date_order", F.lit("ambiguous")))


def file_duplicates(batches: DataFrame) -> DataFrame:
    """(organization_id, batch_id, original, duplicate): the tenant's earliest batch with the same bytes."""
    first = batches.groupBy("organization_id", "file_sha256").agg(F.min_by("batch_id", F.struct("created_at", "batch_id")).alias("original"))
    return batches.join(first, ["organization_id", "file_sha256"]).select("organization_id", "batch_id", "original", (F.col("batch_id") != F.col("original")).alias("duplicate"))


def active_imports(batches: DataFrame) -> DataFrame:
    """(organization_id, active): live batches of each tenant that are queued or processing."""
    return batches.groupBy("organization_id").agg(F.count_if(F.col("status").isin("queued", "processing") & F.col("deleted_at").isNull()).alias("active"))
