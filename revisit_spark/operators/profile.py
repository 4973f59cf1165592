"""Profiles of delimited files: column types, samples, headers, saved mappings, suggestions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as n

_INTEGER = r"^[+-]?\d+$"
_DATE = r"^(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4})$"
_DATETIME = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}"
_MONEY = r"^[+-]?([$€£¥]\s*)?\(?\d[\d,.]*\)?$"


def stacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(file, row_number, ordinal, name, value) of wide rows that have file and row_number."""
    cells = F.array(*(F.struct(F.lit(i + 1).alias("ordinal"), F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)))
    return rows.select("file", "row_number", F.explode(cells).alias("c")).select("file", "row_number", "c.*")


def column_types(cells: DataFrame) -> DataFrame:
    """(file, ordinal, name, type): the first kind that all values of a column that aren't blank have."""
    value = n.stripped(F.col("value"))
    some = F.when(value != "", value)
    every = lambda pattern: F.bool_and(some.rlike(pattern))
    word = F.bool_and(F.lower(some).isin(*n.TRUE_WORDS, *(w for w in n.FALSE_WORDS if w)))
    kinds = cells.groupBy("file", "ordinal", "name").agg(word.alias("b"), every(_INTEGER).alias("i"), every(_DATETIME).alias("t"), every(_DATE).alias("d"), every(_MONEY).alias("m"))
    kind = F.when(F.col("b"), "boolean").when(F.col("i"), "integer").when(F.col("t"), "datetime").when(F.col("d"), "date").when(F.col("m"), "money").otherwise("text")
    return kinds.select("file", "ordinal", "name", kind.alias("type"))


def samples(cells: DataFrame, rows: int = 20, most: int = 5) -> DataFrame:
    """(file, ordinal, name, samples): the first non-empty values within a column's first rows."""
    place = Window.partitionBy("file", "ordinal").orderBy("row_number")
    near = cells.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= rows).where(n.stripped(F.col("value")) != "")
    found = near.groupBy("file", "ordinal", "name").agg(F.array_sort(F.collect_list(F.struct("_n", "value"))).alias("v"))
    return found.select("file", "ordinal", "name", F.transform(F.slice("v", 1, most), lambda x: x["value"]).alias("samples"))


def row_counts(rows: DataFrame) -> DataFrame:
    """(file, row_count, ragged): rows of each file, and how many of them don't have as many fields as columns."""
    ragged = F.exists("issues", lambda i: i["code"].isin("TOO_MANY_COLUMNS", "TOO_FEW_COLUMNS"))
    return rows.groupBy("file").agg(F.count("*").alias("row_count"), F.count_if(ragged).alias("ragged"))


def ragged_samples(rows: DataFrame, most: int = 20) -> DataFrame:
    """(file, row_number, code) of the sampled rows (a file's first ones) with a wrong number of fields."""
    place = Window.partitionBy("file").orderBy("row_number")
    near = rows.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= most)
    shape = F.filter("issues", lambda i: i["code"].isin("TOO_MANY_COLUMNS", "TOO_FEW_COLUMNS"))
    return near.select("file", "row_number", F.explode(shape).alias("i")).select("file", "row_number", "i.code")


def unique_headers(headers: DataFrame) -> DataFrame:
    """(file, ordinal, raw, name): blanks named by place, repeats numbered from 2."""
    trimmed = n.stripped(F.col("raw"))
    base = F.when(trimmed == "", F.concat(F.lit("column_"), F.col("ordinal").cast("string"))).otherwise(trimmed)
    rows = headers.withColumn("_base", base).withColumn("_k", F.row_number().over(Window.partitionBy("file", "_base").orderBy("ordinal")))
    return rows.select("file", "ordinal", "raw", F.when(F.col("_k") > 1, F.concat_ws("_", "_base", "_k")).otherwise(F.col("_base")).alias("name"))


def signatures(headers: DataFrame) -> DataFrame:
    """(file, signature): digest of the sorted, trimmed, lower-cased headers; repeats count."""
    names = F.array_sort(F.collect_list(n.casefold(n.stripped(F.col("raw")))))
    return headers.groupBy("file").agg(F.sha2(F.array_join(names, "\u001f").cast("binary"), 256).alias("signature"))


def template_match(files: DataFrame, templates: DataFrame) -> DataFrame:
    """The saved mapping of each file: same tenant and header signature, same source or none; best one."""
    t = templates.withColumnRenamed("source", "_source")
    both = files.join(t, ["organization_id", "signature"]).where(F.col("_source").isNull() | (F.col("_source") == F.col("source")))
    best = F.max_by(F.struct(*(c for c in t.columns if c not in ("organization_id", "signature", "_source"))), F.struct("is_default", "usage_count", "created_at", "template_id"))
    return both.groupBy("organization_id", "signature", "source").agg(best.alias("t")).select("organization_id", "signature", "source", "t.*")


#: Target fields, their types where they aren't text, and header synonyms.
TYPES = {"service_date": "date", "revenue_amount": "money", "parts_amount": "money", "labor_amount": "money", "duration_minutes": "integer", "is_warranty": "boolean", "scheduled_at": "datetime", "started_at": "datetime", "completed_at": "datetime"}
SYNONYMS = {
    "external_job_id": ["job id", "work order", "work order id", "ticket id"],
    "service_date": ["service date", "completed date", "completion date", "job date", "date serviced"],
    "customer_name": ["customer", "customer name", "client", "client name", "account name", "bill to", "customer_full_name", "cust name"],
    "customer_external_id": ["customer id", "client id", "account id"],
    "customer_phone": ["phone", "customer phone", "telephone", "mobile"],
    "customer_email": ["email", "customer email", "email address"],
    "address_line1": ["address", "street", "street address", "service address"],
    "city": ["city", "town"],
    "region": ["state", "province", "region"],
    "postal_code": ["zip", "zip code", "postal code", "postcode"],
    "location_external_id": ["location id", "site id"],
    "equipment_serial": ["serial", "serial number", "equipment serial"],
    "equipment_manufacturer": ["manufacturer", "make", "equipment make"],
    "equipment_model": ["model", "model number", "equipment model"],
    "equipment_type": ["equipment type", "unit type", "asset type"],
    "equipment_external_id": ["equipment id", "asset id", "unit id"],
    "technician_name": ["technician", "tech", "technician name", "assigned tech"],
    "technician_external_id": ["technician id", "tech id"],
    "technician_code": ["technician code", "tech code", "employee code"],
    "service_category": ["service category", "category", "business unit"],
    "job_type": ["job type", "work type", "service type"],
    "job_status": ["status", "job status", "work order status"],
    "summary": ["summary", "job summary", "subject"],
    "description": ["description", "job description", "details"],
    "symptoms": ["symptoms", "complaint", "problem"],
    "diagnosis": ["diagnosis", "diagnostic", "cause"],
    "resolution": ["resolution", "repair", "work performed"],
    "technician_notes": ["technician notes", "tech notes", "notes"],
    "invoice_number": ["invoice", "invoice number", "invoice no"],
    "revenue_amount": ["revenue", "invoice total", "total", "job total"],
    "parts_amount": ["parts", "parts total", "parts amount"],
    "labor_amount": ["labor", "labour", "labor total", "labor amount"],
    "duration_minutes": ["duration", "duration minutes", "minutes", "job duration"],
    "is_warranty": ["warranty", "warranty?", "is warranty"],
    "warranty_reference": ["warranty reference", "warranty number"],
    "scheduled_at": ["scheduled at", "scheduled date", "appointment"],
    "started_at": ["started at", "start time", "arrival time"],
    "completed_at": ["completed at", "completion time", "finished at"],
}
#: Which column types a target's type takes; text takes all.
_FITS = {"date": ("date", "datetime"), "datetime": ("date", "datetime"), "money": ("integer", "money"), "integer": ("integer",), "boolean": ("boolean",)}
LEAST = 0.82


def _plain(header: str) -> str:
    return " ".join(re.sub("[^a-z0-9]+", " ", header.casefold()).split())


def closeness(headers: DataFrame, least: float = LEAST) -> DataFrame:
    """(plain, target, place, score): the targets that each distinct header is near to; a synonym, or the target's own name, scores 2."""
    known = [(t, k, [_plain(w) for w in [*words, t]]) for k, (t, words) in enumerate(SYNONYMS.items())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for plain in batch["plain"]:
                exact = next(((t, k) for t, k, words in known if plain in words), None)
                if exact:
                    out.append((plain, *exact, 2.0))
                for t, k, words in known:
                    score = max(SequenceMatcher(None, plain, w).ratio() for w in words)
                    if score >= least:
                        out.append((plain, t, k, score))
            yield pd.DataFrame(out, columns=["plain", "target", "place", "score"])

    return headers.select("plain").distinct().mapInPandas(run, "plain string, target string, place int, score double")


def suggestions(headers: DataFrame, least: float = LEAST) -> DataFrame:
    """(file, header, target, confidence) for (file, ordinal, header, type).

    In column order: a header that is a synonym (or a target's own name) takes its target for sure; if that
    is claimed, or there is none, the closest unclaimed target with a fitting type, from ``least`` on; of
    equally close ones the first. Each distinct header is compared once; a file's claims are then a fold
    over its own few headers.
    """
    plain = headers.withColumn("plain", n.header(F.col("header")))
    near = closeness(plain, least).groupBy("plain").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "place", "target"))).alias("near"))
    fits = F.create_map(*(x for t, kinds in _FITS.items() for x in (F.lit(t), F.array(*map(F.lit, kinds)))))
    kinds = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))
    rows = plain.join(near, "plain").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ordinal", "header", "type", "near"))).alias("columns"))

    def fitting(column: Column, claimed: Column) -> Column:
        allowed = lambda x: (x["down"] == -2.0) | F.try_element_at(kinds, x["target"]).isNull() | F.array_contains(fits[kinds[x["target"]]], column["type"])
        free = lambda x: allowed(x) & ~F.array_contains(claimed, x["target"])
        return F.get(F.filter(column["near"], free), F.lit(0))

    taken = "array<struct<header:string,target:string,confidence:double>>"

    def step(sofar: Column, column: Column) -> Column:
        best = fitting(column, F.transform(sofar, lambda x: x["target"]))
        one = F.array(F.struct(column["header"].alias("header"), best["target"].alias("target"), F.least(-best["down"], F.lit(1.0)).alias("confidence")))
        return F.when(best.isNull(), sofar).otherwise(F.concat(sofar, one)).cast(taken)

    return rows.select("file", F.explode(F.aggregate("columns", F.array().cast(taken), step)).alias("s")).select("file", "s.*")
