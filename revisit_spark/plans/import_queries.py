"""Queries of import: normalization, identity, profiling, validation, resolution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity
from ..functions import normalize as n
from ..operators import profile, queue, resolve, search, validate
from ..sources import delimited
from ..sources.files import file_digests
from ..sources.tables import stage_path, staged
from . import ingest
from . import testviews as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, days: tuple[str, ...] = ()):
    """Registers a query; its columns ``days`` are shown as text on both sides."""

    def add(f):
        def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = f(spark, sf_dir)
            return found.withColumns({c: F.col(c).cast("date").cast("string") for c in days}) if days else found

        QUERIES[f.__name__] = shown
        if sql and days:
            SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'{c}::DATE::VARCHAR AS {c}' for c in days)}) FROM ({sql})"
        elif sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(r"SELECT doc_id, nullif(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[\x00-\x08\x0B-\x1F\x7F-\x9F\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}]', '', 'g'), '[ \x{A0}\x{2000}-\x{200A}\x{3000}]+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '') AS value FROM documents")
def text_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "documents").select("doc_id", n.clean_text(F.col("text")).alias("value"))


_NAMES = "SELECT 'c' || c_custkey AS id, c_name || CASE c_custkey % 4 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' LLC' WHEN 2 THEN ' Ltd. Corp' ELSE '' END AS raw FROM customer UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'p' || p_partkey, p_name FROM part"


@query(rf"SELECT id, nullif(regexp_replace(trim(regexp_replace(regexp_replace(lower(raw), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), '(\s+(llc|incorporated|inc|limited|ltd|corporation|corp)\.?)+$', ''), '') AS name, replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(raw), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), '(\s+(llc|incorporated|inc|limited|ltd|corporation|corp)\.?)+$', ''), ' ', '-') AS category_key FROM ({_NAMES})")
def names_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    suffix = F.when(key % 4 == 0, ", Inc.").when(key % 4 == 1, " LLC").when(key % 4 == 2, " Ltd. Corp").otherwise("")
    customers = v.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), key).alias("id"), F.concat("c_name", suffix).alias("raw"))
    suppliers = v.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), "s_name")
    parts = v.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey"), "p_name")
    return customers.union(suppliers).union(parts).select("id", n.name(F.col("raw")).alias("name"), n.category_key(F.col("raw")).alias("category_key"))


def _padded(k, raw):
    """Raw cells as they come: with tabs, returns, no-break and wide spaces around."""
    sides = F.array(*map(F.lit, ["", "\t", " ", "\u00a0", "\r\n", "\u2003\t"]))
    return F.concat(F.get(sides, (k % 6).cast("int")), raw, F.get(sides, (k % 5).cast("int")))


@query("""WITH m AS (SELECT o_orderkey AS k, round(o_totalprice * 100)::BIGINT AS c FROM orders)
SELECT k, CASE WHEN k % 6 = 4 THEN NULL WHEN k % 6 = 3 THEN -c ELSE c END AS cents, CASE k % 6 WHEN 3 THEN 'NEGATIVE_AMOUNT' WHEN 5 THEN 'NUMBER_ROUNDED' ELSE '' END AS codes FROM m""")
def money_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long")
    whole, rest = F.expr("_c div 100"), F.lpad((F.col("_c") % 100).cast("string"), 2, "0")
    us = F.concat(F.format_number(whole, 0), F.lit("."), rest)
    us = F.when(k % 4 == 2, F.translate(us, "0123456789", "\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669")).otherwise(us)  # Arabic digits
    eu = F.concat(F.replace(F.format_number(whole, 0), F.lit(","), F.lit(".")), F.lit(","), rest)
    raw = F.when(k % 6 == 0, F.concat(F.lit("$"), us)).when(k % 6 == 1, F.concat(F.lit("EUR "), eu)).when(k % 6 == 2, us).when(k % 6 == 3, F.concat(F.lit("("), us, F.lit(")"))).when(k % 6 == 4, F.lit("n/a")).otherwise(F.concat(whole.cast("string"), F.lit("."), rest, F.lit("4")))
    rows = v.table(spark, sf_dir, "orders").withColumn("_c", c).select(k.alias("k"), _padded(k, raw).alias("raw"))
    guess, fixed = n.money(F.col("raw")), n.money(F.col("raw"), decimal=".")
    rows = rows.select("k", F.when(F.col("k") % 6 == 5, fixed).otherwise(guess).alias("m"))
    return rows.select("k", (F.col("m.value") * 100).cast("long").alias("cents"), F.array_join(F.transform("m.issues", lambda i: i["code"]), ",").alias("codes"))


@query("""SELECT k, CASE WHEN f IN (3, 6, 12) THEN NULL WHEN f = 13 THEN date_trunc('week', d)::DATE ELSE d END AS day, CASE f WHEN 3 THEN 'AMBIGUOUS_DATE_FORMAT' WHEN 6 THEN 'INVALID_DATE' WHEN 12 THEN 'INVALID_DATE' ELSE '' END AS codes
 FROM (SELECT o_orderkey AS k, o_orderkey % 16 AS f, o_orderdate::DATE AS d FROM orders)""", days=("day",))
def dates_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in sixteen forms: ISO with and without signs, by weeks, with times; both orders; names; a format of their own."""
    k, d, at = F.col("o_orderkey"), F.to_date("o_orderdate"), F.col("o_orderdate").cast("timestamp")
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), d), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
    forms = [F.date_format(at, x) for x in ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd/MM/yyyy", "d MMM yyyy", "MMMM d yyyy")]
    forms += [F.lit("no date"), F.date_format(d, "yyyyMMdd"), F.concat(week, F.lit("-"), (F.weekday(d) + 1).cast("string")), F.date_format(at, "yyyy-MM-dd'T'HH"), F.concat(F.date_format(at, "yyyyMMdd'T'HHmmss"), F.lit(",123+0530"))]
    forms += [F.date_format(d, "dd_MM_yyyy"), F.date_format(d, "yyyy-MM-'32'"), week, F.concat(F.replace(week, F.lit("-"), F.lit("")), (F.weekday(d) + 1).cast("string"), F.lit("T0930")), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'99-11:59'")]
    raw = _padded(k, F.get(F.array(*forms), (k % 16).cast("int")))
    order = F.when(k % 16 == 1, "dmy").when(k % 16 == 2, "mdy").otherwise("ambiguous")
    rows = v.table(spark, sf_dir, "orders").select(k.alias("k"), n.date(raw, "2026-01-01", order).alias("free"), n.date(raw, "2026-01-01", explicit="%d_%m_%Y").alias("given"))
    got = rows.select("k", F.when(F.col("k") % 16 == 11, F.col("given")).otherwise(F.col("free")).alias("d"))
    return got.select("k", F.col("d.value").alias("day"), F.array_join(F.transform("d.issues", lambda i: i["code"]), ",").alias("codes"))


@query("""SELECT event_id, epoch_us(CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN t - INTERVAL 8 HOUR WHEN 2 THEN t WHEN 3 THEN t - INTERVAL 2 HOUR WHEN 4 THEN t - INTERVAL 330 MINUTE WHEN 5 THEN t + INTERVAL 250 MILLISECOND
 WHEN 6 THEN date_trunc('hour', t) - INTERVAL 8 HOUR ELSE t + INTERVAL 570 MINUTE END) AS us FROM (SELECT event_id, date_trunc('second', ts) AS t FROM events)""")
def datetimes_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in eight forms, with offsets of several kinds, by weeks, down to hours, and in a format of their own."""
    k, ts, day = F.col("event_id"), F.col("ts"), F.to_date("ts")
    t = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), day), F.lit("W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"), (F.weekday(day) + 1).cast("string"))
    forms = [F.lit(" "), t, F.concat(t, F.lit("Z")), F.concat(t, F.lit("+02:00")), F.date_format(ts, "yyyyMMdd'T'HHmmss'+0530'"), F.concat(week, F.date_format(ts, " HH:mm:ss',25Z'")), F.date_format(ts, "yyyy-MM-dd'T'HH"), F.date_format(ts, "d.M.yyyy HH:mm:ss '-0930'")]
    raw = _padded(k, F.get(F.array(*forms), (k % 8).cast("int")))
    rows = v.table(spark, sf_dir, "events").select(k, n.moment(raw, "Asia/Manila")["value"].alias("free"), n.moment(raw, "Asia/Manila", explicit="%d.%m.%Y %H:%M:%S %z")["value"].alias("given"))
    return rows.select("event_id", F.unix_micros(F.when(F.col("event_id") % 8 == 7, F.col("given")).otherwise(F.col("free"))).alias("us"))


@query("SELECT event_id, event_type IN ('purchase', 'click') OR (event_type = 'signup' AND event_id % 2 = 0) AS flag, CASE WHEN event_type = 'error' OR (event_type = 'signup' AND event_id % 2 = 1) THEN 'UNKNOWN_ENUM_VALUE' ELSE '' END AS codes FROM events")
def booleans_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    raw = F.when(t == "purchase", " YES ").when(t == "click", "x").when(t == "error", "perhaps").when(t == "view", "No").when(F.col("event_id") % 2 == 0, "SI").otherwise("nein")
    got = v.table(spark, sf_dir, "events").select("event_id", n.boolean(_padded(F.col("event_id"), raw), more_true=("si",)).alias("b"))
    return got.select("event_id", F.col("b.value").alias("flag"), F.array_join(F.transform("b.issues", lambda i: i["code"]), ",").alias("codes"))


@query("SELECT event_id, CASE WHEN event_id % 5 >= 3 THEN NULL ELSE user_id END AS number, CASE event_id % 5 WHEN 4 THEN 'INVALID_NUMBER' ELSE '' END AS codes FROM events")
def integers_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("event_id"), F.col("user_id").cast("string")
    raw = F.when(k % 5 == 0, u).when(k % 5 == 1, F.concat(u, F.lit(".0"))).when(k % 5 == 2, F.concat(F.lit(" "), u, F.lit(" "))).when(k % 5 == 3, "").otherwise(F.concat(u, F.lit(".5")))
    got = v.table(spark, sf_dir, "events").select("event_id", n.integer(_padded(k, raw)).alias("i"))
    return got.select("event_id", F.col("i.value").alias("number"), F.array_join(F.transform("i.issues", lambda i: i["code"]), ",").alias("codes"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '+63917' || lpad(c_custkey::VARCHAR, 7, '0') WHEN 1 THEN NULL ELSE '+1415' || lpad((2000000 + c_custkey)::VARCHAR, 7, '0') END AS e164 FROM customer")
def phones_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    seven = F.lpad(F.when(k % 3 == 2, k + 2_000_000).otherwise(k).cast("string"), 7, "0")
    raw = F.when(k % 3 == 0, F.concat(F.lit("+63 (917) "), seven)).when(k % 3 == 1, F.concat(F.lit("0917-"), seven)).otherwise(F.concat(F.lit("+1.415."), seven))
    return v.table(spark, sf_dir, "customer").select(k, n.phone(raw).alias("e164"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '''=' ELSE '' END || text AS cell FROM documents")
def csv_safe_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.when(F.col("doc_id") % 4 == 0, "=").otherwise(""), F.col("text"))
    return v.table(spark, sf_dir, "documents").select("doc_id", n.csv_safe(raw).alias("cell"))


_KEYS = """SELECT id, sha256(CASE way WHEN 'external_id' THEN concat_ws('|', org, 7, ext) WHEN 'phone' THEN concat_ws('|', org, phone) WHEN 'name_postal' THEN concat_ws('|', org, name, '1000') ELSE concat_ws('|', org, name) END) AS digest, way AS strategy, way = 'name_only' AS low_confidence FROM (
 SELECT c_custkey AS id, n_regionkey AS org, 'C-' || c_custkey AS ext, '+63917' || lpad(c_custkey::VARCHAR, 7, '0') AS phone, lower(replace(c_name, '#', ' ')) AS name,
  CASE c_custkey % 4 WHEN 0 THEN 'external_id' WHEN 1 THEN 'phone' WHEN 2 THEN 'name_postal' ELSE 'name_only' END AS way FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(_KEYS)
def natural_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = v.table(spark, sf_dir, "customer").join(v.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = identity.customer(F.col("n_regionkey"), F.lit(7), F.when(k % 4 == 0, F.concat(F.lit("C-"), k)), F.when(k % 4 == 1, F.concat(F.lit("+63917"), F.lpad(k.cast("string"), 7, "0"))), F.col("c_name"), F.when(k % 4 == 2, F.lit(" 1000 ")))
    return rows.select(k.alias("id"), key.alias("key")).select("id", "key.*")


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job rows as an export might have them: (batch_id, row_number, raw).

    Dealt by id, narrow, before the cells are made: a table of one row group would be judged in one task, and
    judging costs far more than its bytes tell, so the number is given and not made smaller by their size.
    """
    k, parts = F.col("id"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    cell = lambda name, value: [F.lit(name), F.coalesce(value.cast("string"), F.lit(""))]
    cells = [
        *cell("Job ID", F.when(k % 9 != 0, F.concat(F.lit("J"), k))), *cell("Customer ID", F.when(k % 13 != 0, F.col("customer_id"))), *cell("Customer", F.when(k % 39 != 0, F.concat(F.lit("Customer "), F.col("customer_id")))),
        *cell("Date", F.when(k % 17 != 0, F.date_format("service_date", "yyyy-MM-dd")).otherwise("soon")), *cell("Status", F.when(k % 10 == 0, "Estimate").when(k % 10 == 1, "Odd").otherwise("Closed")),
        *cell("Revenue", F.when(k % 8 == 0, F.concat(F.lit("-"), F.col("revenue").cast("string"))).otherwise(F.col("revenue").cast("string"))), *cell("Serial", F.when(k % 6 != 0, F.concat(F.lit("sn"), F.col("equipment_id")))), *cell("Zone", F.concat(F.lit("z"), k % 5)),
    ]
    return v.jobs(spark, sf_dir).repartition(parts, "id").select(F.col("organization_id"), (k % 20).alias("batch_id"), (F.expr("id div 20") + 2).alias("row_number"), F.create_map(*cells).alias("raw"), k.alias("id"))


MAPPING = validate.Mapping(
    fields={"external_job_id": "Job ID", "customer_external_id": "Customer ID", "customer_name": "Customer", "service_date": "Date", "job_status": "Status", "revenue_amount": "Revenue", "equipment_serial": "Serial"},
    retain=("Zone",), skip=(validate.Skip("Status", "equals", "estimate"),), status_map={"Closed": "completed"},
)

_VALIDATED = f"""{v.JOBS_SQL}, x AS (SELECT *, id % 20 AS batch_id, id // 20 + 2 AS row_number,
    id % 10 = 0 AS skipped, id % 17 = 0 AS bad_date, id % 13 = 0 AND id % 39 = 0 AS no_customer, id % 10 = 1 AS odd, coalesce(id % 8 = 0 AND revenue > 0, false) AS minus, id % 6 = 0 OR equipment_id IS NULL AS no_gear FROM jobs),
y AS (SELECT *, CASE WHEN skipped THEN 'skipped_filtered' WHEN bad_date OR no_customer THEN 'error' WHEN odd OR minus THEN 'warning' ELSE 'pending' END AS status_of FROM x)"""


@query(_VALIDATED + """ SELECT organization_id, batch_id, row_number, status_of AS status, CASE WHEN skipped THEN 'ROW_SKIPPED_BY_FILTER' ELSE concat_ws(',', CASE WHEN bad_date THEN 'INVALID_DATE' END, CASE WHEN minus THEN 'NEGATIVE_AMOUNT' END,
 CASE WHEN odd THEN 'UNKNOWN_ENUM_VALUE' END, CASE WHEN no_customer THEN 'UNRESOLVABLE_CUSTOMER' END, CASE WHEN no_gear THEN 'EQUIPMENT_NOT_RESOLVED' END) END AS codes,
 CASE WHEN status_of IN ('pending', 'warning') THEN service_date END AS service_date, CASE WHEN status_of IN ('pending', 'warning') THEN CASE WHEN odd THEN 'unknown' ELSE 'completed' END END AS job_status FROM y""", days=("service_date",))
def validated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.validated(raw_rows(spark, sf_dir), MAPPING, today="2026-01-01")
    return rows.select("organization_id", "batch_id", "row_number", "status", F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"), F.col("record.service_date").alias("service_date"), F.col("record.job_status").alias("job_status"))


@query(_VALIDATED + " SELECT batch_id, count(*) AS total, count_if(status_of = 'error')::BIGINT AS errors, count_if(status_of = 'warning')::BIGINT AS warnings, count_if(skipped)::BIGINT AS skipped, (count(*) - count_if(status_of = 'error') - count_if(skipped))::BIGINT AS importable FROM y GROUP BY batch_id")
def batch_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.counters(validate.validated(raw_rows(spark, sf_dir), MAPPING, today="2026-01-01")).select("batch_id", "total", "errors", "warnings", "skipped", "importable")


#: A stored mapping: two dates of different formats and zones, separators, words for true, a status map.
DOCUMENT = {
    "version": 1,
    "fields": {
        "external_job_id": {"source_column": "Job ID"}, "customer_name": {"source_column": "Customer"}, "service_date": {"source_column": "Date", "transform": {"type": "date", "format": "%d_%m_%Y"}},
        "started_at": {"source_column": "Start", "transform": {"type": "datetime", "format": "%m/%d/%Y %I:%M %p", "timezone": "America/New_York", "repeated": "later"}}, "completed_at": {"source_column": "End"},
        "revenue_amount": {"source_column": "Revenue", "transform": {"type": "money", "decimal_separator": ",", "thousands_separator": " "}}, "parts_amount": {"source_column": "Parts"},
        "is_warranty": {"source_column": "Guarantee", "transform": {"type": "boolean", "true_values": ["Si"]}}, "job_status": {"source_column": "Status", "transform": {"type": "value_map", "map": {"Closed": "completed"}}},
    },
    "skip_rows_where": [{"column": "Status", "operator": "contains", "value": "DRAFT"}, {"column": "Zone", "operator": "is_empty"}, {"column": "Zone", "operator": "equals", "value": "stra\u00dfe"}],
}


@query(f"""{v.JOBS_SQL}, x AS (SELECT *, id % 13 = 0 OR id % 11 = 0 OR id % 19 = 0 AS skipped, id % 7 = 0 AS bad, id % 29 = 0 AS cut FROM jobs)
SELECT id % 20 AS batch_id, id // 20 + 2 AS row_number, CASE WHEN skipped THEN 'skipped_filtered' WHEN bad THEN 'error' WHEN cut THEN 'warning' ELSE 'pending' END AS status,
 CASE WHEN skipped THEN CASE WHEN cut THEN 'ENCODING_REPLACEMENT,' ELSE '' END || 'ROW_SKIPPED_BY_FILTER' ELSE concat_ws(',', CASE WHEN cut THEN 'ENCODING_REPLACEMENT' END, CASE WHEN bad THEN 'INVALID_DATE' END, 'EQUIPMENT_NOT_RESOLVED') END AS codes,
 CASE WHEN NOT skipped AND NOT bad THEN service_date END AS service_date, CASE WHEN NOT skipped AND NOT bad THEN epoch(((service_date::TIMESTAMP + to_hours(id % 24)) AT TIME ZONE 'America/New_York'))::BIGINT END AS started,
 CASE WHEN NOT skipped AND NOT bad THEN epoch(service_date::TIMESTAMP + to_hours(id % 24) - INTERVAL 8 HOUR)::BIGINT END AS completed, CASE WHEN NOT skipped AND NOT bad THEN (coalesce(revenue, 0) * 100)::BIGINT END AS cents,
 CASE WHEN NOT skipped AND NOT bad THEN (coalesce(revenue, 0) * 100)::BIGINT END AS parts_cents, CASE WHEN NOT skipped AND NOT bad THEN is_warranty END AS is_warranty, CASE WHEN NOT skipped AND NOT bad THEN 'completed' END AS job_status FROM x""", days=("service_date",))
def validated_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch under a stored mapping whose fields have transforms of their own."""
    k, c = F.col("id"), (F.coalesce("revenue", F.lit(0)) * 100).cast("long")
    parts, at = int(spark.conf.get("spark.sql.shuffle.partitions")), F.timestamp_add("HOUR", (k % 24).cast("int"), F.col("service_date").cast("timestamp"))
    spaced = F.concat(F.replace(F.format_number(F.floor(c / 100), 0), F.lit(","), F.lit(" ")), F.lit(","), F.lpad((c % 100).cast("string"), 2, "0"))
    plain = F.concat(F.floor(c / 100).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))
    cells = {
        "Job ID": F.concat(F.lit("J"), k), "Customer": F.concat(F.lit("Customer "), F.col("customer_id"), F.when(k % 29 == 0, "\ufffd").otherwise("")), "Date": F.when(k % 7 == 0, F.date_format("service_date", "yyyy-MM-dd")).otherwise(F.date_format("service_date", "d_M_yyyy")),
        "Start": F.date_format(at, "MM/dd/yyyy hh:mm a"), "End": F.date_format(at, "yyyy-MM-dd'T'HH:mm"), "Revenue": spaced, "Parts": plain, "Guarantee": F.when(F.col("is_warranty"), "SI").otherwise("no"),
        "Status": F.when(k % 13 == 0, "my draft").otherwise("Closed"), "Zone": F.when(k % 11 == 0, " ").when(k % 19 == 0, "STRASSE").otherwise("z"),
    }
    raw = F.create_map(*(x for name, cell in cells.items() for x in (F.lit(name), cell)))
    rows = v.jobs(spark, sf_dir).repartition(parts, "id").select("organization_id", (k % 20).alias("batch_id"), (F.expr("id div 20") + 2).alias("row_number"), raw.alias("raw"))
    found = validate.validated(rows, validate.Mapping.from_document(DOCUMENT, zone="Asia/Manila"), today="2026-01-01")
    cents = lambda t: (F.col(f"record.{t}") * 100).cast("long")
    return found.select("batch_id", "row_number", "status", F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"), "record.service_date", F.unix_seconds("record.started_at").alias("started"), F.unix_seconds("record.completed_at").alias("completed"), cents("revenue_amount").alias("cents"), cents("parts_amount").alias("parts_cents"), "record.is_warranty", "record.job_status")


_MESSAGE = "CASE error_code " + " ".join(f"WHEN '{code}' THEN '{said.replace(chr(39), chr(39) * 2)}'" for code, said in n.MESSAGES.items()) + " END"
_REPORT = _VALIDATED + f""", e AS (SELECT batch_id, row_number, unnest(CASE WHEN skipped THEN ['ROW_SKIPPED_BY_FILTER'] ELSE list_filter([CASE WHEN bad_date THEN 'INVALID_DATE' END, CASE WHEN minus THEN 'NEGATIVE_AMOUNT' END,
 CASE WHEN odd THEN 'UNKNOWN_ENUM_VALUE' END, CASE WHEN no_customer THEN 'UNRESOLVABLE_CUSTOMER' END, CASE WHEN no_gear THEN 'EQUIPMENT_NOT_RESOLVED' END], lambda c: c IS NOT NULL) END) AS error_code, status_of AS status,
 id, revenue FROM y), report AS (SELECT batch_id, row_number, status, error_code, CASE error_code WHEN 'INVALID_DATE' THEN 'service_date' WHEN 'NEGATIVE_AMOUNT' THEN 'revenue_amount' WHEN 'UNKNOWN_ENUM_VALUE' THEN 'job_status' ELSE '' END AS field, {_MESSAGE} AS message,
 CASE error_code WHEN 'INVALID_DATE' THEN 'soon' WHEN 'NEGATIVE_AMOUNT' THEN '''-' || revenue WHEN 'UNKNOWN_ENUM_VALUE' THEN 'Odd' ELSE '' END AS raw_value FROM e)"""


@query(_REPORT + " SELECT * FROM report")
def issue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.validated(raw_rows(spark, sf_dir), MAPPING, today="2026-01-01")
    return validate.issue_report(rows).select("batch_id", "row_number", "status", "error_code", "field", "message", "raw_value")


@query(_REPORT + ", p AS (SELECT DISTINCT batch_id, row_number FROM report WHERE batch_id = 3 AND row_number > 40) SELECT row_number FROM p ORDER BY row_number LIMIT 51")
def issue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of a batch's rows with issues behind row 40. Rows are judged one by one, so only that batch's are."""
    rows = validate.validated(raw_rows(spark, sf_dir).where("batch_id = 3"), MAPPING, today="2026-01-01").where("size(issues) > 0")
    return queue.ascending(rows.select("row_number", "id"), ["row_number"], cursor=(40,)).select("row_number")


@query(_REPORT + """ SELECT 'row_number,status,error_code,field,message,raw_value' AS line UNION ALL SELECT concat_ws(',', '"' || row_number || '"', '"' || status || '"', '"' || error_code || '"', '"' || field || '"', '"' || replace(message, '"', '""') || '"', '"' || raw_value || '"') FROM report""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the judged rows only what a report tells is written; their records and hashes aren't made."""
    rows = validate.validated(raw_rows(spark, sf_dir), MAPPING, today="2026-01-01", write=False)
    report = validate.issue_report(staged(rows.select("batch_id", "row_number", "status", "issues")))
    return delimited.report_lines(report).select(F.regexp_replace("value", "\r$", "").alias("line"))


@query(_VALIDATED + """ SELECT batch_id, row_number, CASE WHEN id % 9 <> 0 THEN 'J' || id END AS external_job_id, CASE WHEN odd THEN 'unknown' ELSE 'completed' END AS job_status, service_date,
 CASE WHEN minus THEN -revenue ELSE revenue END::DOUBLE AS revenue, 'z' || id % 5 AS zone, coalesce(revenue = 0, false) AS is_no_charge, CASE WHEN id % 39 <> 0 THEN 'Customer ' || customer_id ELSE customer_id::VARCHAR END AS customer_label, true AS same FROM y WHERE status_of IN ('pending', 'warning')""", days=("service_date",))
def record_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON and read again: the text alone is what is written."""
    rows = validate.validated(raw_rows(spark, sf_dir), MAPPING, today="2026-01-01", write=False)
    schema = rows.schema["record"].dataType.simpleString()
    told = staged(rows.select("batch_id", "row_number", validate.record_json(F.col("record")).alias("payload"))).where("payload is not null")
    back = told.withColumn("back", validate.record_from_json(F.col("payload"), schema))
    same = F.col("payload") == validate.record_json(F.col("back"))
    b = lambda c: F.col(f"back.{c}")
    return back.select("batch_id", "row_number", b("external_job_id").alias("external_job_id"), b("job_status").alias("job_status"), b("service_date").alias("service_date"), b("revenue_amount").cast("double").alias("revenue"), b("extra_fields")["Zone"].alias("zone"), b("is_no_charge").alias("is_no_charge"), b("customer_label").alias("customer_label"), same.alias("same"))


_LINES = """WITH x AS (SELECT o_orderkey AS id, o_orderkey % 8 AS batch_id, o_custkey AS c, o_orderpriority AS p, row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_orderkey) AS n FROM orders)"""
_COLUMNS = ["Job ID", "Customer", "Priority"]


def delimited_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as eight delimited files with headers (quoted cells, short and long rows), and read again."""
    k = F.col("o_orderkey")
    quoted = F.concat(F.lit('"Customer ""'), "o_custkey", F.lit('"", Inc."'))
    line = F.concat_ws(",", k.cast("string"), quoted, F.when(k % 7 != 0, F.col("o_orderpriority")), F.when(k % 11 == 0, F.concat_ws(",", *(F.lit(f"e{i}") for i in range(12)))))
    lines = v.table(spark, sf_dir, "orders").select((k % 8).alias("batch"), k.alias("k"), line.alias("value"))
    heads = spark.range(8).select(F.col("id").alias("batch"), F.lit(-1).cast("long").alias("k"), F.lit(",".join(_COLUMNS)).alias("value"))
    path = stage_path(spark, "delimited")
    lines.union(heads).repartition("batch").sortWithinPartitions("batch", "k").select("batch", "value").write.partitionBy("batch").text(path)
    rows = delimited.read_rows(spark, f"{path}/batch=*/*", _COLUMNS)
    return rows.withColumn("batch_id", F.regexp_extract("file", "batch=([0-9]+)", 1).cast("long"))


@query(_LINES + """ SELECT batch_id, n + 1 AS row_number, id::VARCHAR AS job_id, 'Customer "' || c || '", Inc.' AS customer, CASE WHEN id % 7 <> 0 THEN p WHEN id % 11 = 0 THEN 'e0' ELSE '' END AS priority,
 CASE WHEN id % 11 = 0 THEN CASE WHEN id % 7 <> 0 THEN 12 ELSE 11 END ELSE 0 END AS extra, CASE WHEN id % 11 = 0 THEN 'e11' END AS last_extra, CASE WHEN id % 11 = 0 THEN 'TOO_MANY_COLUMNS' WHEN id % 7 = 0 THEN 'TOO_FEW_COLUMNS' ELSE '' END AS codes FROM x""")
def delimited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, extra = F.col("raw"), F.size("raw") - 3
    return delimited_files(spark, sf_dir).select("batch_id", "row_number", raw["Job ID"].alias("job_id"), raw["Customer"].alias("customer"), raw["Priority"].alias("priority"), extra.alias("extra"), F.when(extra > 0, F.element_at(raw, F.concat(F.lit("__extra_"), extra.cast("string")))).alias("last_extra"), F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"))


@query(_LINES + """ SELECT batch_id, n + 1 AS row_number, id::VARCHAR AS job_id, CASE WHEN id % 3 = 0 THEN 'Customer "' || c || '",' || chr(10) || chr(10) || 'Inc.' WHEN id % 3 = 1 THEN p ELSE '' END AS customer FROM x""")
def multi_line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as eight delimited files whose quoted cells hold line ends, and read again in parts."""
    k = F.col("o_orderkey")
    cell = F.when(k % 3 == 0, F.concat(F.lit('"Customer ""'), "o_custkey", F.lit('"",\n\nInc."'))).when(k % 3 == 1, F.col("o_orderpriority")).otherwise('""')
    lines = v.table(spark, sf_dir, "orders").select((k % 8).alias("batch"), k.alias("k"), F.concat_ws(",", k.cast("string"), cell).alias("value"))
    heads = spark.range(8).select(F.col("id").alias("batch"), F.lit(-1).cast("long").alias("k"), F.lit("Job ID,Customer").alias("value"))
    path = stage_path(spark, "delimited")
    lines.union(heads).repartition("batch").sortWithinPartitions("batch", "k").select("batch", "value").write.partitionBy("batch").text(path)
    rows = delimited.read_rows(spark, f"{path}/batch=*/*", ["Job ID", "Customer"], multi_line=True)
    return rows.select(F.regexp_extract("file", "batch=([0-9]+)", 1).cast("long").alias("batch_id"), "row_number", F.col("raw")["Job ID"].alias("job_id"), F.col("raw")["Customer"].alias("customer"))


@query(_LINES + " SELECT batch_id, count(*) AS row_count, count_if(id % 7 = 0 OR id % 11 = 0)::BIGINT AS ragged, count_if((id % 7 = 0 OR id % 11 = 0) AND n <= 20)::BIGINT AS ragged_samples FROM x GROUP BY 1")
def file_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(delimited_files(spark, sf_dir).drop("file").withColumnRenamed("batch_id", "file"))
    near = profile.ragged_samples(rows).groupBy("file").agg(F.count("*").alias("ragged_samples"))
    return profile.row_counts(rows).join(near, "file", "left").fillna(0, ["ragged_samples"]).withColumnRenamed("file", "batch_id")


@query("SELECT source AS batch_id, doc_id AS row_number, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) > 1 AS duplicate FROM documents")
def in_file_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.table(spark, sf_dir, "documents")
    rows = docs.select(F.col("source").alias("batch_id"), F.col("doc_id").alias("row_number"), F.lit("pending").alias("status"), F.create_map(F.lit("text"), "text").alias("raw"), n.no_issues().alias("issues"))
    return validate.duplicates_marked(rows).select("batch_id", "row_number", (F.col("status") == "skipped_duplicate").alias("duplicate"))


@query("SELECT doc_id AS batch_id, min(doc_id) OVER (PARTITION BY source, sha256(text)) AS original, doc_id > min(doc_id) OVER (PARTITION BY source, sha256(text)) AS duplicate FROM documents")
def file_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.table(spark, sf_dir, "documents")
    batches = docs.select(F.col("source").alias("organization_id"), F.col("doc_id").alias("batch_id"), F.sha2("text", 256).alias("file_sha256"), F.col("doc_id").alias("created_at"))
    return validate.file_duplicates(batches).select("batch_id", "original", "duplicate")


@query("""WITH x AS (SELECT p_brand AS batch_id, p_partkey AS row_number, DATE '1995-01-01' + (p_partkey % 2400)::INTEGER AS d FROM part),
s AS (SELECT batch_id, CASE WHEN hash_order % 2 = 0 THEN day(d) ELSE month(d) END AS a, CASE WHEN hash_order % 2 = 0 THEN month(d) ELSE day(d) END AS b FROM
 (SELECT *, regexp_extract(batch_id, '([0-9])$', 1)::INTEGER AS hash_order, row_number() OVER (PARTITION BY batch_id ORDER BY row_number) AS rn FROM x) WHERE rn <= 200)
SELECT batch_id, CASE WHEN bool_or(a > 12) AND NOT bool_or(b > 12) THEN 'dmy' WHEN bool_or(b > 12) AND NOT bool_or(a > 12) THEN 'mdy' ELSE 'ambiguous' END AS date_order FROM s GROUP BY batch_id""")
def date_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") % 2400).cast("int"))
    even = F.regexp_extract("p_brand", "([0-9])$", 1).cast("int") % 2 == 0
    rows = v.table(spark, sf_dir, "part").select(F.col("p_brand").alias("batch_id"), F.col("p_partkey").alias("row_number"), F.when(even, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy")).alias("value"))
    return validate.date_orders(rows)


_KINDS = """WITH o AS (SELECT o_orderkey % 60 AS file, o_orderkey AS k, o_orderdate::DATE AS d, round(o_totalprice)::BIGINT AS t FROM orders), c AS (
 SELECT file, k, 'a' AS name, CASE file % 4 WHEN 0 THEN CASE k % 3 WHEN 0 THEN 'Warranty' WHEN 1 THEN ' x ' ELSE 'NO' END WHEN 1 THEN CASE WHEN k % 2 = 0 THEN '1' ELSE '0' END WHEN 2 THEN '+' || k ELSE CASE WHEN k % 5 = 0 THEN '' ELSE 'word' END END AS value FROM o
 UNION ALL SELECT file, k, 'b', CASE file % 5 WHEN 0 THEN year(d) || '-' || month(d) || '-' || day(d) WHEN 1 THEN day(d) || '/' || month(d) || '/' || year(d) WHEN 2 THEN day(d) || '.' || month(d) || '.' || right(year(d)::VARCHAR, 2) WHEN 3 THEN strftime(d, '%-d %b %Y') ELSE year(d) || '-' || month(d) || '-' || day(d) || 'T9:30' END FROM o
 UNION ALL SELECT file, k, 'c', CASE file % 6 WHEN 0 THEN '¥ ' || t WHEN 1 THEN '-$' || t || '.50' WHEN 2 THEN '(' || t || ')' WHEN 3 THEN '1 ' || t WHEN 4 THEN t || ',5' ELSE '' END FROM o
), s AS (SELECT file, name, trim(value) AS x FROM c WHERE trim(value) <> ''), g AS (SELECT file, name, bool_and(lower(x) IN ('y', 'yes', 'true', 't', '1', 'x', 'warranty', 'n', 'no', 'false', 'f', '0')) AS b, bool_and(regexp_full_match(x, '[+-]?[0-9]+')) AS i,
 bool_and(regexp_matches(x, '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[T ][0-9]{1,2}:[0-9]{2}')) AS t, bool_and(regexp_full_match(x, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}')) AS d, bool_and(regexp_full_match(x, '[+-]?([$€£¥] *)?[(]?[0-9][0-9,.]*[)]?')) AS m FROM s GROUP BY 1, 2)
SELECT f.file, f.name, CASE WHEN b THEN 'boolean' WHEN i THEN 'integer' WHEN t THEN 'datetime' WHEN d THEN 'date' WHEN m THEN 'money' ELSE 'text' END AS type FROM (SELECT DISTINCT file, name FROM c) f LEFT JOIN g USING (file, name)"""


@query(_KINDS)
def column_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, file = F.col("o_orderkey"), F.col("o_orderkey") % 60
    d, t = F.to_date("o_orderdate"), F.round("o_totalprice").cast("long").cast("string")
    y, m, day = (f(d).cast("string") for f in (F.year, F.month, F.day))
    pick = lambda of, *values: F.get(F.array(*(x.cast("string") if not isinstance(x, str) else F.lit(x) for x in values)), (file % of).cast("int"))
    a = pick(4, F.when(k % 3 == 0, "Warranty").when(k % 3 == 1, "\tx\u00a0").otherwise("NO"), F.when(k % 2 == 0, "1").otherwise("0"), F.concat(F.lit("+"), k), F.when(k % 5 == 0, "\t").otherwise("word"))
    b = pick(5, F.concat_ws("-", y, m, day), F.concat_ws("/", day, m, y), F.concat_ws(".", day, m, F.substring(y, 3, 2)), F.date_format(d, "d MMM yyyy"), F.concat(F.concat_ws("-", y, m, day), F.lit("T9:30")))
    c = pick(6, F.concat(F.lit("¥ "), t), F.concat(F.lit("-$"), t, F.lit(".50")), F.concat(F.lit("("), t, F.lit(")")), F.concat(F.lit("1 "), t), F.concat(t, F.lit(",5")), "")
    rows = v.table(spark, sf_dir, "orders").select(file.alias("file"), k.alias("row_number"), a.alias("a"), b.alias("b"), c.alias("c"))
    return profile.column_types(profile.stacked(rows, ["a", "b", "c"])).select("file", "name", "type")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = v.table(spark, sf_dir, "orders")
    at = o.select("o_orderkey").withColumn("n", F.row_number().over(Window.orderBy("o_orderkey"))).where("n <= 20 and n % 3 = 0").select(F.col("o_orderkey").alias("_k"))
    o = o.join(at, F.col("o_orderkey") == F.col("_k"), "left")
    cells = {"late": F.when(F.col("_k").isNotNull(), F.col("o_orderpriority")).otherwise(""), "flag": (F.col("o_orderkey") % 2).cast("string"), "key": F.col("o_orderkey").cast("string"), "total": F.format_number("o_totalprice", 2), "day": F.date_format("o_orderdate", "yyyy-MM-dd"), "moment": F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), "priority": F.col("o_orderpriority"), "nothing": F.lit("")}
    return profile.stacked(o.select(F.lit("orders").alias("file"), F.col("o_orderkey").alias("row_number"), *(c.alias(k) for k, c in cells.items())), list(cells))


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders), c AS (SELECT n, unnest([{'name': 'flag', 'x': (o_orderkey % 2)::VARCHAR}, {'name': 'key', 'x': o_orderkey::VARCHAR}, {'name': 'total', 'x': format('{:,.2f}', o_totalprice)},
 {'name': 'day', 'x': strftime(o_orderdate, '%Y-%m-%d')}, {'name': 'moment', 'x': strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')}, {'name': 'priority', 'x': o_orderpriority}, {'name': 'late', 'x': CASE WHEN n % 3 = 0 THEN o_orderpriority ELSE '' END}, {'name': 'nothing', 'x': ''}]) AS c FROM r WHERE n <= 20)
SELECT 'orders' AS file, c.name AS name, coalesce(string_agg(c.x, '|' ORDER BY n) FILTER (c.x <> '' AND k <= 5), '') AS samples FROM (SELECT *, count(*) FILTER (c.x <> '') OVER (PARTITION BY c.name ORDER BY n) AS k FROM c) GROUP BY c.name""")
def column_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    heads = cells.select("file", "name").distinct()
    found = heads.join(profile.samples(cells), ["file", "name"], "left")
    return found.select("file", "name", F.coalesce(F.array_join("samples", "|"), F.lit("")).alias("samples"))


@query("""WITH h AS (SELECT p_brand AS file, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS ordinal, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_type END AS raw FROM part),
b AS (SELECT *, CASE WHEN trim(raw) = '' THEN 'column_' || ordinal ELSE trim(raw) END AS base FROM h)
SELECT file, ordinal::INTEGER AS ordinal, base || CASE WHEN row_number() OVER (PARTITION BY file, base ORDER BY ordinal) > 1 THEN '_' || row_number() OVER (PARTITION BY file, base ORDER BY ordinal) ELSE '' END AS name FROM b""")
def unique_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.unique_headers(_headers(spark, sf_dir)).select("file", "ordinal", "name")


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return v.table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), place.alias("ordinal"), F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.col("p_type")).alias("raw"))


@query("SELECT p_brand AS file, sha256(string_agg(h, chr(31) ORDER BY h)) AS signature FROM (SELECT p_brand, lower(trim(CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_type END)) AS h FROM part) GROUP BY p_brand")
def header_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.signatures(_headers(spark, sf_dir))


@query("""WITH t AS (SELECT c_custkey AS template_id, c_nationkey AS organization_id, c_mktsegment AS signature, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 3 END AS source, c_custkey % 5 = 0 AS is_default, c_custkey % 7 AS usage_count FROM customer),
f AS (SELECT DISTINCT organization_id, signature FROM t) SELECT organization_id, signature, template_id FROM (SELECT t.*, row_number() OVER (PARTITION BY organization_id, signature ORDER BY is_default DESC, usage_count DESC, template_id DESC) AS n FROM t WHERE source IS NULL OR source = 1) WHERE n = 1""")
def template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    templates = v.table(spark, sf_dir, "customer").select(k.alias("template_id"), F.col("c_nationkey").alias("organization_id"), F.col("c_mktsegment").alias("signature"), F.when(k % 3 > 0, k % 3).alias("source"), (k % 5 == 0).alias("is_default"), (k % 7).alias("usage_count"), k.alias("created_at"))
    files = templates.select("organization_id", "signature").distinct().withColumn("source", F.lit(1))
    return profile.template_match(files, templates).select("organization_id", "signature", "template_id")


_HEADERS = {"Client Name": ("text", "customer_name", 1.0), "Servce Date": ("date", "service_date", 22 / 23), "Invoce Total": ("money", "revenue_amount", 24 / 25), "Job ID": ("text", "external_job_id", 1.0), " zip-CODE ": ("text", "postal_code", 1.0), "Colour": ("text", None, None),
    "equipment_manufacturer": ("text", "equipment_manufacturer", 1.0), "Start Tme": ("integer", None, None), "Warrantee": ("text", None, None), "Warranty?": ("boolean", "is_warranty", 1.0), "Customr Name": ("text", None, None)}


@query("WITH h(k, header, target, confidence) AS (VALUES " + ", ".join(f"({i}, '{h}', '{t}', {c!r}::DOUBLE)" for i, (h, (_, t, c)) in enumerate(_HEADERS.items()) if t) + f") SELECT DISTINCT p_brand AS file, header, target, round(confidence, 6) AS confidence FROM part JOIN h ON p_partkey % {len(_HEADERS)} = k AND (k <> 0 OR substr(p_brand, 7, 1) <> '3')"
    f" UNION ALL SELECT DISTINCT p_brand, 'Customr Name', 'customer_name', 0.96 FROM part WHERE p_partkey % {len(_HEADERS)} = 10 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey % {len(_HEADERS)} = 0 AND substr(p_brand, 7, 1) <> '3')")
def mapping_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of a file for each brand: synonyms, a target's own name, misspelt ones, ones whose type doesn't
    fit, one whose target is claimed by an earlier header (files of some brands don't have that one, and take it)."""
    k = F.col("p_partkey") % len(_HEADERS)
    name, kind = (F.get(F.array(*map(F.lit, values)), k.cast("int")) for values in (list(_HEADERS), [x[0] for x in _HEADERS.values()]))
    parts = v.table(spark, sf_dir, "part").where((k != 0) | (F.substring("p_brand", 7, 1) != "3"))
    heads = parts.select(F.col("p_brand").alias("file"), k.cast("int").alias("ordinal"), name.alias("header"), kind.alias("type")).distinct()
    return profile.suggestions(heads).withColumn("confidence", F.round("confidence", 6))


def _batches(spark: SparkSession, sf_dir: str, late: bool) -> DataFrame:
    """Two import batches of the same customers: the second has what the first left blank."""
    k = F.col("id")
    jobs = v.jobs(spark, sf_dir).where(k % 2 == (1 if late else 0))
    blank = F.lit(None).cast("string")
    return jobs.select("organization_id", F.lit(2 if late else 1).alias("batch_id"), k.alias("row_number"), F.sha2(F.concat_ws("|", "organization_id", "customer_id"), 256).alias("customer_digest"), F.concat(F.lit("Customer "), "customer_id").alias("name"), F.when(k % 5 == 0, F.concat(F.lit("c"), "customer_id", F.lit("@x"))).otherwise(blank).alias("email"), F.col("category_id").alias("label"), "service_date", k.alias("job_id"))


_TWO = f"{v.JOBS_SQL}, b AS (SELECT *, CASE WHEN id % 2 = 1 THEN 2 ELSE 1 END AS batch_id, sha256(concat_ws('|', organization_id, customer_id)) AS digest, CASE WHEN id % 5 = 0 THEN 'c' || customer_id || '@x' END AS email FROM jobs)"


@query(_TWO + " SELECT organization_id, digest, arg_min('Customer ' || customer_id, batch_id * 1000000000 + id) AS name, coalesce(arg_min(email, id) FILTER (batch_id = 1 AND email IS NOT NULL), arg_min(email, id) FILTER (batch_id = 2 AND email IS NOT NULL)) AS email, min(service_date) AS first_seen, max(service_date) AS last_seen, count(*) AS job_count FROM b GROUP BY 1, 2", days=("first_seen", "last_seen"))
def resolved_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot = None
    for late in (False, True):
        rows = _batches(spark, sf_dir, late).withColumnRenamed("customer_digest", "digest")
        snapshot = resolve.resolved(snapshot, rows, ["organization_id", "digest"], ["name", "email"])
        seen = resolve.rollup(rows, ["organization_id", "digest"])
        snapshot = resolve.rolled(snapshot, seen, ["organization_id", "digest"])
    return snapshot.select("organization_id", "digest", "name", "email", "first_seen", "last_seen", "job_count")


@query(_TWO + " SELECT organization_id, category_id AS key, arg_max(category_id || '-' || batch_id || '-' || id, batch_id * 1000000000 + id) AS label FROM b GROUP BY 1, 2")
def resolved_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot = None
    for late in (False, True):
        rows = _batches(spark, sf_dir, late).select("organization_id", F.col("label").alias("key"), "row_number", F.concat_ws("-", "label", "batch_id", "row_number").alias("label"))
        snapshot = resolve.latest(snapshot, rows, ["organization_id", "key"], ["label"])
    return snapshot.select("organization_id", "key", "label")


_PLACES = """'99' || customer_id || ' Main St.' AS line, 1000 + customer_id % 50 AS postal"""


#: The texts that each natural key compares.
_TEXTS = {"location": ("address", "postal"), "equipment": ("address", "postal", "maker", "model", "kind"), "technician": ("code", "worker"), "job": ("summary", "description", "invoice")}


def _keyed(jobs: DataFrame, what: str) -> DataFrame:
    """A batch's rows with one of the natural keys, from texts of any case and spacing.

    The texts are cleaned and folded by one call of each helper for a row, then the key is made of plain columns.
    """
    k, c, e, t = F.col("id"), F.col("customer_id"), F.col("equipment_id"), F.col("technician_id")
    org, src = F.col("organization_id"), F.lit(7)
    shout = lambda x: F.when(k % 3 == 0, F.upper(x)).otherwise(F.concat(F.lit("\t"), x, F.lit("\u00a0 ")))
    texts = {
        "address": shout(F.concat(F.lit("99"), c, F.lit(" Main St."))), "postal": shout((1000 + c % 50).cast("string")), "maker": shout(F.lit("Acme")), "model": shout(F.concat(F.lit("Model "), e)), "kind": shout(F.lit("Boiler")),
        "code": F.when(t % 3 == 1, shout(F.concat(F.lit("code"), t))), "worker": F.when(t.isNotNull(), shout(F.concat(F.lit("Tech, "), t, F.lit(" Ltd.")))), "summary": F.when(k % 3 == 1, shout(F.lit("No  heat"))), "description": shout(F.lit("Noise")), "invoice": F.when(k % 5 == 0, shout(F.concat(F.lit("Inv"), k))),
    }
    used = _TEXTS[what]
    rows = n.clean_texts(jobs.withColumn("customer_digest", identity.digest(org, c)), {f"_{x}": texts[x] for x in used})
    rows = rows.select(*jobs.columns, "customer_digest", n.casefold_all([F.col(f"_{x}") for x in used]).alias("_folds"))
    of = lambda x: F.get("_folds", F.lit(used.index(x))) if x in used else F.lit(None).cast("string")
    place = identity.location(org, src, F.when(c % 4 == 0, F.concat(F.lit("L"), c)), F.col("customer_digest"), of("address"), of("postal"), ready=True)
    worker = identity.technician(org, src, F.when(t % 3 == 0, F.concat(F.lit("T"), t)), of("code"), of("worker"), ready=True)
    task = identity.job(org, src, F.when(k % 3 == 0, F.concat(F.lit("J"), k)), F.col("customer_digest"), F.col("service_date"), of("summary"), of("description"), of("invoice"), ready=True)
    gear = identity.equipment(org, src, F.when(e % 4 == 0, F.concat(F.lit("E"), e)), F.when(e % 4 == 1, shout(F.concat(F.lit("sn-"), e))), F.when(e % 4 == 2, F.col("location.digest")), of("maker"), of("model"), of("kind"), ready=True)
    city = F.when(k % 5 == 0, F.concat(F.lit("City "), c % 9))
    if what == "equipment":  # some are known by their place
        rows = rows.withColumn("location", place)
    key = {"location": place, "equipment": gear, "technician": worker, "job": task}[what]
    return rows.select("organization_id", "customer_digest", k.alias("row_number"), key.alias("key"), city.alias("city"), F.when(k % 7 == 0, F.concat(F.lit("SN"), e)).alias("serial"), F.when(k % 4 == 0, F.concat(F.lit("Tech "), t)).alias("name"))


def _resolved(spark: SparkSession, sf_dir: str, what: str, columns: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """Two batches, one after the other. Keys are written before rows without one are left out: that filter would be
    pushed through all steps otherwise, and these worked out twice."""
    keyed = _keyed(v.jobs(spark, sf_dir), what).select("organization_id", *more, "row_number", "key", *columns)
    rows = staged(keyed).where("key is not null").select("organization_id", *more, "row_number", F.col("key.digest").alias("digest"), F.col("key.strategy").alias("strategy"), *columns)
    snapshot = None
    for late in (0, 1):
        snapshot = resolve.resolved(snapshot, rows.where(F.col("row_number") % 2 == late), ["organization_id", *more, "digest"], ["strategy", *columns])
    return snapshot


_ENTITIES = f"""{v.JOBS_SQL}, b AS (SELECT *, id % 2 AS late, sha256(concat_ws('|', organization_id, customer_id)) AS cd FROM jobs),
l AS (SELECT *, CASE WHEN customer_id % 4 = 0 THEN 'external_id' ELSE 'address' END AS l_way, CASE WHEN customer_id % 4 = 0 THEN sha256(concat_ws('|', organization_id, 7, 'L' || customer_id)) ELSE sha256(concat_ws('|', organization_id, cd, '99' || customer_id || ' main st.', 1000 + customer_id % 50)) END AS l_digest FROM b),
e AS (SELECT *, CASE equipment_id % 4 WHEN 0 THEN 'external_id' WHEN 1 THEN 'serial_number' WHEN 2 THEN 'equipment_attributes' END AS e_way, CASE equipment_id % 4 WHEN 0 THEN sha256(concat_ws('|', organization_id, 7, 'E' || equipment_id)) WHEN 1 THEN sha256(concat_ws('|', organization_id, 'SN-' || equipment_id))
   WHEN 2 THEN sha256(concat_ws('|', organization_id, l_digest, 'acme', 'model ' || equipment_id, 'boiler')) END AS e_digest,
  CASE technician_id % 3 WHEN 0 THEN 'external_id' WHEN 1 THEN 'employee_code' WHEN 2 THEN 'normalized_name' END AS t_way, CASE technician_id % 3 WHEN 0 THEN sha256(concat_ws('|', organization_id, 7, 'T' || technician_id)) WHEN 1 THEN sha256(concat_ws('|', organization_id, 'code' || technician_id)) WHEN 2 THEN sha256(concat_ws('|', organization_id, 'tech ' || technician_id)) END AS t_digest,
  CASE WHEN id % 5 = 0 THEN 'City ' || customer_id % 9 END AS city, CASE WHEN id % 7 = 0 THEN 'SN' || equipment_id END AS serial, CASE WHEN id % 4 = 0 THEN 'Tech ' || technician_id END AS name FROM l)"""
_FIRST = "coalesce(arg_min({0}, id) FILTER (late = 0 AND {0} IS NOT NULL), arg_min({0}, id) FILTER (late = 1 AND {0} IS NOT NULL)) AS {0}"


@query(_ENTITIES + f" SELECT organization_id, cd AS customer_digest, l_digest AS digest, any_value(l_way) AS strategy, {_FIRST.format('city')} FROM e GROUP BY 1, 2, 3")
def resolved_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir, "location", ["city"], ("customer_digest",))


@query(_ENTITIES + f" SELECT organization_id, e_digest AS digest, any_value(e_way) AS strategy, {_FIRST.format('serial')} FROM e WHERE e_digest IS NOT NULL GROUP BY 1, 2")
def resolved_equipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir, "equipment", ["serial"])


@query(_ENTITIES + f" SELECT organization_id, t_digest AS digest, any_value(t_way) AS strategy, {_FIRST.format('name')} FROM e WHERE t_digest IS NOT NULL GROUP BY 1, 2")
def resolved_technicians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir, "technician", ["name"])


@query(_ENTITIES + """ SELECT id, CASE WHEN id % 3 = 0 THEN 'external_id' ELSE 'job_natural_key' END AS strategy, CASE WHEN id % 3 = 0 THEN sha256(concat_ws('|', organization_id, 7, 'J' || id)) ELSE sha256(concat_ws('|', organization_id, cd, service_date::VARCHAR, CASE WHEN id % 3 = 1 THEN 'no heat' ELSE 'noise' END, CASE WHEN id % 5 = 0 THEN 'inv' || id ELSE '' END)) END AS digest FROM e""")
def job_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(v.jobs(spark, sf_dir), "job").select(F.col("row_number").alias("id"), "key.strategy", "key.digest")


@query(f"{v.JOBS_SQL} SELECT organization_id, customer_id, min(service_date) AS first_seen, max(service_date) AS last_seen, count_if(id % 2 = 1)::BIGINT + 5 AS job_count FROM jobs GROUP BY 1, 2 HAVING count_if(id % 2 = 0) > 0", days=("first_seen", "last_seen"))
def customer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a first batch, said to have five jobs each, and what a second batch adds."""
    jobs = v.jobs(spark, sf_dir)
    keys = ["organization_id", "customer_id"]
    known = resolve.rollup(jobs.where("id % 2 = 0"), keys).withColumn("job_count", F.lit(5).cast("long"))
    return resolve.rolled(known, resolve.rollup(jobs.where("id % 2 = 1"), keys), keys)


@query(f"""{v.JOBS_SQL}, k AS (SELECT organization_id, id, id % 1000 AS ext, id % 2 AS late, id % 10 = 1 AS bad FROM jobs), c AS (SELECT organization_id, ext, bool_or(late = 0) AS known FROM k GROUP BY 1, 2)
SELECT id AS row_number, CASE WHEN bad THEN 'error' WHEN ext % 4 = 1 AND known THEN 'warning' WHEN known THEN 'updated' ELSE 'imported' END AS status, CASE WHEN NOT bad THEN sha256(concat_ws('|', organization_id, ext)) END AS job_id, CASE WHEN NOT bad AND ext % 4 = 1 AND known THEN 'POSSIBLE_DUPLICATE' ELSE '' END AS codes FROM k JOIN c USING (organization_id, ext) WHERE late = 1""")
def row_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a second batch; jobs of every fourth id are known by natural keys alone."""
    keys = ["organization_id", "external_id"]
    rows = v.jobs(spark, sf_dir).select("organization_id", (F.col("id") % 1000).alias("external_id"), F.col("id").alias("row_number"), F.when(F.col("id") % 10 == 1, "error").otherwise("pending").alias("status"), n.no_issues().alias("issues"))
    late = rows.where("row_number % 2 = 1")
    jobs = resolve.jobs_upserted(None, rows.where("row_number % 2 = 0").select(*keys, "row_number"), keys, "batch-1").drop("change")
    out = None
    for natural in (False, True):
        part = late.where((F.col("external_id") % 4 == 1) == F.lit(natural))
        after = resolve.jobs_upserted(jobs, part.where("status <> 'error'").select(*keys, "row_number"), keys, "batch-2", by_natural_key=natural)
        done = resolve.row_outcomes(part, after, keys)
        out = done if out is None else out.union(done)
    return out.select("row_number", "status", "job_id", F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"))


@query("SELECT source AS organization_id, count_if(doc_id % 6 IN (0, 1) AND doc_id % 5 > 0)::BIGINT AS active FROM documents GROUP BY 1")
def active_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    status = F.get(F.array(*map(F.lit, ["queued", "processing", "completed", "failed", "uploaded", "validating"])), (k % 6).cast("int"))
    batches = v.table(spark, sf_dir, "documents").select(F.col("source").alias("organization_id"), status.alias("status"), F.when(k % 5 == 0, F.lit("2026-01-01").cast("timestamp")).alias("deleted_at"))
    return validate.active_imports(batches)


@query(f"{v.JOBS_SQL}, k AS (SELECT organization_id, id % 1000 AS ext, id, id % 2 AS late, revenue FROM jobs) SELECT organization_id, ext AS external_id, arg_max(id, late * 1000000000 + id) AS row_number, coalesce(min(CASE WHEN late = 0 THEN 'batch-1' END), 'batch-2') AS first_import_batch_id, CASE WHEN max(late) = 1 THEN CASE WHEN min(late) = 0 THEN 'updated' ELSE 'created' END ELSE 'kept' END AS change FROM k GROUP BY 1, 2")
def jobs_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.jobs(spark, sf_dir).select("organization_id", (F.col("id") % 1000).alias("external_id"), F.col("id").alias("row_number"), "revenue")
    first = resolve.jobs_upserted(None, rows.where("row_number % 2 = 0"), ["organization_id", "external_id"], "batch-1")
    second = resolve.jobs_upserted(first.drop("change"), rows.where("row_number % 2 = 1"), ["organization_id", "external_id"], "batch-2")
    return second.select("organization_id", "external_id", "row_number", "first_import_batch_id", "change")


@query("SELECT source AS organization_id, lang AS job_id, sha256(text) AS content_hash, min(doc_id) AS note_id FROM documents GROUP BY 1, 2, 3")
def job_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.table(spark, sf_dir, "documents").select(F.col("source").alias("organization_id"), F.col("lang").alias("job_id"), F.col("text").alias("body"), F.col("doc_id").alias("note_id"))
    first = resolve.notes(None, docs.where("note_id < 500"))
    return resolve.notes(first, docs.where("note_id >= 500")).select("organization_id", "job_id", "content_hash", "note_id")


@query(f"{v.JOBS_SQL} SELECT id % 20 AS batch_id, min(service_date) AS date_from, max(service_date) AS date_to FROM jobs GROUP BY 1", days=("date_from", "date_to"))
def batch_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.batch_range(v.jobs(spark, sf_dir).withColumn("batch_id", F.col("id") % 20))


@query("SELECT doc_id, list_count(t)::INTEGER AS n_tokens, sha256(array_to_string(list_sort(t), ' ')) AS tokens FROM (SELECT doc_id, list_filter(list_distinct(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')), lambda x: x <> '') AS t FROM documents)")
def search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "documents").select("doc_id", n.search_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.sha2(F.array_join(F.array_sort("t"), " ").cast("binary"), 256).alias("tokens"))


def searched(spark: SparkSession, sf_dir: str, asked: str) -> DataFrame:
    """Documents as jobs of their source, indexed, and then searched."""
    docs = v.table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("organization_id"), F.col("doc_id").alias("id"), F.col("text").alias("description"))
    path = stage_path(spark, "index")
    search.write_index(docs, path, buckets=16)
    return search.search(spark, path, asked, buckets=16).select(F.col("id").alias("doc_id"))


@query("SELECT doc_id FROM documents WHERE list_has_all(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), ['the', 'and', 'of'])")
def job_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(spark, sf_dir, "The, of - AND")


@query("SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' ', ' of the ') AND list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'and')")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(spark, sf_dir, 'and "Of THE"')


@query("SELECT f AS batch_id, CASE WHEN f BETWEEN 6 AND 10 THEN f - 6 ELSE f END AS original, f BETWEEN 6 AND 10 AS duplicate FROM (SELECT DISTINCT o_orderkey % 12 AS f FROM orders)")
def file_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve files are written, five are copies of others, one differs by a letter; they are known by their bytes."""
    k = F.col("o_orderkey")
    files = v.table(spark, sf_dir, "orders").select(F.explode(F.array(k % 6, k % 6 + 6)).alias("f"), k.alias("k"), "o_orderpriority", "o_totalprice")
    lines = files.select("f", "k", F.concat_ws(",", "k", F.concat(F.lit('"'), "o_orderpriority", F.lit('"')), "o_totalprice", F.when(F.col("f") == 11, "x").otherwise("y")).alias("value"))
    path = stage_path(spark, "files")
    lines.repartition("f").sortWithinPartitions("f", "k").select("f", "value").write.partitionBy("f").text(path)
    found = file_digests(spark, f"{path}/f=*/*").withColumn("batch_id", F.regexp_extract("file", "f=([0-9]+)", 1).cast("long"))
    batches = found.select((F.col("batch_id") % 2).alias("organization_id"), "batch_id", F.col("digest").alias("file_sha256"), F.col("batch_id").alias("created_at"))
    return validate.file_duplicates(batches).select("batch_id", "original", "duplicate")


_CHAIN = validate.Mapping(fields={"external_job_id": "Job ID", "customer_name": "Customer", "customer_external_id": "Customer ID", "service_date": "Date", "job_status": "Status", "revenue_amount": "Revenue", "equipment_serial": "Serial"}, skip=(validate.Skip("Status", "equals", "estimate"),), status_map={"Closed": "completed"})


def exported(spark: SparkSession, jobs: DataFrame, earlier: bool) -> DataFrame:
    """Jobs as six files, even ones with days first, odd ones with months first, read as raw rows; a row in seventeen comes twice."""
    k, head = F.col("id"), ["Job ID", "Customer", "Customer ID", "Date", "Status", "Revenue", "Serial"]
    jobs = jobs.where(k % 4 == 0) if earlier else jobs
    jobs = jobs.withColumn("copy", F.explode(F.when(k % 17 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    day = F.when(k % 19 == 0, "soon").when(k % 6 % 2 == 0, F.date_format("service_date", "d/M/yyyy")).otherwise(F.date_format("service_date", "M/d/yyyy"))
    cells = [F.when(k % 5 != 0, F.concat(F.lit("J"), k)), F.concat(F.lit('"Customer, '), "customer_id", F.lit('"')), F.col("customer_id"), day, F.when(k % 10 == 3, "ESTIMATE").otherwise("Closed"), F.col("revenue"), F.concat(F.lit("sn-"), "equipment_id")]
    line = F.concat_ws(",", *(F.coalesce(c.cast("string"), F.lit("")) for c in cells))
    lines = jobs.select((k % 6).alias("batch"), k.alias("k"), "copy", line.alias("value"))
    heads = spark.range(6).select(F.col("id").alias("batch"), F.lit(-1).cast("long"), F.lit(0), F.lit(",".join(head)))
    path = stage_path(spark, "export")
    lines.union(heads).repartition("batch").sortWithinPartitions("batch", "k", "copy").select("batch", "value").write.partitionBy("batch").text(path)
    rows = delimited.read_rows(spark, f"{path}/batch=*/*", head)
    return rows.select(F.lit(1).alias("organization_id"), F.regexp_extract("file", "batch=([0-9]+)", 1).cast("long").alias("batch_id"), "row_number", "raw", "issues")


def chained(spark: SparkSession, sf_dir: str) -> ingest.Import:
    jobs = staged(v.jobs(spark, sf_dir).select("id", "customer_id", "service_date", "revenue", "equipment_id"))
    first = ingest.run_import(exported(spark, jobs, True), _CHAIN, "first", "2026-01-01")
    return ingest.run_import(exported(spark, jobs, False), _CHAIN, "second", "2026-01-01", first.jobs, first.entities)


#: Rows without an id are known by customer, day and texts, so that of several on one day the last one counts.
_CHAINED = v.JOBS_SQL + """, e AS (SELECT *, id % 6 AS batch_id, id % 10 = 3 AS skipped, id % 19 = 0 AS bad, CASE WHEN id % 5 <> 0 THEN 'J' || id ELSE 'n' || customer_id || '|' || service_date::VARCHAR END AS key FROM jobs),
o AS (SELECT DISTINCT key FROM e WHERE id % 4 = 0 AND NOT skipped AND NOT bad), s AS (SELECT e.*, CASE WHEN skipped THEN 'skipped' WHEN bad THEN 'error' WHEN o.key IS NULL THEN 'created' WHEN id % 5 = 0 THEN 'warning' ELSE 'updated' END AS outcome FROM e LEFT JOIN o USING (key))"""


@query(_CHAINED + """ SELECT batch_id, (count(*) + count_if(id % 17 = 0))::BIGINT AS total, count_if(outcome = 'error')::BIGINT AS errors, count_if(outcome = 'warning')::BIGINT AS warnings, (count_if(outcome = 'skipped') + count_if(id % 17 = 0))::BIGINT AS skipped, count_if(outcome = 'created')::BIGINT AS created, count_if(outcome = 'updated')::BIGINT AS updated,
 (count(*) - count_if(outcome IN ('error', 'skipped')))::BIGINT AS importable, CASE WHEN count_if(outcome = 'error') > 0 THEN 'completed_with_errors' ELSE 'completed' END AS batch_status FROM s GROUP BY 1""")
def import_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two imports, the second of all jobs after one of a quarter of them: counters of its batches."""
    return chained(spark, sf_dir).counters


@query(_CHAINED + """, j AS (SELECT key, arg_max(id, batch_id * 1000000000 + id) AS id FROM s WHERE outcome NOT IN ('error', 'skipped') GROUP BY key) SELECT j.id % 6 AS batch_id, jobs.service_date::VARCHAR AS service_date, customer_id::VARCHAR AS customer_external_id, 'Customer, ' || customer_id AS customer_name, revenue::DOUBLE AS revenue, CASE WHEN o.key IS NULL THEN 'second' ELSE 'first' END AS first_import_batch_id, count(*) AS n
 FROM j JOIN jobs USING (id) LEFT JOIN o USING (key) GROUP BY ALL""")
def import_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job table after both imports."""
    jobs = chained(spark, sf_dir).jobs
    r = F.col("record")
    return jobs.groupBy("batch_id", r["service_date"].cast("string").alias("service_date"), r["customer_external_id"].alias("customer_external_id"), r["customer_name"].alias("customer_name"), r["revenue_amount"].cast("double").alias("revenue"), "first_import_batch_id").agg(F.count("*").alias("n"))
