from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from revisit_spark.functions import identity
from revisit_spark.functions import normalize as n
from revisit_spark.operators import profile, resolve, transforms, validate
from revisit_spark.plans import import_queries
from revisit_spark.sources import delimited, files
from revisit_spark.sources.tables import staged

BLANKS = ["\t{}\t", " {} ", " {}\r", "\r\n{} ", "{}\x1c"]


def test_blanks_of_any_kind_are_stripped(spark):
    made = {"yes": lambda c: n.boolean(c), "2024-01-02": lambda c: n.date(c, "2026-01-01"), "n/a": n.money, "12": n.integer, "2024-01-02T09:30": lambda c: n.moment(c, "UTC")}
    for value, f in made.items():
        rows = spark.createDataFrame([(value,)] + [(b.format(value),) for b in BLANKS], "x string").select(f(F.col("x")).alias("r")).collect()
        assert all(r.r.value == rows[0].r.value and not r.r.issues for r in rows), value


def write(path, name, content, encoding="utf-8"):
    (path / name).write_bytes(content.encode(encoding))
    return f"file://{path}/{name}"


def rows_of(df):
    return [(r.row_number, r.raw, [i.code for i in r.issues]) for r in df.orderBy("file", "row_number").collect()]


TEXT = 'a,b\n1,"x, ""y"""\n2\n\n3,z,' + ",".join(f"e{i}" for i in range(11)) + "\n,\n"


def test_ragged_rows_keep_every_cell(spark, tmp_path):
    expect = [(2, {"a": "1", "b": 'x, "y"'}, []), (3, {"a": "2", "b": ""}, ["TOO_FEW_COLUMNS"]), (4, {"a": "", "b": ""}, ["TOO_FEW_COLUMNS"]), (5, {"a": "3", "b": "z"} | {f"__extra_{i + 1}": f"e{i}" for i in range(11)}, ["TOO_MANY_COLUMNS"]), (6, {"a": "", "b": ""}, [])]
    path = write(tmp_path, "plain.csv", TEXT)
    assert rows_of(delimited.read_rows(spark, path, ["a", "b"])) == expect
    assert rows_of(delimited.read_rows(spark, path, ["a", "b"], multi_line=True)) == expect
    wide = write(tmp_path, "wide.tsv", "﻿" + TEXT.replace('"x, ""y"""', "x").replace(",", "\t"), "utf-16-le")
    got = rows_of(delimited.read_rows(spark, wide, ["a", "b"], separator="\t", encoding="utf-16-le"))
    assert [g[0] for g in got] == [2, 3, 4, 5, 6] and got[0][1] == {"a": "1", "b": "x"}
    lines = write(tmp_path, "lines.csv", 'a,b\n1,"x\ny"\n2,z\n')
    assert rows_of(delimited.read_rows(spark, lines, ["a", "b"], multi_line=True)) == [(2, {"a": "1", "b": "x\ny"}, []), (3, {"a": "2", "b": "z"}, [])]
    broken = tmp_path / "broken.csv"
    broken.write_bytes(b"a,b\n1,\xff\n")
    (row,) = delimited.read_rows(spark, f"file://{broken}", ["a", "b"]).collect()
    assert row.raw["b"] == "�"


def test_quoted_line_ends_by_many_tasks(spark, tmp_path):
    """Rows of any number of lines, cut anywhere by the blocks, equal those of the standard library's reader."""
    import csv
    import random

    r = random.Random(6)
    cell = lambda: r.choice(["", "x", "1", "y z", 'a ""b"" c', "l1\nl2", "\n", "l\r\nm", ",", 'say ""hi""\n\nbye', "é" * r.randint(1, 9)])
    for name, n in (("a.csv", 400), ("b.csv", 3), ("c.csv", 150)):
        lines = ["h1,h2\n"]
        for _ in range(n):
            made = [cell() for _ in range(r.randint(1, 4))]
            lines.append(",".join(f'"{c}"' if r.random() < 0.3 or any(x in c for x in '",\n\r') else c for c in made) + r.choice(["\n", "\r\n"]))
            if r.random() < 0.05:
                lines.append(r.choice(["\n", 'in 5" pipe,z\n', 'x,"never" closed well\n']))
        lines.append('x,"never ""closed\nhere' if name == "c.csv" else "")
        write(tmp_path, name, "".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    for size in ("97", "300", "100000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            found = delimited._from_quoted_lines(spark, f"file://{tmp_path}/*.csv", ",")
            got = {}
            for x in found.collect():
                got.setdefault(x.file.rsplit("/", 1)[1], {})[x.at] = x.cells
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
            spark.conf.set("spark.sql.files.openCostInBytes", before[1])
        for name in ("a.csv", "b.csv", "c.csv"):
            with open(tmp_path / name, newline="", encoding="utf-8") as f:
                assert [got[name][k] for k in sorted(got[name])] == list(csv.reader(f)), (name, size)


def test_digests_don_t_depend_on_cuts(spark, tmp_path):
    made = {"a": b"x\ny\r\n" * 400, "b": b"x\ny\r\n" * 400, "c": b"x\ny\r\n" * 400 + b"x", "d": b"x\ny\r\n" * 399 + b"y\nx\r\n", "e": b"\xff\x00\n" * 500, "f": b"", "g": b"\n", "h": b""}
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    before, seen = {k: spark.conf.get(f"spark.sql.files.{k}") for k in ("maxPartitionBytes", "openCostInBytes")}, []
    for size in ("133", "1000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            seen.append({r.file.rsplit("/", 1)[1]: (r["size"], r.digest) for r in files.file_digests(spark, f"file://{tmp_path}/*").collect()})
        finally:
            for k, x in before.items():
                spark.conf.set(f"spark.sql.files.{k}", x)
    assert seen[0] == seen[1] and seen[0]["a"] == seen[0]["b"] and seen[0]["f"] == seen[0]["h"] and len({x for _, x in seen[0].values()}) == 6
    assert {k: x[0] for k, x in seen[0].items()} == {k: len(x) for k, x in made.items()}


def test_numbers_start_anew_in_each_file(spark, tmp_path):
    for k in range(3):
        write(tmp_path, f"part{k}.csv", "a\n" + "".join(f"{k}-{i}\n" for i in range(5)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8")
    try:
        got = delimited.read_rows(spark, f"file://{tmp_path}/*.csv", ["a"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.raw["a"], r.row_number) for r in got) == [(f"{k}-{i}", i + 2) for k in range(3) for i in range(5)]


def test_report_has_a_header_and_messages(spark, tmp_path):
    issues = spark.createDataFrame([("b", 4, "error")], "batch_id string, row_number int, status string").withColumn("issues", F.array(n.issue("INVALID_DATE", "error", "service_date", F.lit("=soon"))))
    delimited.write_report(validate.issue_report(issues), f"file://{tmp_path}/report")
    got = "".join(open(p, newline="").read() for p in sorted(map(str, (tmp_path / "report").glob("part-*"))))
    assert got == "row_number,status,error_code,field,message,raw_value\r\n" + f'"4","error","INVALID_DATE","service_date","{n.MESSAGES["INVALID_DATE"]}","\'=soon"\r\n'


MAPPING = validate.Mapping(fields={"external_job_id": "ID", "customer_name": "Who", "service_date": "Day", "revenue_amount": "Paid", "job_status": "State", "is_warranty": "W"}, retain=("Zone",), skip=(validate.Skip("State", "contains", "draft"),), status_map={"Done": "completed"})


def outcome(spark, raw, mapping=MAPPING):
    d = spark.createDataFrame([(1, "b", 2, raw)], "organization_id int, batch_id string, row_number int, raw map<string,string>")
    r = validate.validated(d, mapping, "2026-06-01").first()
    return r.status, [i.code for i in r.issues], r.record


def test_validated_rows(spark):
    fine = {"ID": "7", "Who": "  Ann  Lee ", "Day": "\t2026-01-05", "Paid": "$1,200.50", "State": "Done", "W": "Warranty", "Zone": "a​  b"}
    status, codes, record = outcome(spark, fine)
    assert (status, codes) == ("pending", ["EQUIPMENT_NOT_RESOLVED"])
    assert (record.customer_name, record.service_date, record.revenue_amount, record.job_status, record.is_warranty, record.extra_fields) == ("Ann Lee", date(2026, 1, 5), Decimal("1200.50"), "completed", True, {"Zone": "a b"})
    assert record.customer_key.strategy == "name_only" and record.job_key.strategy == "external_id"
    assert outcome(spark, fine | {"Day": "nope"})[:2] == ("error", ["INVALID_DATE", "EQUIPMENT_NOT_RESOLVED"]) and outcome(spark, fine | {"Day": "nope"})[2] is None
    assert outcome(spark, fine | {"Who": " "})[0] == "error"
    assert outcome(spark, fine | {"State": "My DRAFT"})[:2] == ("skipped_filtered", ["ROW_SKIPPED_BY_FILTER"])
    assert outcome(spark, fine | {"State": "odd", "W": "maybe", "Zone": "x�"})[:2] == ("warning", ["ENCODING_REPLACEMENT", "UNKNOWN_ENUM_VALUE", "UNKNOWN_ENUM_VALUE", "EQUIPMENT_NOT_RESOLVED"])
    assert outcome(spark, fine | {"Who": "Zoë " + "é" * 20_000})[1][0] == "FIELD_TOO_LONG"


@pytest.mark.parametrize("change", [{"fields": {"customer_name": "Who"}}, {"fields": {"service_date": "Day"}}, {"fields": {"service_date": "Day", "customer_name": "Who", "no_such": "x"}}, {"decimal": ",", "thousands": ","}, {"skip": (validate.Skip("State", "equals"),)}, {"skip": (validate.Skip("State", "like", "x"),)}])
def test_mappings_are_checked(change):
    with pytest.raises(ValueError):
        validate.Mapping(**({"fields": MAPPING.fields} | change)).checked()
    with pytest.raises(ValueError):
        MAPPING.checked(["ID", "Who"])


def test_records_survive_json(spark):
    d = spark.createDataFrame([(1, "b", 2, {"ID": "7", "Who": "Ann", "Day": "2026-01-05", "Paid": "0", "State": None, "W": "x", "Zone": "q"})], "organization_id int, batch_id string, row_number int, raw map<string,string>")
    rows = validate.validated(d, MAPPING, "2026-06-01")
    back = rows.select("record", validate.record_from_json(validate.record_json(F.col("record")), rows.schema["record"].dataType.simpleString()).alias("back")).first()
    assert back.record == back.back and back.record.is_no_charge


@pytest.mark.parametrize("values,kind", [(["warranty", " NO\t"], "boolean"), (["1", "0"], "boolean"), (["+1", "20"], "integer"), (["2024-1-5T9:30", "2024-01-05 10:00:00"], "datetime"), (["2024-1-5", "1/2/24"], "date"), (["¥ 5", "-$1,2.3", "(5)"], "money"), (["1 Jan 2024"], "text"), (["", " "], "text")])
def test_column_types(spark, values, kind):
    cells = spark.createDataFrame([("f", i, 1, "c", x) for i, x in enumerate(values)], "file string, row_number int, ordinal int, name string, value string")
    assert profile.column_types(cells).first().type == kind


def test_suggestions(spark):
    heads = [("equipment_manufacturer", "text"), ("external_job_id", "text"), ("Job ID", "text"), ("Start Time", "datetime"), ("Warrantie", "integer"), ("Customr", "text"), ("Zip", "text")]
    d = spark.createDataFrame([("f", i, h, t) for i, (h, t) in enumerate(heads)], "file string, ordinal int, header string, type string")
    got = {r.header: (r.target, round(r.confidence, 4)) for r in profile.suggestions(d).collect()}
    assert got == {"equipment_manufacturer": ("equipment_manufacturer", 1.0), "external_job_id": ("external_job_id", 1.0), "Start Time": ("started_at", 1.0), "Customr": ("customer_name", round(14 / 15, 4)), "Zip": ("postal_code", 1.0)}


def test_keys_ignore_case_and_blanks(spark):
    d = spark.createDataFrame([("Straße 5 ", "ab-1\t"), ("STRASSE  5", "AB-1")], "line string, code string")
    place = identity.location(F.lit(1), F.lit(2), F.lit(None).cast("string"), F.lit("d"), F.col("line"), F.lit("1000"))
    gear = identity.equipment(F.lit(1), F.lit(2), F.lit(""), F.col("code"), F.lit(None).cast("string"), *[F.lit(None).cast("string")] * 3)
    rows = d.select(place["digest"].alias("p"), gear["digest"].alias("g")).collect()
    assert rows[0] == rows[1]


def test_outcomes_carry_jobs(spark):
    rows = spark.createDataFrame([(1, "a", 1, "pending"), (1, "b", 2, "warning"), (1, "c", 3, "error")], "organization_id int, k string, row_number int, status string")
    old = resolve.jobs_upserted(None, rows.where("k = 'a'").select("organization_id", "k", "row_number"), ["organization_id", "k"], "b1").drop("change")
    jobs = resolve.jobs_upserted(old, rows.where("k <> 'c'").select("organization_id", "k", "row_number"), ["organization_id", "k"], "b2")
    got = {r.k: (r.status, r.job_id is not None) for r in resolve.row_outcomes(rows, jobs, ["organization_id", "k"]).collect()}
    assert got == {"a": ("updated", True), "b": ("imported", True), "c": ("error", False)}


def test_transforms_of_single_fields(spark):
    """Settings of another type's transform don't count; a transform of one's own does."""
    fields = {"service_date": "Day", "customer_name": "Who", "started_at": "Start", "revenue_amount": "Paid", "labor_amount": "Work", "is_warranty": "W"}
    raw = {"Day": "18_09_2025", "Who": "Ann", "Start": "18.9.2025 09:30", "Paid": "1.200,5", "Work": "1.200,50", "W": "Oui"}
    how = {"service_date": transforms.When("%d_%m_%Y"), "started_at": transforms.When("%d.%m.%Y %H:%M", "Asia/Manila"), "revenue_amount": transforms.Amount(",", "."), "labor_amount": transforms.Flag(("x",)), "is_warranty": transforms.Flag((" OUI ",))}
    status, codes, r = outcome(spark, raw, validate.Mapping(fields, transforms=how))
    assert (r.service_date, r.started_at, r.revenue_amount, r.labor_amount, r.is_warranty) == (date(2025, 9, 18), datetime(2025, 9, 18, 1, 30), Decimal("1200.50"), Decimal("1200.50"), True)

    @dataclass(frozen=True)
    class Cents:
        per: int = 100

    transforms.register("cents", ("money",), Cents, lambda raw, how, given, t: n.Steps(n.stripped(raw), lambda v: n.result((v.try_cast("decimal(14,2)") / how.per).cast("decimal(14,2)"))))
    document = {"version": 1, "fields": {t: {"source_column": c} for t, c in fields.items()}}
    document["fields"]["revenue_amount"]["transform"] = {"type": "cents", "per": 1000}
    assert outcome(spark, raw | {"Day": "2025-09-18", "Start": "", "Paid": "12500"}, validate.Mapping.from_document(document))[2].revenue_amount == Decimal("12.50")


@pytest.mark.parametrize("change", [{"version": 2}, {"more": 1}, {"fields": {"service_date": {"source_column": "Day", "transform": {"type": "no"}}}}, {"fields": {"service_date": {"source_column": "Day", "transform": {"type": "date", "zone": "x"}}}}, {"fields": {"service_date": {"source_column": ""}}}, {"fields": {"revenue_amount": {"source_column": "a", "transform": {"type": "money", "decimal_separator": ",", "thousands_separator": ","}}}}])
def test_documents_are_checked(change):
    fine = {"version": 1, "fields": {"service_date": {"source_column": "Day"}, "customer_name": {"source_column": "Who"}}}
    assert validate.Mapping.from_document(fine).fields["service_date"] == "Day"
    with pytest.raises(ValueError):
        validate.Mapping.from_document(fine | change | {"fields": fine["fields"] | change.get("fields", {})})


def test_votes_of_batches(spark):
    d = spark.createDataFrame([(1, b, i, {"Day": x, "Who": "Ann"}) for b, days in (("a", ["13/01/2025", "02/03/2025"]), ("b", ["01/13/2025", "02/03/2025"]), ("c", ["02/03/2025", ""])) for i, x in enumerate(days)], "organization_id int, batch_id string, row_number int, raw map<string,string>")
    rows = validate.with_date_orders(d, "Day")
    got = {(r.batch_id, r.row_number): (r.record and r.record.service_date, r.issues[0].code) for r in validate.validated(rows, validate.Mapping({"service_date": "Day", "customer_name": "Who"}), "2026-06-01", F.col("date_order")).collect()}
    assert got[("a", 1)][0] == date(2025, 3, 2) and got[("b", 1)][0] == date(2025, 2, 3) and got[("c", 0)] == (None, "AMBIGUOUS_DATE_FORMAT")


@pytest.mark.parametrize("what,helpers", [("technician", 2), ("equipment", 2), ("location", 2)])
def test_keys_call_each_helper_once(spark, what, helpers):
    """A key's texts go to Python once to be composed and once to be folded."""
    from revisit_spark.plans import import_queries, testviews

    plan = import_queries._keyed(testviews.jobs(spark, "/root/testdata/sf0.001"), what).select("row_number", "key")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == helpers


def test_an_import_writes_its_judged_rows_once(spark, monkeypatch):
    from revisit_spark.operators import validate as operator
    from revisit_spark.plans import import_queries, ingest

    written = []
    keep = lambda df: written.append(df) or staged(df)
    monkeypatch.setattr(operator, "staged", keep)
    monkeypatch.setattr(ingest, "staged", keep)
    raw = F.create_map(F.lit("Job ID"), F.lit("J1"), F.lit("Customer ID"), F.lit("c"), F.lit("Date"), F.lit("2026-01-02"))
    rows = spark.range(2, numPartitions=1).select(F.lit(1).alias("organization_id"), F.lit(1).alias("batch_id"), F.col("id").alias("row_number"), raw.alias("raw"))
    mapping = validate.Mapping(fields={"external_job_id": "Job ID", "customer_external_id": "Customer ID", "service_date": "Date"})
    told = ingest.run_import(rows, mapping, "a", "2026-06-01").rows
    assert sorted((r.row_number, r.status) for r in told.collect()) == [(0, "imported"), (1, "skipped_duplicate")]
    assert sum("row_hash" in df.columns for df in written) == 1
    monkeypatch.setattr(validate, "validated", lambda rows, *a, **k: written.append(rows) or rows.withColumn("issues", F.array(F.lit(1))))
    import_queries.issue_page(spark, "/root/testdata/sf0.001")
    assert [r.batch_id for r in written[-1].select("batch_id").distinct().collect()] == [3]


def test_report_and_records_write_only_what_they_tell(spark, monkeypatch):
    written = []

    def noted(df):
        written.append(df.columns)
        return staged(df)

    monkeypatch.setattr(import_queries, "staged", noted)
    lines = import_queries.report_lines(spark, "/root/testdata/sf0.001")
    assert written == [["batch_id", "row_number", "status", "issues"]] and lines.count() > 1
    back = import_queries.record_round_trip(spark, "/root/testdata/sf0.001")
    assert written[1:] == [["batch_id", "row_number", "payload"]] and back.where("same").count() == back.count() > 0


def test_helpers_of_lists_get_no_nulls(spark):
    """Thousands of null lists in a batch are measured again with each row: rows without work are empty lists."""
    rows = spark.createDataFrame([(i, ["Straße", None, "B"][i % 3], "Ⅷ" if i == 4 else "Cd") for i in range(9)], "i int, a string, b string")
    sent = rows.select(n._only(F.col("b") == "Ⅷ", F.array("a", "b")).alias("x"))
    assert [r.x for r in sent.collect()] == [[] if i != 4 else [None, "Ⅷ"] for i in range(9)]
    folded = rows.select(n.casefold_all([F.col("a"), F.col("b")]).alias("x"))
    assert [r.x for r in folded.collect()] == [[["strasse", None, "b"][i % 3], "ⅷ" if i == 4 else "cd"] for i in range(9)]
    clean = n.clean_texts(rows, {"x": F.concat("a", F.lit("é "))}).orderBy("i")
    assert [r.x for r in clean.collect()] == [["Straßeé", None, "Bé"][i % 3] for i in range(9)]
