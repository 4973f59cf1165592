"""What an import moves: raw rows once, records once, neither for a vote nor for a duplicate."""

import re

import pytest
from pyspark.sql import functions as F

from revisit_spark.operators import validate
from revisit_spark.plans import ingest

MAPPING = validate.Mapping({"external_job_id": "Job", "service_date": "Day", "customer_name": "Who"})
COLUMNS = "organization_id int, batch_id string, row_number int, raw map<string,string>"


@pytest.fixture
def large(spark):
    """As for tables of which none is small enough to be sent to all tasks unasked."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, -1)
    yield spark
    spark.conf.unset(key)


def cells(job, day="13/01/2025", who="Ann"):
    return {"Job": job, "Day": day, "Who": who}


def made(spark):
    each = [cells("J1"), cells("J2"), cells("J1"), cells("J1"), cells("", "14/01/2025", "Bob"), cells("", "14/01/2025", "Bob"), cells("J1", "soon"), cells("J1", "soon")]
    return spark.createDataFrame([(1, b, i, c) for b in ("a", "b") for i, c in enumerate(each)], COLUMNS)


def test_rows_move_once_before_they_are_judged(large):
    rows = made(large).repartition(2)
    plan = validate.with_date_orders(rows, "Day")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    judged = validate.validated(validate.with_firsts(rows), MAPPING, "2026-06-01", "dmy")
    plan = validate.duplicates_marked(judged)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Join", plan)
    told = lambda d: {(r.batch_id, r.row_number): (r.status, [i.code for i in r.issues]) for r in d.collect()}
    got = told(validate.duplicates_marked(judged))
    assert got == told(validate.duplicates_marked(judged.drop("_first")))
    assert [got[("b", i)][0] == "skipped_duplicate" for i in range(8)] == [False, False, True, True, False, True, False, True]


def test_chain_keeps_digests_as_text(large):
    first = ingest.run_import(made(large).where("batch_id = 'a'"), MAPPING, "first", "2026-06-01")
    second = ingest.run_import(made(large).where("batch_id = 'b'"), MAPPING, "second", "2026-06-01", first.jobs, first.entities)
    jobs = second.jobs.collect()
    assert len(jobs) == 3 and all(re.fullmatch("[0-9a-f]{64}", j.digest) and j.record.job_key.digest == j.digest and re.fullmatch("[0-9a-f]{64}", j.record.customer_key.digest) and j.record.technician_key is None for j in jobs)
    assert {(j.first_import_batch_id, j.last_import_batch_id) for j in jobs} == {("first", "second")}
    got = [r.status for r in second.rows.orderBy("row_number").collect()]
    assert got == ["updated", "updated", "skipped_duplicate", "skipped_duplicate", "warning", "skipped_duplicate", "error", "skipped_duplicate"]
    ids = {r.job_id for r in second.rows.where("job_id is not null").collect()}
    assert ids == {r[0] for r in second.jobs.select(F.sha2(F.concat_ws("|", "organization_id", "digest"), 256)).collect()}
