from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from revisit_spark.functions import normalize as n
from revisit_spark.operators import pairs
from revisit_spark.sources import parts
from revisit_spark.streaming.incremental import Seen, Snapshots, first_rows, on_arrival

SCHEMA = "organization_id long, id long, customer_id long, location_id long, equipment_id long, technician_id long, category_id string, service_date date, started_at timestamp, status string, revenue decimal(14,2), is_warranty boolean, raw_category string, raw_job_type string, arrived_at timestamp"
START = date(2025, 1, 1)


def job(i, day, customer, equipment=None, status="completed", at=0, org=1):
    return (org, i, customer, None, equipment, None, "c", START + timedelta(days=day), None, status, None, False, "c", None, datetime(2026, 2, 1) + timedelta(hours=at))


def files(root, table):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in Path(root, table).rglob("*.parquet")}


def open_pairs(store, spark):
    return {(r.prior_id, r.followup_id) for r in store.candidates(spark).where("not suppressed").collect()}


def batch_pairs(spark, rows):
    return {(r.prior_id, r.followup_id) for r in pairs.candidate_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_stream_equals_batch(spark, tmp_path):
    """Three files of jobs; the last one changes jobs of the first."""
    first = [job(i, 7 * (i % 40), i % 5, i % 7) for i in range(60)]
    second = [job(100 + i, 5 * i, i % 5, status="cancelled" if i % 6 == 0 else "unknown", at=1) for i in range(40)]
    third = [job(i, 7 * (i % 40) + 45, (i + 1) % 5, i % 7, at=2) for i in range(0, 60, 9)] + [job(300, 3, 2, at=2)]
    source = f"file://{tmp_path}/in"
    for part in (first, second, third):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    store = Snapshots(f"file://{tmp_path}/store", buckets=2)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    on_arrival(stream, store, f"file://{tmp_path}/ck").start().awaitTermination(300)
    last = {}
    for r in [*first, *second, *third]:
        last[r[:2]] = r
    assert open_pairs(store, spark) == batch_pairs(spark, list(last.values())) and store.jobs(spark, spark.read.parquet(f"file://{tmp_path}/store/jobs").schema).count() == len(last)
    gone = store.candidates(spark).where("suppressed").collect()
    assert gone and {r.suppressed_reason for r in gone} == {"out_of_window"}


def test_only_touched_partitions_are_replaced(spark, tmp_path):
    store, root = Snapshots(f"file://{tmp_path}/store", buckets=2), f"{tmp_path}/store"
    rows = [job(i, 3 * i, i % 4) for i in range(240)]  # two years
    store.arrive(spark.createDataFrame(rows, SCHEMA), 0)
    before = {t: files(root, t) for t in ("jobs", "candidates")}
    late = [job(1000, 200, 1, at=1)]
    written = store.arrive(spark.createDataFrame(late, SCHEMA), 1)
    after = {t: files(root, t) for t in ("jobs", "candidates")}
    assert len(written["jobs"]) == 1 and len(before["jobs"]) > 40
    assert len(written["candidates"]) <= 4
    for table, homes in written.items():
        changed = {f for f in before[table].keys() | after[table].keys() if before[table].get(f) != after[table].get(f)}
        assert changed and {tuple(f.split("/")[1:3]) for f in changed} <= {(f"month={m}", f"bucket={b}") for m, b in homes}
    assert open_pairs(store, spark) == batch_pairs(spark, rows + late)
    again = {t: spark.read.parquet(f"file://{root}/{t}").count() for t in ("jobs", "candidates", "scores")}
    store.arrive(spark.createDataFrame(late, SCHEMA), 1)  # the same micro-batch once more
    assert {t: spark.read.parquet(f"file://{root}/{t}").count() for t in again} == again
    assert {r.first_import_batch_id for r in spark.read.parquet(f"file://{root}/jobs").where("id = 1000").collect()} == {"batch-1"}


def test_jobs_move(spark, tmp_path):
    """A job that moves to another month, is cancelled there and comes back leaves nothing behind."""
    store = Snapshots(f"file://{tmp_path}/store", buckets=2)
    state = {1: job(1, 0, 1), 2: job(2, 5, 1), 3: job(3, 100, 1), 4: job(4, 104, 1)}
    store.arrive(spark.createDataFrame(list(state.values()), SCHEMA), 0)
    ids = {(r.prior_id, r.followup_id): r.candidate_id for r in store.candidates(spark).collect()}
    for number, change in enumerate((job(1, 99, 1, at=1), job(1, 99, 1, status="cancelled", at=2), job(1, 1, 1, at=3)), 1):
        state[1] = change
        store.arrive(spark.createDataFrame([change], SCHEMA), number)
        assert store.candidates(spark).groupBy("prior_id", "followup_id").count().where("count > 1").count() == 0
        if change[9] == "completed":
            assert open_pairs(store, spark) == batch_pairs(spark, list(state.values()))
        assert spark.read.parquet(f"file://{tmp_path}/store/jobs").count() == 4
    assert {(r.prior_id, r.followup_id): r.candidate_id for r in store.candidates(spark).where("prior_id = 1 and followup_id = 2").collect()} == {(1, 2): ids[1, 2]}


def test_first_arrival_stays(spark, tmp_path):
    rows = [("b", {"x": str(i % 5)}, datetime(2026, 1, 1)) for i in range(20)]
    source = f"file://{tmp_path}/in"
    spark.createDataFrame(rows, "batch_id string, raw map<string,string>, arrived_at timestamp").write.parquet(source)
    stream = first_rows(spark.readStream.schema("batch_id string, raw map<string,string>, arrived_at timestamp").parquet(source))
    stream.writeStream.format("memory").queryName("first_rows").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("first_rows").count() == 5


def test_duplicates_are_known_until_their_batch_ends(spark, tmp_path):
    """30 days between parts of a batch: the stored hashes know the row, and forget it when the batch has ended."""
    seen = Seen(f"file://{tmp_path}/seen")

    def part(number, rows):
        d = spark.createDataFrame([(b, i, {"x": x}, "pending", datetime(2026, 1, 1) + timedelta(days=30 * number)) for b, i, x in rows], "batch_id string, row_number int, raw map<string,string>, status string, arrived_at timestamp").withColumn("issues", n.no_issues())
        return {(r.batch_id, r.row_number): (r.status, [i.code for i in r.issues]) for r in seen.marked(d, number).collect()}

    again = ("skipped_duplicate", ["DUPLICATE_ROW_IN_FILE"])
    assert part(0, [("a", 2, "x"), ("a", 3, "y"), ("a", 4, "x"), ("b", 2, "x")]) == {("a", 2): ("pending", []), ("a", 3): ("pending", []), ("a", 4): again, ("b", 2): ("pending", [])}
    late = [("a", 5, "x"), ("a", 6, "z"), ("b", 3, "y")]
    expect = {("a", 5): again, ("a", 6): ("pending", []), ("b", 3): ("pending", [])}
    assert part(1, late) == expect and part(1, late) == expect
    seen.ended(spark, "a")
    assert part(2, [("a", 7, "x"), ("b", 4, "x")]) == {("a", 7): ("pending", []), ("b", 4): again}


def test_partitions_are_replaced_from_themselves(spark, tmp_path):
    """Rows are written once and nowhere else; an emptied partition goes; a row of a partition that wasn't read changes nothing."""
    path, homes = f"file://{tmp_path}/t", [("a", 0), ("b", 0)]
    rows = spark.createDataFrame([(i, "ab"[i % 2], 0) for i in range(6)], "x int, month string, bucket int")
    stages = lambda: len(list(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).iterdir()))
    before, kept = stages(), lambda: sorted(r.x for r in spark.read.schema(rows.schema).parquet(path).collect())
    parts.replace(rows, path, homes)
    parts.replace(parts.read(spark, path, rows.schema, homes).where("month = 'a'").withColumn("x", F.col("x") + 10), path, homes)
    assert kept() == [10, 12, 14] and stages() == before and not (tmp_path / "t/month=b/bucket=0").exists()
    with pytest.raises(Exception, match="not read"):
        parts.replace(rows, path, [("a", 0)])
    assert kept() == [10, 12, 14]
    parts.replace(rows.where("x > 99"), path, [("a", 0)])
    assert not (tmp_path / "t/month=a/bucket=0").exists()


def test_a_run_that_broke_off_between_partitions(spark, tmp_path):
    """A moved job whose old row is still there: the batch run again leaves one row, with its first batch."""
    store, path = Snapshots(f"file://{tmp_path}/store", buckets=1), f"file://{tmp_path}/store/jobs"
    store.arrive(spark.createDataFrame([job(1, 0, 1), job(2, 5, 1)], SCHEMA), 0)
    old = spark.createDataFrame(spark.read.parquet(path).where("id = 1").collect(), spark.read.parquet(path).schema)
    moved = spark.createDataFrame([job(1, 60, 1, at=1)], SCHEMA)
    store.arrive(moved, 1)
    old.write.mode("append").partitionBy("month", "bucket").parquet(path)
    store.arrive(moved, 1)
    assert [(r.id, r.month, r.first_import_batch_id, r.last_import_batch_id) for r in spark.read.parquet(path).orderBy("id").collect()] == [(1, "2025-03", "batch-0", "batch-1"), (2, "2025-01", "batch-0", "batch-0")]
