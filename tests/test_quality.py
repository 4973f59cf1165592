import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from revisit_spark.operators import analytics, audit, costs, lifecycle, queue, reviews, scoring, search, usage

PAIR = "organization_id int, prior_id int, followup_id int"


def test_known_cost(spark):
    pairs = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (1, 1, 4)], PAIR)
    jobs = spark.createDataFrame([(1, 2, 100, 7), (1, 3, None, 8), (1, 4, 1, None)], "organization_id int, id int, duration_minutes int, technician_id int")
    rates = spark.createDataFrame([(7, "30.00"), (8, None)], "id int, hourly_cost_amount string")
    lines = spark.createDataFrame([(2, "part", "10.10"), (2, "labor", "99"), (3, "part", "5")], "job_id int, kind string, amount string")
    model = costs.CostModel(1, "40", "25", "10", "12", 90, True, (("6", "hour"), ("1.01", "visit")))
    total = lambda m: {r.followup_id: r.total_cents for r in costs.visit_costs(pairs, jobs, rates, lines, m).collect()}
    # 100 minutes at 30 + 12 + 6 an hour are 80.00; 90 at 58 are 87.00; one at 58 is 0.9667
    assert total(model) == {2: 8000 + 3601 + 1010, 3: 8700 + 3601 + 500, 4: 97 + 3601}
    assert total(costs.CostModel(1, "40", include_parts=False)) == {2: 5000, 3: 6000, 4: 67}
    with pytest.raises(ValueError):
        costs.CostModel(1, "-1").checked()
    with pytest.raises(PySparkException, match="USD"):
        costs.visit_costs(pairs, jobs.withColumn("currency_code", F.lit("EUR")), rates, lines, model).collect()


def test_snapshots_stay(spark):
    schema = PAIR + ", model_version int, total_cents long"
    old = spark.createDataFrame([(1, 1, 2, 1, 100)], schema)
    new = spark.createDataFrame([(1, 1, 2, 1, 999), (1, 1, 2, 2, 999), (1, 1, 3, 1, 5)], schema)
    assert {(r.followup_id, r.model_version): r.total_cents for r in costs.snapshots(old, new).collect()} == {(2, 1): 100, (2, 2): 999, (3, 1): 5}


def test_reviews_of_suppressed_candidates_are_refused(spark):
    log = spark.createDataFrame([("a", 1, 1, "confirmed", "warranty", None, " "), ("b", 2, 1, "confirmed", "warranty", None, "x"), ("c", 3, 1, "rejected", "unrelated", None, "x")], "candidate_id string, id int, decided_at int, decision string, category string, root_cause string, note string")
    known = spark.createDataFrame([("a", False, 7), ("b", True, 8)], "candidate_id string, suppressed boolean, basis_points int")
    got = {r.candidate_id: (r.refused, r.note, r.basis_points_at_review) for r in reviews.judged(log, reviews.categories(spark), known).collect()}
    assert got == {"a": (None, None, 7), "b": ("candidate_suppressed", "x", 8), "c": ("unknown_candidate", "x", None)}
    assert len(reviews.CATEGORIES["rework"]) == 6 and reviews.causes(spark).count() == 9
    order = [r.id for r in reviews.history(log.withColumn("candidate_id", F.lit("a")), "a").orderBy("place").collect()]
    assert order == [3, 2, 1]


def test_retention_and_deletion(spark):
    jobs = spark.createDataFrame([(1, 1, "2020-01-01", "x", "x"), (1, 2, "2025-06-01", "x", "y"), (1, 3, "2025-07-01", "y", "y")], "organization_id int, id int, service_date string, first_import_batch_id string, last_import_batch_id string").withColumn("service_date", F.col("service_date").cast("date"))
    tenants = spark.createDataFrame([(1, 24)], "organization_id int, retention_months int")
    pairs = spark.createDataFrame([(1, 1, 2), (1, 2, 3)], PAIR)
    kept = lifecycle.jobs_retained(jobs, tenants, "2026-01-01")
    assert {r.id for r in kept.collect()} == {2, 3} and [r.prior_id for r in lifecycle.pairs_retained(pairs, kept).collect()] == [2]
    preview = {r.batch_id: (r.jobs_deleted, r.jobs_retained, r.candidates_deleted, r.reviews_destroyed) for r in lifecycle.delete_preview(jobs, pairs, pairs.where("prior_id = 1")).collect()}
    assert preview == {"x": (1, 1, 1, 1), "y": (1, 1, 1, 0)}


def test_evidence_is_merged_and_current(spark):
    schema = PAIR + ", run_id string, key string, weight int"
    old = spark.createDataFrame([(1, 1, 2, "r1", "k", 1), (1, 1, 2, "r2", "k", 2)], schema)
    new = spark.createDataFrame([(1, 1, 2, "r2", "k", 3)], schema)
    both = scoring.merged(old, new, ["organization_id", "prior_id", "followup_id", "run_id", "key"])
    assert sorted(r.weight for r in both.collect()) == [1, 3]
    snapshot = spark.createDataFrame([(1, 1, 2, "r2")], PAIR + ", run_id string")
    assert [r.weight for r in scoring.current_evidence(both, snapshot).collect()] == [3]


def test_top_share_counts_ties_together(spark):
    d = spark.createDataFrame([(i % 2, i, 100 if i < 6 else i) for i in range(60)], "organization_id int, id int, basis_points int")
    assert {r.id for r in analytics.top_share(d).collect() if r.in_top} == {0, 1, 2, 3, 4, 5}


def test_tenants_are_ranked_alone(spark):
    rows = [(org, i, i + 1, (i * 37 + org) % 1000 if org else 0) for org, n in ((0, 300), (1, 40), (2, 3)) for i in range(n)]
    d = spark.createDataFrame(rows, PAIR + ", basis_points int")
    got = {(r.organization_id, r.prior_id): (r.rank_before, r.rank_after) for r in analytics.whatif(d, d.withColumn("basis_points", -F.col("basis_points")), most=5).collect()}
    for org in (0, 1, 2):
        own = [r for r in rows if r[0] == org]
        for side, sign in ((0, -1), (1, 1)):
            assert {k[1]: v[side] for k, v in got.items() if k[0] == org and v[side]} == {r[1]: n + 1 for n, r in enumerate(sorted(own, key=lambda r: (sign * r[3], r[1]))[:5])}


def test_two_tenants_with_one_key(spark):
    taxonomy = spark.createDataFrame([(1, "warranty", "rework", True, True), (2, "warranty", "not_rework", False, True)], "organization_id int, key string, outcome string, counts_toward_cost boolean, active boolean")
    log = spark.createDataFrame([(o, "c", 1, 1, "confirmed", "warranty", None, "x") for o in (1, 2, 3)], "organization_id int, candidate_id string, id int, decided_at int, decision string, category string, root_cause string, note string")
    got = {r.organization_id: r.refused for r in reviews.judged(log, taxonomy).collect()}
    assert got == {1: None, 2: "category_does_not_fit", 3: "unknown_category"}
    rows = spark.createDataFrame([(1, "warranty", "a", 100), (2, "warranty", "a", 7), (2, "warranty", "b", 9)], "organization_id int, category string, root_cause string, total_cents long")
    found = {(r.organization_id, r.outcome, r.root_cause): (r.pairs, r.cost_cents) for r in costs.breakdown(rows, "root_cause", taxonomy).collect()}
    assert found == {(1, "rework", "a"): (1, 100), (1, "rework", None): (1, 100), (1, None, None): (1, 100), (2, "not_rework", "a"): (1, 0), (2, "not_rework", "b"): (1, 0), (2, "not_rework", None): (2, 0), (2, None, None): (2, 0)}


def test_pages_go_both_ways(spark):
    d = spark.createDataFrame([(i,) for i in range(10)], "id int")
    up, down = queue.ascending(d, ["id"], (4,), 3), queue.ascending(d, ["id"], (4,), 3, descending=True)
    assert [r.id for r in up.collect()] == [5, 6, 7, 8] and [r.id for r in down.collect()] == [3, 2, 1, 0]


def test_limits_and_audit(spark):
    found = spark.createDataFrame([(1, "m", 5), (2, "m", None)], "organization_id int, metric string, most long")
    asked = spark.createDataFrame([(1, "m", 4, 2), (2, "m", 4, 2)], "organization_id int, metric string, current long, amount long")
    assert {r.organization_id: (r.allowed, r.reason) for r in usage.checked(asked, found).collect()} == {1: (False, "limit of 5 reached"), 2: (True, None)}
    got = spark.range(1).select(audit.sanitized(F.lit("membership"), F.create_map(F.lit("role"), F.repeat(F.lit("x"), 300), F.lit("secret"), F.lit("y"))).alias("c")).first().c
    assert got == {"role": "x" * 200}


def test_search_reads_its_words_alone(spark, tmp_path):
    texts = ["No heat in the hall", "heat: no", "the Hall, no heat", None, "", "café 12 heat no heat", "no no heat"]
    jobs = spark.createDataFrame([(1 + i % 2, i, t, "more here") for i, t in enumerate(texts)], "organization_id int, id int, summary string, resolution string")
    path = f"file://{tmp_path}/index"
    search.write_index(jobs, path, buckets=32)
    ids = lambda asked, **more: sorted(r.id for r in search.search(spark, path, asked, buckets=32, **more).collect())
    assert ids("HEAT no") == [0, 1, 2, 5, 6] and ids('"no heat"') == [0, 2, 5, 6] and ids('"the hall" heat') == [0, 2] and ids("heat", organization_id=2) == [1, 5]
    assert ids("nowhere heat") == [] and ids(" - ") == [] and ids('"no no heat"') == [6] and ids('"12 heat no heat more"') == [5] and ids("here") == list(range(7))
    found = search.search(spark, path, "hall", buckets=32)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "PushedFilters" in plan and "word" in plan.split("PushedFilters")[1]


def test_an_index_moves_its_postings_once(spark, tmp_path):
    texts = ["no no heat", None, "heat no", "", "no"]
    jobs = spark.createDataFrame([(None if i == 4 else 1, i, t, "no") for i, t in enumerate(texts)], "organization_id int, id int, summary string, resolution string")
    found = search.postings(jobs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.organization_id or 0, r.id, r.word, r.at) for r in found.collect()) == [(0, 4, "no", [0, 1]), (1, 0, "heat", [2]), (1, 0, "no", [0, 1, 3]), (1, 1, "no", [0]), (1, 2, "heat", [0]), (1, 2, "no", [1, 2]), (1, 3, "no", [0])]
