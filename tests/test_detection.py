import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from revisit_spark.operators import candidates, pairs, scoring, signals
from revisit_spark.sources.tables import staged

SCHEMA = "organization_id long, id long, customer_id long, location_id long, equipment_id long, technician_id long, service_date date, started_at timestamp, status string, deleted_at timestamp"


def jobs(spark, rows):
    made = [(r.get("org", 1), r["id"], r.get("customer"), r.get("location"), r.get("equipment"), None, r["day"], r.get("start"), r.get("status", "completed"), None) for r in rows]
    return spark.createDataFrame(made, SCHEMA)


def found(df):
    return {(r.prior_id, r.followup_id) for r in df.collect()}


def test_pairs_order_window_and_blocks(spark):
    d = lambda n: date(2026, 1, n)
    rows = [
        {"id": 1, "customer": 7, "day": d(1), "start": datetime(2026, 1, 1, 9)},
        {"id": 2, "customer": 7, "day": d(1)},
        {"id": 3, "customer": 7, "day": d(31), "status": "unknown"},
        {"id": 4, "customer": 7, "day": date(2026, 2, 1)},
        {"id": 5, "customer": 7, "day": d(2), "status": "cancelled"},
        {"id": 6, "customer": 8, "equipment": 5, "day": d(3)},
        {"id": 7, "customer": 9, "equipment": 5, "day": d(4)},
        {"id": 8, "customer": 7, "day": d(1), "org": 2},
    ]
    got = found(pairs.candidate_pairs(jobs(spark, rows), window=30, cap=25))
    # A missing start is midnight, so 2 comes before 1; 30 days are in, 31 are out; no pair crosses tenants.
    assert got == {(2, 1), (2, 3), (1, 3), (3, 4), (6, 7)}


def test_cap_keeps_nearest(spark):
    rows = [{"id": i, "customer": 1, "day": date(2026, 1, i)} for i in range(1, 7)]
    got = pairs.candidate_pairs(jobs(spark, rows), cap=2)
    assert found(got) == {(i, j) for i in range(1, 7) for j in (i + 1, i + 2) if j <= 6}


def test_look_ahead_equals_plain_join(spark):
    import random

    random.seed(5)
    rows = [{"id": i, "customer": random.choice([None, 1, 2]), "equipment": random.choice([None, 1]), "day": date.fromordinal(730000 + random.randint(0, 1500)), "org": random.choice([1, 2])} for i in range(300)]
    df = jobs(spark, rows).withColumn("t", F.col("service_date").cast("timestamp"))
    p, f = df.alias("p"), df.alias("f")
    near = F.datediff("f.service_date", "p.service_date").between(0, 40) & (F.struct("f.service_date", "f.t", "f.id") > F.struct("p.service_date", "p.t", "p.id"))
    plain = p.join(f, (F.col("p.organization_id") == F.col("f.organization_id")) & near & (F.coalesce(F.col("p.customer_id") == F.col("f.customer_id"), F.lit(False)) | F.coalesce(F.col("p.equipment_id") == F.col("f.equipment_id"), F.lit(False))))
    expect = {(r[0], r[1]) for r in plain.select("p.id", "f.id").collect()}
    assert found(pairs.candidate_pairs(jobs(spark, rows), window=40, cap=1000)) == expect


def evaluated(spark, parts):
    """parts: (kind, weight, outcome, strength)"""
    rows = [(f"k{i}", "", kind, i, outcome, strength, "", weight, "0", "") for i, (kind, weight, outcome, strength) in enumerate(parts)]
    schema = "array<struct<key:string,label:string,kind:string,position:int,outcome:string,strength:string,raw_value:string,weight:string,contribution:string,explanation:string>>"
    df = spark.createDataFrame([(rows,)], f"signals {schema}")
    return df.select(F.transform("signals", lambda s: s.withField("strength", s["strength"].cast("decimal(5,4)")).withField("weight", s["weight"].cast("decimal(8,2)"))).alias("signals"))


@pytest.mark.parametrize(
    "parts,raw,points,band",
    [
        ([("additive", "20", "matched", "1"), ("additive", "25", "matched", "0.8"), ("additive", "10", "not_matched", "0")], 4000, 7273, "medium"),
        ([("additive", "20", "matched", "1"), ("additive", "30", "not_evaluable", "0")], 2000, 10000, "high"),
        ([("additive", "20", "matched", "1"), ("veto", "0", "matched", "1")], 0, 0, "low"),
        ([("additive", "20", "matched", "1"), ("veto", "0", "not_evaluable", "0")], 2000, 10000, "high"),
        ([("additive", "25", "matched", "1"), ("multiplier", "1.2", "matched", "1"), ("multiplier", "1.5", "matched", "1")], 4500, 10000, "high"),
        ([("additive", "0", "matched", "1")], 0, 0, "low"),
        ([("additive", "49.99", "matched", "1"), ("additive", "50.01", "not_matched", "0")], 4999, 4999, "low"),
        ([("additive", "74.99", "matched", "1"), ("additive", "25.01", "not_matched", "0")], 7499, 7499, "medium"),
        ([("additive", "75", "matched", "1"), ("additive", "25", "not_matched", "0")], 7500, 7500, "high"),
    ],
)
def test_scores(spark, parts, raw, points, band):
    rules = tuple(signals.Rule(k, "", "1", kind) for k, (kind, *_) in zip(signals.REGISTRY, parts, strict=False))
    rules = tuple(signals.Rule(r.key, "", "1", r.kind, signals.DEFAULT_RULES[3].params if r.key == "days_between" else {}) for r in rules)
    got = scoring.scored(evaluated(spark, parts), rules).first()
    assert (got.raw_cents, got.basis_points, got.band) == (raw, points, band)


def test_gate_only_hides(spark):
    rules = (signals.Rule("same_customer", "", "1"), signals.Rule("same_location", "", "1", "gate"))
    got = scoring.scored(evaluated(spark, [("additive", "20", "matched", "1"), ("gate", "0", "not_matched", "0")]), rules).first()
    assert got.basis_points == 10000 and not got.surfaced


def test_rules_are_checked():
    for rules in ((), (signals.Rule("no_such", "", "1"),), (signals.Rule("same_customer", "", "-1"),), (signals.Rule("same_customer", "", "1"),) * 2, (signals.Rule("low_value_followup", "", "1", params={"maximum_ratio": "2"}),)):
        with pytest.raises(ValueError):
            signals.checked(rules)


def test_rerun_keeps_identity_and_suppresses(spark):
    rows = [{"id": 1, "customer": 1, "day": date(2026, 1, 1)}, {"id": 2, "customer": 1, "day": date(2026, 1, 31)}, {"id": 3, "customer": 1, "day": date(2026, 1, 31)}]
    j = jobs(spark, rows)
    first = candidates.upserted(None, pairs.candidate_pairs(j), "r1")
    again = candidates.upserted(first.drop("change"), pairs.candidate_pairs(j), "r2")
    assert {r.candidate_id for r in first.collect()} == {r.candidate_id for r in again.collect()}
    assert {r.change for r in again.collect()} == {"updated"}
    narrow = candidates.upserted(first.drop("change"), pairs.candidate_pairs(j, window=1), "r2")
    out = {(r.prior_id, r.followup_id): (r.suppressed, r.suppressed_reason) for r in candidates.out_of_window(narrow, pairs.visits(j), "r2").collect()}
    assert out[(1, 2)] == (True, "out_of_window") and out[(2, 3)] == (False, None)


def above(plan: str, leaf: str) -> list[list[str]]:
    """For each line of a plan with ``leaf``, the operators above it up to the nearest join."""
    out, stack = [], []
    for line in plan.splitlines():
        depth = len(re.match(r"(?:[: ]  )*(?:[:+]- )?", line)[0])
        stack = [(d, x) for d, x in stack if d < depth] + [(depth, re.sub(r"^\*\(\d+\) ", "", line[depth:]))]
        if leaf in line:
            names = [x.split(" ")[0] for _, x in stack[:-1]]
            joins = [i for i, x in enumerate(names) if "Join" in x]
            out.append(names[joins[-1] + 1 :])
    return out


def test_jobs_stay_where_they_are(spark):
    """Pairs go to the buckets of their jobs: no exchange between the jobs' scans and their joins."""
    jobs = spark.createDataFrame([(1, i, 1, None, None, None, "c", date(2026, 1, 1 + i), None, "completed", None, False, "c", None) for i in range(9)], "organization_id long, id long, customer_id long, location_id long, equipment_id long, technician_id long, category_id string, service_date date, started_at timestamp, status string, revenue decimal(14,2), is_warranty boolean, raw_category string, raw_job_type string")
    found = pairs.candidate_pairs(jobs)
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, x in zip(held, ("-1", "false"), strict=True):
        spark.conf.set(k, x)
    try:
        context = signals.pair_context(found, jobs, None, None)
        over = above(context._jdf.queryExecution().executedPlan().toString(), ".buckets_")
        assert len(over) == 2 and not any("Exchange" in x for names in over for x in names)
        assert context.count() == found.count() == 36
    finally:
        for k, x in held.items():
            spark.conf.set(k, x)


def test_signals_are_worked_out_once_and_for_jobs_of_pairs_alone(spark):
    jobs = spark.createDataFrame([(1, i, 1 if i < 3 else i, f"2024-01-0{i + 1}") for i in range(6)], "organization_id int, id int, customer_id int, day string")
    none = {c: F.lit(None).cast(t) for c, t in {"location_id": "int", "equipment_id": "int", "technician_id": "int", "category_id": "string", "started_at": "timestamp", "revenue": "decimal(14,2)", "is_warranty": "boolean", "raw_category": "string", "raw_job_type": "string"}.items()}
    jobs = jobs.withColumns(none | {"service_date": F.to_date("day"), "status": F.lit("completed")})
    found = staged(pairs.candidate_pairs(jobs))
    lines = jobs.select(F.col("id").alias("job_id"), F.lit("part").alias("kind"), F.lit(" AB").alias("code"))
    told = signals.pair_context(found, jobs, None, lines)
    assert sorted((r.prior_id, r.followup_id, r.visits, r.prior_codes, r.followup_codes) for r in told.collect()) == [(0, 1, 3, ["ab"], ["ab"]), (0, 2, 3, ["ab"], ["ab"]), (1, 2, 2, ["ab"], ["ab"])]
    wanted = jobs.where("id < 3").select("organization_id", "id")
    assert sorted(r.id for r in signals.job_facts(jobs, lines, wanted=wanted).collect()) == [0, 1, 2]
    uses = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString().count("repeat_part_code")
    evaluated = signals.evaluated(told)
    assert uses(scoring.scored(evaluated).drop("signals")) == uses(evaluated)
