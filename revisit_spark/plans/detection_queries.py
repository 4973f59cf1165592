"""Queries of detection: pairs, signals, scores, snapshots, the review queue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize
from ..operators import analytics, candidates, costs, lifecycle, pairs, queue, reviews, scoring, signals
from ..sources import delimited
from ..sources.tables import bucketed, stage_path, staged
from ..streaming.incremental import Seen, Snapshots
from . import testviews as v
from .detect import detect

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PAIRS = v.pairs_sql()

#: Rules with a multiplier and a gate, and a higher ratio.
CUSTOM_RULES = (
    *(r for r in signals.DEFAULT_RULES if r.key not in ("same_technician", "low_value_followup", "warranty_marker")),
    signals.Rule("low_value_followup", "Low-value follow-up", "10", params={"maximum_ratio": "0.50"}),
    signals.Rule("same_technician", "Same technician", "1.50", "multiplier"),
    signals.Rule("warranty_marker", "Warranty marker", "0", "gate"),
)


def signals_sql(window: int = 30, cap: int = 25, ratio: str = "0.20") -> str:
    """(.., key, outcome, strength): strength in ten-thousandths."""
    same = {"same_customer": "customer_id", "same_location": "location_id", "same_equipment": "equipment_id", "same_service_category": "category_id", "same_technician": "technician_id"}
    rules = {k: f"CASE WHEN p.{c} IS NULL OR f.{c} IS NULL THEN 'not_evaluable' WHEN p.{c} = f.{c} THEN 'matched' ELSE 'not_matched' END" for k, c in same.items()}
    rules |= {
        "days_between": "CASE WHEN days_between <= 90 THEN 'matched' ELSE 'not_matched' END",
        "zero_value_followup": "CASE WHEN f.revenue IS NULL THEN 'not_evaluable' WHEN f.revenue = 0 THEN 'matched' ELSE 'not_matched' END",
        "low_value_followup": f"CASE WHEN f.revenue IS NULL OR p.revenue IS NULL OR p.revenue <= 0 THEN 'not_evaluable' WHEN f.revenue < p.revenue * {ratio} THEN 'matched' ELSE 'not_matched' END",
        "warranty_marker": "CASE WHEN f.is_warranty THEN 'matched' ELSE 'not_matched' END",
        "within_equipment_warranty": "CASE WHEN f.equipment_id IS NULL OR e.until IS NULL THEN 'not_evaluable' WHEN f.service_date <= e.until THEN 'matched' ELSE 'not_matched' END",
        "repeat_part_code": "CASE WHEN pc.codes IS NULL OR fc.codes IS NULL THEN 'not_evaluable' WHEN list_has_any(pc.codes, fc.codes) THEN 'matched' ELSE 'not_matched' END",
        "recurrence_density": "CASE WHEN r.visits >= 3 THEN 'matched' ELSE 'not_matched' END",
        "scheduled_maintenance": "CASE WHEN f.raw_category = '5-low' THEN 'matched' ELSE 'not_matched' END",
        "planned_multivisit": "CASE WHEN p.raw_job_type IS NULL THEN 'not_evaluable' WHEN lower(p.raw_job_type) LIKE '%multi-visit%' THEN 'matched' ELSE 'not_matched' END",
    }
    wide = ", ".join(f"{sql} AS s_{k}" for k, sql in rules.items())
    band = "CASE WHEN days_between <= 1 THEN 7000 WHEN days_between <= 7 THEN 10000 WHEN days_between <= 14 THEN 8000 WHEN days_between <= 30 THEN 5000 ELSE 2500 END"
    long = " UNION ALL ".join(f"SELECT organization_id, prior_id, followup_id, '{k}' AS key, s_{k} AS outcome, CASE WHEN s_{k} <> 'matched' THEN 0 ELSE {band if k == 'days_between' else '10000'} END AS strength FROM wide" for k in rules)
    return f"""{v.pairs_sql(window, cap)}, codes AS (
  SELECT l_orderkey, list(DISTINCT l_partkey) AS codes FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey
), gear AS (
  SELECT p_partkey, CASE WHEN p_size % 10 <> 0 THEN DATE '1995-01-01' + (p_partkey % 2400)::INTEGER END AS until FROM part
), recur AS (
  SELECT a.organization_id, a.id, count(*) AS visits FROM visits a JOIN visits b ON a.organization_id = b.organization_id
    AND (a.customer_id = b.customer_id OR a.equipment_id = b.equipment_id) AND b.service_date BETWEEN a.service_date AND a.service_date + {window} GROUP BY 1, 2
), wide AS (
  SELECT organization_id, prior_id, followup_id, days_between, {wide}
  FROM pairs JOIN jobs p USING (organization_id) JOIN jobs f USING (organization_id)
    LEFT JOIN gear e ON e.p_partkey = f.equipment_id LEFT JOIN codes pc ON pc.l_orderkey = p.id LEFT JOIN codes fc ON fc.l_orderkey = f.id
    LEFT JOIN recur r ON r.organization_id = p.organization_id AND r.id = p.id
  WHERE p.id = prior_id AND f.id = followup_id
), long AS ({long})""".replace("SELECT organization_id, prior_id, followup_id, days_between, ", "SELECT p.organization_id, prior_id, followup_id, days_between, ").replace("FROM pairs JOIN jobs p USING (organization_id) JOIN jobs f USING (organization_id)", "FROM pairs q JOIN jobs p ON p.organization_id = q.organization_id AND p.id = prior_id JOIN jobs f ON f.organization_id = q.organization_id AND f.id = followup_id").replace("\n  WHERE p.id = prior_id AND f.id = followup_id", "")


def scores_sql(rules: tuple[signals.Rule, ...] = signals.DEFAULT_RULES, ratio: str = "0.20", window: int = 30, cap: int = 25) -> str:
    table = ", ".join(f"({i}, '{r.key}', '{r.label}', '{r.kind}', {round(float(r.weight) * 100)})" for i, r in enumerate(rules))
    unit = 100 ** sum(r.kind == "multiplier" for r in rules)
    return f"""{signals_sql(window, cap, ratio)}, rules(position, key, label, kind, w) AS (VALUES {table}), each AS (
  SELECT long.*, position, label, kind, w FROM long JOIN rules USING (key)
), sums AS (
  SELECT organization_id, prior_id, followup_id,
    sum(CASE WHEN kind = 'additive' AND outcome = 'matched' THEN w * strength ELSE 0 END) * product(CASE WHEN kind <> 'multiplier' THEN 1 WHEN outcome = 'matched' THEN w ELSE 100 END)::HUGEINT AS r,
    sum(CASE WHEN kind = 'additive' AND outcome <> 'not_evaluable' THEN w * 10000 ELSE 0 END) * {unit} AS m,
    arg_min(key, position) FILTER (kind = 'veto' AND outcome = 'matched') AS suppressed_by,
    coalesce(bool_and(outcome <> 'not_matched') FILTER (kind = 'gate'), true) AS gates_passed
  FROM each GROUP BY 1, 2, 3
), scores AS (
  SELECT organization_id, prior_id, followup_id, CASE WHEN suppressed_by IS NOT NULL THEN 0 ELSE (r * 2 + {10_000 * unit}) // {20_000 * unit} END::BIGINT AS raw_cents,
    CASE WHEN suppressed_by IS NOT NULL OR m = 0 THEN 0 ELSE least((r * 20000 + m) // (2 * m), 10000) END::BIGINT AS basis_points,
    CASE WHEN suppressed_by IS NOT NULL OR m = 0 THEN 'low' WHEN r * 100 >= m * 75 THEN 'high' WHEN r * 100 >= m * 50 THEN 'medium' ELSE 'low' END AS band,
    suppressed_by, gates_passed FROM sums
)"""


SCORES = "SELECT organization_id, prior_id, followup_id, raw_cents, basis_points, band, suppressed_by, gates_passed, suppressed_by IS NULL AND gates_passed AND basis_points >= 4000 AS surfaced FROM scores"


def detected(spark: SparkSession, sf_dir: str, window: int = 30, cap: int = 25) -> tuple[DataFrame, DataFrame]:
    """Jobs and their pairs, each written once."""
    jobs = staged(v.jobs(spark, sf_dir))
    return jobs, staged(pairs.candidate_pairs(jobs, window, cap))


def context(spark: SparkSession, sf_dir: str, jobs: DataFrame, found: DataFrame, window: int = 30) -> DataFrame:
    return signals.pair_context(found, jobs, v.equipment(spark, sf_dir), v.line_items(spark, sf_dir), window)


def evaluated(spark: SparkSession, sf_dir: str, rules=signals.DEFAULT_RULES, made: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Pairs with their signals; ``made`` has the jobs and pairs where the caller has them."""
    return signals.evaluated(context(spark, sf_dir, *(made or detected(spark, sf_dir))), with_maintenance(rules))


def with_maintenance(rules: tuple[signals.Rule, ...]) -> tuple[signals.Rule, ...]:
    """The test tables' lowest priority stands for maintenance."""
    return tuple(signals.Rule(r.key, r.label, r.weight, r.kind, {"categories": ["5-low"]}) if r.key == "scheduled_maintenance" else r for r in rules)


def scored(spark: SparkSession, sf_dir: str, rules=signals.DEFAULT_RULES, made: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    return scoring.scored(evaluated(spark, sf_dir, rules, made), with_maintenance(rules))


@query(PAIRS + " SELECT * FROM pairs")
def pairs_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.candidate_pairs(v.jobs(spark, sf_dir))


@query(v.pairs_sql(cap=1) + " SELECT * FROM pairs")
def pairs_capped_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.candidate_pairs(v.jobs(spark, sf_dir), cap=1)


@query(PAIRS + " SELECT a.organization_id, a.id, count(*)::BIGINT AS visits FROM visits a JOIN visits b ON a.organization_id = b.organization_id AND (a.customer_id = b.customer_id OR a.equipment_id = b.equipment_id) AND b.service_date BETWEEN a.service_date AND a.service_date + 30 GROUP BY 1, 2")
def recurrence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.recurrence(v.jobs(spark, sf_dir))


@query("SELECT l_orderkey AS job_id, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS codes FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey")
def part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.part_codes(v.line_items(spark, sf_dir)).select("job_id", F.array_join("codes", ",").alias("codes"))


@query(signals_sql() + " SELECT organization_id, prior_id, followup_id, key, outcome, strength::BIGINT AS strength FROM long")
def signals_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = evaluated(spark, sf_dir).select("organization_id", "prior_id", "followup_id", F.explode("signals").alias("s"))
    return each.select("organization_id", "prior_id", "followup_id", "s.key", "s.outcome", (F.col("s.strength") * 10000).cast("long").alias("strength"))


@query(scores_sql() + """ SELECT organization_id, prior_id, followup_id, key, label, kind, outcome, c AS contribution_cents,
  row_number() OVER (PARTITION BY organization_id, prior_id, followup_id ORDER BY c DESC, key)::INTEGER AS rank
FROM (SELECT *, CASE WHEN kind = 'additive' AND outcome = 'matched' THEN (w * strength * 2 + 10000) // 20000 ELSE 0 END::BIGINT AS c FROM each)""")
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.evidence(evaluated(spark, sf_dir))
    return rows.select("organization_id", "prior_id", "followup_id", "key", "label", "kind", "outcome", (F.col("contribution") * 100).cast("long").alias("contribution_cents"), "rank")


@query(f"{scores_sql()} {SCORES}")
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).drop("signals")


@query(f"{scores_sql(CUSTOM_RULES, '0.50')} {SCORES}")
def scores_custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, CUSTOM_RULES).drop("signals")


def two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = staged(v.jobs(spark, sf_dir))
    first = candidates.upserted(None, pairs.candidate_pairs(jobs), "run-1").drop("change")
    second = candidates.upserted(first, pairs.candidate_pairs(jobs, window=7), "run-2")
    return candidates.out_of_window(second, pairs.visits(jobs), "run-2")


TWO_RUNS = PAIRS + ", runs AS (SELECT *, days_between <= 7 AS again FROM pairs)"


@query(TWO_RUNS + " SELECT sha256(concat_ws('|', organization_id, prior_id, followup_id)) AS candidate_id, organization_id, prior_id, followup_id, days_between, CASE WHEN again THEN 'run-2' ELSE 'run-1' END AS run_id, 'run-1' AS first_detected_run, 'pending' AS workflow_status FROM runs")
def candidate_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_runs(spark, sf_dir).select("candidate_id", "organization_id", "prior_id", "followup_id", "days_between", "run_id", "first_detected_run", "workflow_status")


@query(TWO_RUNS + " SELECT organization_id, prior_id, followup_id, NOT again AS suppressed, CASE WHEN NOT again THEN 'out_of_window' END AS suppressed_reason, CASE WHEN again THEN 'updated' ELSE 'suppressed' END AS change FROM runs")
def candidate_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_runs(spark, sf_dir).select("organization_id", "prior_id", "followup_id", "suppressed", "suppressed_reason", "change")


@query(scores_sql(window=7) + """, old AS (SELECT count(*) AS n FROM visits p JOIN visits f ON p.organization_id = f.organization_id
    AND (p.customer_id = f.customer_id OR p.equipment_id = f.equipment_id OR p.location_id = f.location_id)
    AND f.service_date BETWEEN p.service_date AND p.service_date + 30 AND (f.service_date, f.order_ts, f.id) > (p.service_date, p.order_ts, p.id))
SELECT count(*) AS pairs, 0::BIGINT AS created, count(*) AS updated, ((SELECT n FROM old) - count(*) + count(suppressed_by))::BIGINT AS suppressed, count(*) AS scored FROM scores""")
def detection_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, gear, lines = staged(v.jobs(spark, sf_dir)), v.equipment(spark, sf_dir), v.line_items(spark, sf_dir)
    rules = with_maintenance(signals.DEFAULT_RULES)
    first = detect(jobs, gear, lines, rules=rules)
    second = detect(jobs, gear, lines, staged(first.snapshot.drop("change")), "run-2", window=7, rules=rules)
    return second.counters


QUEUE = scores_sql() + ", q AS (SELECT scores.*, sha256(concat_ws('|', organization_id, prior_id, followup_id)) AS candidate_id, days_between, customer_id, equipment_id, prior_technician_id, followup_technician_id FROM scores JOIN pairs USING (organization_id, prior_id, followup_id))"


def open_queue(spark: SparkSession, sf_dir: str, made: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    return _queue(spark, sf_dir, made)[1]


def _queue(spark: SparkSession, sf_dir: str, made: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Jobs, and the queue of their pairs; ``made`` has the jobs and pairs where the caller has them."""
    made = made or detected(spark, sf_dir)
    snapshot = candidates.upserted(None, made[1], "run-1").drop("change")
    return made[0], queue.ready(snapshot, scored(spark, sf_dir, made=made).drop("signals"))


@query(QUEUE + " SELECT candidate_id, organization_id, prior_id, followup_id, basis_points, band FROM q WHERE suppressed_by IS NULL ORDER BY basis_points DESC, candidate_id LIMIT 50")
def proof_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.proof(open_queue(spark, sf_dir)).select("candidate_id", "organization_id", "prior_id", "followup_id", "basis_points", "band")


@query(QUEUE + " SELECT candidate_id, basis_points, days_between, p.raw_job_type AS prior_type, f.raw_job_type AS followup_type, c_name AS customer_name FROM (SELECT * FROM q WHERE suppressed_by IS NULL ORDER BY basis_points DESC, candidate_id DESC LIMIT 51) x JOIN jobs p ON p.id = prior_id JOIN jobs f ON f.id = followup_id LEFT JOIN customer ON c_custkey = x.customer_id")
def queue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, rows = _queue(spark, sf_dir)
    page = queue.page(rows, "basis_points")
    names = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    full = queue.hydrated(page, jobs, names)
    return full.select("candidate_id", "basis_points", "days_between", F.col("prior.raw_job_type").alias("prior_type"), F.col("followup.raw_job_type").alias("followup_type"), "customer_name")


@query(QUEUE + ", c AS (SELECT basis_points AS v, candidate_id AS i FROM q WHERE suppressed_by IS NULL ORDER BY 1 DESC, 2 DESC LIMIT 1 OFFSET 49) SELECT candidate_id, basis_points FROM q, c WHERE suppressed_by IS NULL AND (basis_points < v OR basis_points = v AND candidate_id < i) ORDER BY basis_points DESC, candidate_id DESC LIMIT 51")
def queue_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(open_queue(spark, sf_dir))
    last = queue.page(rows, "basis_points").limit(50).orderBy("basis_points", "candidate_id").select("basis_points", "candidate_id").first()
    cursor = (last[0], last[1]) if last else None
    return queue.page(rows, "basis_points", cursor).select("candidate_id", "basis_points")


@query(QUEUE + " SELECT candidate_id, basis_points, band FROM q JOIN jobs f ON f.id = followup_id WHERE suppressed_by IS NULL AND basis_points >= 3000 AND band = 'medium' AND f.service_date >= DATE '1996-01-01' AND f.service_date <= DATE '2000-12-31'")
def queue_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, rows = _queue(spark, sf_dir)
    kept = queue.filtered(rows, jobs, min_basis_points=3000, band="medium", date_from="1996-01-01", date_to="2000-12-31")
    return kept.select("candidate_id", "basis_points", "band")


def truth(found: DataFrame) -> DataFrame:
    """A decision on every pair, by the follow-up's number."""
    k = F.col("followup_id") % 3
    return found.select("organization_id", "prior_id", "followup_id", F.when(k == 0, "confirmed").when(k == 1, "rejected").otherwise("uncertain").alias("decision"))


@query(scores_sql() + " SELECT organization_id, band, count_if(followup_id % 3 = 0)::BIGINT AS confirmed, count_if(followup_id % 3 = 1)::BIGINT AS rejected, (count_if(followup_id % 3 = 0) * 10000 // nullif(count_if(followup_id % 3 < 2), 0))::BIGINT AS precision FROM scores GROUP BY 1, 2")
def precision_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = detected(spark, sf_dir)
    return analytics.precision_by_band(scored(spark, sf_dir, made=made), truth(made[1]))


@query(scores_sql() + " SELECT organization_id, least(basis_points // 1000, 9)::INTEGER AS bucket, count(*) AS reviewed, count_if(followup_id % 3 = 0)::BIGINT AS confirmed FROM scores GROUP BY 1, 2")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = detected(spark, sf_dir)
    return analytics.calibration(scored(spark, sf_dir, made=made), truth(made[1]))


@query(scores_sql() + " SELECT organization_id, key, count_if(outcome = 'matched')::BIGINT AS matched, count_if(outcome = 'matched' AND followup_id % 3 = 0)::BIGINT AS matched_confirmed, count_if(outcome = 'not_matched')::BIGINT AS not_matched, count_if(outcome = 'not_matched' AND followup_id % 3 = 0)::BIGINT AS not_matched_confirmed FROM each GROUP BY 1, 2")
def signal_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = detected(spark, sf_dir)
    return analytics.signal_lift(scoring.evidence(evaluated(spark, sf_dir, made=made)), truth(made[1]))


@query(PAIRS + " SELECT organization_id, a.l_partkey::VARCHAR AS code, count(DISTINCT (prior_id, followup_id)) AS pairs FROM pairs JOIN lineitem a ON a.l_orderkey = prior_id AND a.l_returnflag = 'R' JOIN lineitem b ON b.l_orderkey = followup_id AND b.l_returnflag = 'R' AND a.l_partkey = b.l_partkey GROUP BY 1, 2")
def failing_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, found = detected(spark, sf_dir)
    return analytics.failing_parts(signals.pair_context(found, jobs, None, v.line_items(spark, sf_dir)))


@query(PAIRS + " SELECT DISTINCT organization_id, id, other_id FROM (SELECT organization_id, prior_id AS id, followup_id AS other_id FROM pairs UNION ALL SELECT organization_id, followup_id, prior_id FROM pairs)")
def related_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = v.jobs(spark, sf_dir)
    return analytics.related_visits(pairs.candidate_pairs(jobs), jobs)


@query(scores_sql() + """, c AS (SELECT *, CASE WHEN kind = 'additive' AND outcome = 'matched' THEN (w * strength * 2 + 10000) // 20000 ELSE 0 END::BIGINT AS c FROM each),
r AS (SELECT *, row_number() OVER (PARTITION BY organization_id, prior_id, followup_id ORDER BY c DESC, key) AS n FROM c) SELECT organization_id, prior_id, followup_id, string_agg(key, ',' ORDER BY n) AS keys FROM r WHERE n <= 3 GROUP BY 1, 2, 3""")
def top_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = queue.top_signals(scoring.evidence(evaluated(spark, sf_dir)))
    keys = F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"])
    return top.groupBy("organization_id", "prior_id", "followup_id").agg(F.array_join(keys, ",").alias("keys"))


@query(QUEUE + """, h AS (SELECT *, followup_id % 3 = 0 AS back FROM q WHERE suppressed_by IS NOT NULL) SELECT organization_id, suppressed_by AS reason, count(*) AS suppressed, count_if(back)::BIGINT AS taken_back, count_if(back AND followup_id % 2 = 0)::BIGINT AS confirmed,
 (count_if(back AND followup_id % 2 = 0) * 10000 // count(*))::BIGINT AS error FROM h GROUP BY 1, 2""")
def suppression_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("followup_id")
    hidden = staged(scored(spark, sf_dir).where("suppressed_by is not null").select("organization_id", "prior_id", "followup_id", F.col("suppressed_by").alias("reason"), (k % 3 == 0).alias("taken_back")))
    decided = hidden.select("organization_id", "prior_id", "followup_id", F.when(k % 2 == 0, "confirmed").otherwise("rejected").alias("decision"))
    return analytics.suppression_error(hidden, decided)


@query(scores_sql() + """, l AS (SELECT *, CASE WHEN suppressed_by = 'scheduled_maintenance' THEN 'maintenance' WHEN followup_id % 3 = 0 THEN 'callback' ELSE 'unrelated' END AS kind, (rank() OVER (PARTITION BY organization_id ORDER BY basis_points DESC) - 1) * 10 < count(*) OVER (PARTITION BY organization_id) AS top FROM scores)
SELECT organization_id, kind, count(*) AS pairs, count_if(top)::BIGINT AS top_tenth, count_if(suppressed_by IS NOT NULL)::BIGINT AS vetoed, count_if(basis_points < 4000)::BIGINT AS under_surface FROM l GROUP BY 1, 2""")
def label_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(scored(spark, sf_dir).drop("signals"))
    kind = F.when(F.col("suppressed_by") == "scheduled_maintenance", "maintenance").when(F.col("followup_id") % 3 == 0, "callback").otherwise("unrelated")
    return analytics.label_evaluation(rows, rows.select("organization_id", "prior_id", "followup_id", kind.alias("kind")))


def _top_sql(rules, ratio: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY basis_points DESC, prior_id, followup_id)::INTEGER AS place FROM ({scores_sql(rules, ratio)} SELECT organization_id, prior_id, followup_id, basis_points FROM scores)) WHERE place <= 20"


@query(f"SELECT coalesce(a.organization_id, b.organization_id) AS organization_id, coalesce(a.prior_id, b.prior_id) AS prior_id, coalesce(a.followup_id, b.followup_id) AS followup_id, a.place AS rank_before, b.place AS rank_after FROM ({_top_sql(signals.DEFAULT_RULES, '0.20')}) a FULL JOIN ({_top_sql(CUSTOM_RULES, '0.50')}) b ON a.organization_id = b.organization_id AND a.prior_id = b.prior_id AND a.followup_id = b.followup_id")
def whatif_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rule sets on one context: jobs, pairs and what these are judged by are worked out once."""
    told = context(spark, sf_dir, *detected(spark, sf_dir))
    under = lambda rules: scoring.scored(signals.evaluated(told, with_maintenance(rules)), with_maintenance(rules)).drop("signals")
    return analytics.whatif(under(signals.DEFAULT_RULES), under(CUSTOM_RULES))


@query(scores_sql() + """, runs(run_no) AS (VALUES (1), (2), (3), (4), (5)) SELECT organization_id, prior_id, followup_id, run_no, count(*) AS n FROM each JOIN runs ON (prior_id + run_no) % 4 <> 0
 WHERE (SELECT count(*) FROM runs later WHERE later.run_no > runs.run_no AND (prior_id + later.run_no) % 4 <> 0) < 3 GROUP BY 1, 2, 3, 4""")
def evidence_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of five runs; a pair isn't in every run."""
    rows = scoring.evidence(evaluated(spark, sf_dir)).withColumn("run_no", F.explode(F.array(*map(F.lit, range(1, 6))))).where((F.col("prior_id") + F.col("run_no")) % 4 != 0)
    return lifecycle.evidence_retained(rows).groupBy("organization_id", "prior_id", "followup_id", "run_no").agg(F.count("*").alias("n"))


@query(PAIRS + """, m AS (SELECT n_regionkey AS organization_id, 12 * (n_regionkey + 3) AS months FROM nation WHERE n_regionkey < 4 GROUP BY 1), k AS (SELECT jobs.organization_id, jobs.id FROM jobs LEFT JOIN m USING (organization_id) WHERE months IS NULL OR service_date >= DATE '2001-08-01' - to_months(months::INTEGER))
SELECT organization_id, prior_id, followup_id, followup_id % 3 AS decided FROM pairs WHERE (organization_id, prior_id) IN (SELECT organization_id, id FROM k) AND (organization_id, followup_id) IN (SELECT organization_id, id FROM k)""")
def reviews_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that hang on pairs whose both jobs are within their tenant's retention."""
    jobs = staged(v.jobs(spark, sf_dir))
    org = F.col("n_regionkey")
    tenants = v.table(spark, sf_dir, "nation").where(org < 4).select(org.alias("organization_id"), ((org + 3) * 12).alias("retention_months")).distinct()
    found = pairs.candidate_pairs(jobs)
    kept = lifecycle.pairs_retained(found, lifecycle.jobs_retained(jobs, tenants, "2001-08-01"))
    told = found.select("organization_id", "prior_id", "followup_id", (F.col("followup_id") % 3).alias("decided"))
    return lifecycle.hanging_on(told, kept)


@query(PAIRS + """, j AS (SELECT organization_id, id, id % 7 AS a, CASE WHEN id % 3 = 0 THEN (id + 1) % 7 ELSE id % 7 END AS b FROM jobs), t AS (SELECT DISTINCT organization_id, id, a = b AS goes, unnest([a, b]) AS batch_id FROM j),
g AS (SELECT DISTINCT p.organization_id, prior_id, followup_id, batch_id FROM pairs p JOIN t ON t.organization_id = p.organization_id AND t.id IN (prior_id, followup_id) AND goes),
x AS (SELECT organization_id, batch_id, count(*) AS candidates_deleted, sum(followup_id % 3)::BIGINT AS reviews_destroyed FROM g GROUP BY 1, 2)
SELECT organization_id, batch_id, count_if(goes)::BIGINT AS jobs_deleted, count_if(NOT goes)::BIGINT AS jobs_retained, coalesce(any_value(candidates_deleted), 0) AS candidates_deleted, coalesce(any_value(reviews_destroyed), 0) AS reviews_destroyed FROM t LEFT JOIN x USING (organization_id, batch_id) GROUP BY 1, 2""")
def import_delete_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = staged(v.jobs(spark, sf_dir))
    k = F.col("id")
    owned = jobs.select("organization_id", "id", (k % 7).alias("first_import_batch_id"), F.when(k % 3 == 0, (k + 1) % 7).otherwise(k % 7).alias("last_import_batch_id"))
    found = staged(pairs.candidate_pairs(jobs))
    told = found.select("organization_id", "prior_id", "followup_id", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("n")).where("n <= followup_id % 3")
    return lifecycle.delete_preview(owned, found, told)


@query(scores_sql() + """ SELECT organization_id::VARCHAR AS organization_id, prior_id::VARCHAR AS prior_id, followup_id::VARCHAR AS followup_id, basis_points::VARCHAR AS basis_points, band, coalesce(suppressed_by, '') AS suppressed_by, '''=' || band AS note FROM scores""")
def candidate_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("organization_id", "prior_id", "followup_id", "basis_points", "band", "suppressed_by", F.concat(F.lit("="), "band").alias("note"))
    return delimited.export_cells(rows)


_COST = """, v AS (SELECT p.organization_id, p.prior_id, p.followup_id, CASE WHEN p.followup_id % 6 = 0 THEN 90 ELSE 30 + p.followup_id % 180 END AS minutes, CASE WHEN f.technician_id IS NULL OR f.technician_id % 5 = 0 THEN {hourly} ELSE (20 + f.technician_id % 40) * 100 END AS rate,
 coalesce((SELECT sum(round(l_extendedprice * 100)::BIGINT) FROM lineitem WHERE l_orderkey = p.followup_id AND l_returnflag = 'R'), 0)::BIGINT AS parts FROM pairs p JOIN jobs f ON f.organization_id = p.organization_id AND f.id = p.followup_id),
cost{n} AS (SELECT *, (((minutes * (rate + 1500 + 100) + 60 * (2500 + 1000 + 99 + parts)) * 2 + 60) // 120)::BIGINT AS total_cents, ((minutes * rate * 2 + 60) // 120)::BIGINT AS labor_cents FROM v)"""


def _costs(spark: SparkSession, sf_dir: str, version: int = 1, hourly: str = "45.50") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs, pairs and their costs under a model."""
    jobs = staged(v.jobs(spark, sf_dir).withColumn("duration_minutes", F.when(F.col("id") % 6 != 0, 30 + F.col("id") % 180)))
    s = F.col("s_suppkey")
    technicians = v.table(spark, sf_dir, "supplier").select(s.alias("id"), F.when(s % 5 != 0, 20 + s % 40).alias("hourly_cost_amount"))
    model = costs.CostModel(version, hourly, "25", "10", "15", custom=(("1", "hour"), ("0.99", "visit")))
    found = staged(pairs.candidate_pairs(jobs))
    return jobs, found, costs.visit_costs(found, jobs, technicians, v.line_items(spark, sf_dir), model)


@query(PAIRS + _COST.format(hourly=4550, n=1) + " SELECT organization_id, prior_id, followup_id, labor_cents, 2500::BIGINT AS dispatch_cents, parts AS parts_cents, total_cents FROM cost1")
def visit_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _costs(spark, sf_dir)[2].select("organization_id", "prior_id", "followup_id", "labor_cents", "dispatch_cents", "parts_cents", "total_cents")


@query(PAIRS + _COST.format(hourly=4550, n=1) + ", w AS (SELECT * REPLACE (CASE WHEN technician_none THEN 9900 ELSE rate END AS rate) FROM (SELECT v.*, f.technician_id IS NULL OR f.technician_id % 5 = 0 AS technician_none FROM v JOIN jobs f ON f.organization_id = v.organization_id AND f.id = followup_id))"
    " SELECT organization_id, prior_id, followup_id, CASE WHEN followup_id % 2 = 0 THEN c.total_cents ELSE (((w.minutes * (w.rate + 1500 + 100) + 60 * (2500 + 1000 + 99 + w.parts)) * 2 + 60) // 120)::BIGINT END AS total_cents FROM cost1 c JOIN w USING (organization_id, prior_id, followup_id)")  # fmt: skip
def cost_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the pairs have a snapshot when the rates change under the same version; these stay."""
    first, again = _costs(spark, sf_dir)[2], _costs(spark, sf_dir, hourly="99")[2]
    return costs.snapshots(first.where("followup_id % 2 = 0"), again).select("organization_id", "prior_id", "followup_id", "total_cents")


@query(PAIRS + _COST.format(hourly=4550, n=1) + """, n AS (SELECT organization_id, count(*) AS jobs_considered FROM jobs GROUP BY 1), r AS (SELECT organization_id, count_if(followup_id % 3 < 2)::BIGINT AS reviewed, count_if(followup_id % 3 = 2)::BIGINT AS pending, count_if(followup_id % 3 = 0)::BIGINT AS confirmed, sum(CASE WHEN followup_id % 3 = 0 THEN total_cents ELSE 0 END)::BIGINT AS cost_cents FROM cost1 GROUP BY 1)
SELECT organization_id, jobs_considered, coalesce(reviewed, 0) AS reviewed, coalesce(pending, 0) AS pending, coalesce(confirmed, 0) AS confirmed, coalesce(cost_cents, 0) AS cost_cents, (coalesce(confirmed, 0) * 10000 // jobs_considered)::BIGINT AS rework_rate FROM n LEFT JOIN r USING (organization_id)""")
def summary_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, found, spent = _costs(spark, sf_dir)
    k = F.col("followup_id") % 3
    told = found.where(k < 2).select("organization_id", "prior_id", "followup_id", F.when(k == 0, "confirmed").otherwise("rejected").alias("decision"))
    return costs.summary(jobs, found, told, spent).select("organization_id", "jobs_considered", "reviewed", "pending", "confirmed", "cost_cents", "rework_rate")


@query(PAIRS + " SELECT p.organization_id, p.prior_id, p.followup_id, p.customer_id, p.equipment_id, p.location_id, p.days_between, 'pending' AS workflow_status FROM pairs p")
def incremental_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that arrive in three batches, a tenth of them with another date and customer first: what is open in the end."""
    jobs, k = staged(v.jobs(spark, sf_dir)), F.col("id")
    arrived = lambda rows, n: rows.withColumn("arrived_at", F.timestamp_seconds(F.lit(n)))
    wrong = {"service_date": F.when(k % 10 == 0, F.date_add("service_date", 40)).otherwise(F.col("service_date")), "started_at": F.when(k % 10 > 0, F.col("started_at")), "customer_id": F.when(k % 10 == 0, F.col("customer_id") + 1).otherwise(F.col("customer_id"))}
    first = jobs.withColumns(wrong)
    store = Snapshots(stage_path(spark, "incremental"), buckets=1)
    used = bucketed(v.line_items(spark, sf_dir).where("kind = 'part'").select("job_id", "kind", "code"), ["job_id"])  # all that signals ask of them, moved once
    for number, rows in enumerate((first.where(k % 3 == 0), first.where(k % 3 == 1), jobs.where((k % 3 == 2) | (k % 10 == 0)))):
        store.arrive(arrived(rows, number), number, v.equipment(spark, sf_dir), used)
    return store.candidates(spark).where("not suppressed").select("organization_id", "prior_id", "followup_id", "customer_id", "equipment_id", "location_id", "days_between", "workflow_status")


@query("WITH r AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source, text ORDER BY doc_id % 3, doc_id) AS n FROM documents) SELECT doc_id, n > 1 AS duplicate FROM r")
def late_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of files (sources) that arrive in three parts: a row is a duplicate of any that came before, in whichever part."""
    docs, seen = v.table(spark, sf_dir, "documents"), Seen(stage_path(spark, "seen"))
    rows = docs.select(F.col("source").alias("batch_id"), F.col("doc_id").alias("row_number"), F.lit("pending").alias("status"), F.create_map(F.lit("text"), "text").alias("raw"), normalize.no_issues().alias("issues"))
    out = None
    for number in range(3):
        part = staged(seen.marked(rows.where(F.col("row_number") % 3 == number), number).select(F.col("row_number").alias("doc_id"), (F.col("status") == "skipped_duplicate").alias("duplicate")))
        out = part if out is None else out.union(part)
    return out
