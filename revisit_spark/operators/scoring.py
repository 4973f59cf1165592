"""Scores of evaluated pairs, in whole numbers so that they are exact.

Weights are in hundredths and strengths in ten-thousandths; a sum of weight x strength is in
millionths. Each multiplier adds a factor of 100 to both sides of the quotient.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .signals import DEFAULT_RULES, NE, M, Rule, checked

HIGH, MEDIUM, SURFACE = 75, 50, 40


def _total(signals: Column, value) -> Column:
    return F.aggregate(signals, F.lit(0).cast("long"), lambda total, s: total + value(s))


def scored(evaluated: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, least: int = SURFACE) -> DataFrame:
    """Adds raw_cents, basis_points (0..10000), band, suppressed_by, gates_passed and surfaced.

    Raw: contributions of matched additive signals times weights of matched multipliers. Normalized: raw
    over all evaluable additive weights. A matched veto, the first in rule order, suppresses the pair
    and zeroes it. A gate only decides whether a pair is surfaced.
    """
    factors = sum(r.kind == "multiplier" for r in checked(rules))
    if factors > 3:
        raise ValueError("three multipliers at most")
    unit = 100**factors
    signals = F.col("signals")
    hundredths = lambda s: (s["weight"] * 100).cast("long")
    of = lambda kind: F.filter(signals, lambda s: s["kind"] == kind)
    raw = _total(of("additive"), lambda s: F.when(s["outcome"] == M, hundredths(s) * (s["strength"] * 10000).cast("long")).otherwise(0))
    raw = raw * F.aggregate(of("multiplier"), F.lit(1).cast("long"), lambda x, s: x * F.when(s["outcome"] == M, hundredths(s)).otherwise(100))
    most = _total(of("additive"), lambda s: F.when(s["outcome"] != NE, hundredths(s) * 10000).otherwise(0)) * unit
    veto = F.get(F.filter(of("veto"), lambda s: s["outcome"] == M), F.lit(0))["key"]
    gates = F.forall(of("gate"), lambda s: (s["outcome"] == NE) | (s["outcome"] == M))
    rows = evaluated.withColumns({"_raw": raw, "_most": most, "suppressed_by": veto, "gates_passed": gates})
    none = F.col("suppressed_by").isNotNull() | (F.col("_most") == 0)
    # In two steps so that products stay far below 2**63.
    points = F.expr("(_raw * 2 * 10000 + _most) div nullif(2 * _most, 0)")
    cents = F.expr(f"(_raw * 2 + {10_000 * unit}) div {20_000 * unit}")
    band = F.when(none, "low").when(F.col("_raw") * 100 >= F.col("_most") * HIGH, "high").when(F.col("_raw") * 100 >= F.col("_most") * MEDIUM, "medium").otherwise("low")
    out = rows.withColumns({"raw_cents": F.when(F.col("suppressed_by").isNotNull(), 0).otherwise(cents).cast("long"), "basis_points": F.when(none, 0).otherwise(F.least(points, F.lit(10_000))).cast("long"), "band": band})
    shown = F.col("suppressed_by").isNull() & F.col("gates_passed") & (F.col("basis_points") >= least * 100)
    return out.withColumn("surfaced", shown).drop("_raw", "_most")


def evidence(evaluated: DataFrame) -> DataFrame:
    """One row for each signal of each pair, with its rank by contribution (then key) among the pair's.

    The rank comes from sorting the pair's own array: no shuffle.
    """
    order = F.array_sort(F.transform("signals", lambda s: F.struct((-s["contribution"]).alias("down"), s["key"].alias("key"), s.alias("s"))))
    each = evaluated.select("organization_id", "prior_id", "followup_id", F.posexplode(order).alias("at", "e"))
    return each.select("organization_id", "prior_id", "followup_id", (F.col("at") + 1).alias("rank"), "e.s.*")


def current_evidence(stored: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Of the stored evidence of all runs, what belongs to each candidate's current run."""
    return stored.join(snapshot.select("organization_id", "prior_id", "followup_id", "run_id"), ["organization_id", "prior_id", "followup_id", "run_id"], "left_semi")


def merged(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of runs with those of a run put in: what is there under the same keys is replaced, so reruns agree.

    Keys are pair, run and signal for evidence; pair and run for the score history.
    """
    return new if old is None else old.join(new.select(*keys), keys, "left_anti").unionByName(new)
