"""The fourteen signals of a pair: outcome, strength, raw value and explanation, as columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import stripped
from ..sources.tables import bucketed, staged
from . import pairs

M, NM, NE = "matched", "not_matched", "not_evaluable"
STRENGTH = "decimal(5,4)"


@dataclass(frozen=True)
class Rule:
    """A configured signal. ``kind``: additive, multiplier, gate or veto."""

    key: str
    label: str
    weight: str
    kind: str = "additive"
    params: dict[str, Any] = field(default_factory=dict)
    enabled: bool = True


#: The default rule set, in rule order.
DEFAULT_RULES = (
    Rule("same_customer", "Same customer", "20"),
    Rule("same_location", "Same location", "15"),
    Rule("same_equipment", "Same equipment", "30"),
    Rule("days_between", "Days between visits", "25", params={"bands": [[0, 1, "0.70"], [2, 7, "1.00"], [8, 14, "0.80"], [15, 30, "0.50"], [31, 90, "0.25"]]}),
    Rule("same_service_category", "Same service category", "10"),
    Rule("zero_value_followup", "Zero-value follow-up", "25"),
    Rule("low_value_followup", "Low-value follow-up", "10", params={"maximum_ratio": "0.20"}),
    Rule("warranty_marker", "Warranty marker", "25"),
    Rule("within_equipment_warranty", "Within equipment warranty", "10"),
    Rule("same_technician", "Same technician", "5"),
    Rule("repeat_part_code", "Repeated part code", "20"),
    Rule("recurrence_density", "Recurrence density", "10", params={"minimum_visits": 3}),
    Rule("scheduled_maintenance", "Scheduled maintenance", "0", "veto"),
    Rule("planned_multivisit", "Planned multi-visit work", "0", "veto"),
)
#: What the two vetoes look for unless a rule says otherwise.
MAINTENANCE = ("maintenance",)
MULTIVISIT = ("multi-visit", "multivisit")


@dataclass(frozen=True)
class Signal:
    outcome: Column
    strength: Column
    raw: Column
    explanation: Column


def _told(unknown: Column, matched: Column, raw: Column, yes: Column | str, no: str, gap: str, strength: Column | None = None) -> Signal:
    outcome = F.when(unknown, NE).when(matched, M).otherwise(NM)
    full = (F.lit(1) if strength is None else strength).cast(STRENGTH)
    text = F.when(unknown, gap).when(matched, yes if isinstance(yes, Column) else F.lit(yes)).otherwise(no)
    return Signal(outcome, F.when(outcome == M, full).otherwise(F.lit(0).cast(STRENGTH)), raw.cast("string"), text)


def _same(column: str, what: str, more: Callable[[], Column] | None = None) -> Callable[[dict], Signal]:
    def make(params: dict) -> Signal:
        p, f = F.col(f"prior.{column}"), F.col(f"followup.{column}")
        yes = F.lit(f"Both visits have the same {what}.") if more is None else F.concat(F.lit(f"Both visits have the same {what}"), F.coalesce(more(), F.lit("")), F.lit("."))
        return _told(p.isNull() | f.isNull(), p == f, F.when(p == f, f.cast("string")), yes, f"The visits have different {what}s.", f"A {what} is missing.")

    return make


def _days(params: dict) -> Signal:
    gap, strength = F.col("days_between"), F.lit(None).cast(STRENGTH)
    for low, high, value in reversed(params["bands"]):
        strength = F.when(gap.between(low, high), F.lit(value).cast(STRENGTH)).otherwise(strength)
    return _told(gap.isNull(), strength.isNotNull(), gap, F.concat(F.lit("The follow-up came after "), gap.cast("string"), F.lit(" days.")), "The gap is in no band.", "The gap is unknown.", strength)


def _recurring(params: dict) -> Signal:
    n = F.coalesce("visits", F.lit(0))
    return _told(F.lit(False), n >= int(params["minimum_visits"]), n, F.concat(n.cast("string"), F.lit(" related visits lie in the window.")), "Too few related visits lie in the window.", "")


def _zero(params: dict) -> Signal:
    r = F.col("followup.revenue")
    return _told(r.isNull(), r == 0, r, "The follow-up was free of charge.", "The follow-up was charged.", "The follow-up's revenue is missing.")


def _low(params: dict) -> Signal:
    p, f = F.col("prior.revenue"), F.col("followup.revenue")
    limit = F.lit(params["maximum_ratio"]).cast("decimal(5,4)")
    return _told(p.isNull() | f.isNull() | (p <= 0), f < p * limit, F.round(f.cast("double") / F.when(p > 0, p).cast("double"), 4), "The follow-up brought little next to the prior visit.", "The follow-up's revenue is not low.", "Revenues to compare are missing.")


def _warranty(params: dict) -> Signal:
    flag = F.coalesce("followup.is_warranty", F.lit(False))
    return _told(F.lit(False), flag, flag, "The follow-up is marked as warranty work.", "The follow-up has no warranty mark.", "")


def _in_warranty(params: dict) -> Signal:
    until = F.col("warranty_expires_on")
    return _told(F.col("followup.equipment_id").isNull() | until.isNull(), F.col("followup.service_date") <= until, until, "The equipment was under warranty.", "The equipment's warranty had ended.", "The warranty's end is unknown.")


def _parts(params: dict) -> Signal:
    p, f = (F.coalesce(c, F.array().cast("array<string>")) for c in ("prior_codes", "followup_codes"))
    both = F.array_sort(F.array_intersect(p, f))
    return _told((F.size(p) == 0) | (F.size(f) == 0), F.size(both) > 0, F.array_join(both, ","), F.concat(F.lit("Parts used again: "), F.array_join(F.slice(both, 1, 3), ", "), F.lit(".")), "No part was used again.", "Part codes are missing.")


def _maintenance(params: dict) -> Signal:
    wanted = [x.strip().lower() for x in params.get("categories", MAINTENANCE)]
    c = F.lower(stripped(F.col("followup.raw_category")))
    return _told(c.isNull() | (c == ""), c.isin(*wanted), c, "The follow-up is scheduled maintenance.", "The follow-up is no maintenance.", "The follow-up's category is missing.")


def _planned(params: dict) -> Signal:
    markers = F.array(*(F.lit(x.strip().lower()) for x in params.get("markers", MULTIVISIT)))
    texts = F.concat(F.array("prior.raw_job_type"), F.coalesce(F.map_values("prior.extra_fields"), F.array().cast("array<string>")))
    texts = F.filter(texts, lambda t: t.isNotNull() & (stripped(t) != ""))
    hits = F.filter(texts, lambda t: F.exists(markers, lambda m: F.contains(F.lower(t), m)))
    return _told(F.size(texts) == 0, F.size(hits) > 0, F.get(hits, F.lit(0)), "The prior visit is part of planned work.", "The prior visit is not planned as one of several.", "Nothing says whether more visits were planned.")


REGISTRY: dict[str, Callable[[dict], Signal]] = {
    "same_customer": _same("customer_id", "customer"),
    "same_location": _same("location_id", "location"),
    "same_equipment": _same("equipment_id", "equipment", lambda: F.concat(F.lit(", serial ending "), F.substring("equipment_serial", -4, 4))),
    "days_between": _days,
    "same_service_category": _same("category_id", "service category"),
    "zero_value_followup": _zero,
    "low_value_followup": _low,
    "warranty_marker": _warranty,
    "within_equipment_warranty": _in_warranty,
    "same_technician": _same("technician_id", "technician"),
    "repeat_part_code": _parts,
    "recurrence_density": _recurring,
    "scheduled_maintenance": _maintenance,
    "planned_multivisit": _planned,
}


def checked(rules: tuple[Rule, ...]) -> tuple[Rule, ...]:
    """The enabled rules; ValueError where keys, weights or parameters make no sense."""
    on = tuple(r for r in rules if r.enabled)
    if not on:
        raise ValueError("a rule set needs a rule")
    keys = [r.key for r in on]
    if len(set(keys)) < len(keys):
        raise ValueError("a signal has two rules")
    if set(keys) - set(REGISTRY):
        raise ValueError(f"no such signal: {sorted(set(keys) - set(REGISTRY))}")
    for r in on:
        if r.kind not in ("additive", "multiplier", "gate", "veto") or float(r.weight) < 0:
            raise ValueError(f"{r.key}: kind or weight")
        bands = r.params.get("bands")
        if r.key == "days_between" and not (bands and all(len(b) == 3 and 0 <= b[0] <= b[1] and 0 <= float(b[2]) <= 1 for b in bands)):
            raise ValueError("days_between: bands are [from, to, strength]")
        if r.key == "low_value_followup" and not 0 <= float(r.params.get("maximum_ratio", -1)) <= 1:
            raise ValueError("low_value_followup: maximum_ratio is 0 to 1")
        if r.key == "recurrence_density" and int(r.params.get("minimum_visits", 0)) < 1:
            raise ValueError("recurrence_density: minimum_visits is 1 at least")
        for name in ("categories", "markers"):
            if any(not str(x).strip() for x in r.params.get(name, ())):
                raise ValueError(f"{r.key}: {name} can't be blank")
    return on


def job_facts(jobs: DataFrame, line_items: DataFrame | None, window: int = 30, wanted: DataFrame | None = None) -> DataFrame:
    """(organization_id, id, job, visits, codes): what a pair is judged by, once for each job, kept in buckets of (tenant, id).

    Recurrence and part codes are made once per job and travel with it. ``wanted`` has the (organization_id, id) to be
    judged: visits of others are counted, but no other job or line item goes further.
    """
    columns = ["customer_id", "location_id", "equipment_id", "technician_id", "category_id", "service_date", "revenue", "is_warranty", "raw_category", "raw_job_type", "extra_fields"]
    have = jobs if "extra_fields" in jobs.columns else jobs.withColumn("extra_fields", F.lit(None).cast("map<string,string>"))
    keys = ["organization_id", "id"]
    only = (lambda rows: rows) if wanted is None else (lambda rows: rows.join(wanted, keys, "left_semi"))
    rows = only(have).select(*keys, F.struct("id", *columns).alias("job")).join(pairs.recurrence(jobs, window, wanted), keys, "left")
    if line_items is None:
        return bucketed(rows.withColumn("codes", F.lit(None).cast("array<string>")), keys)
    ids = (jobs if wanted is None else wanted).select(*keys)
    used = line_items if wanted is None else line_items.join(wanted.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    known = ids.join(pairs.part_codes(used).withColumnRenamed("job_id", "id"), "id")  # few and narrow; the jobs stay where they are
    return bucketed(rows.join(known, keys, "left"), keys)


def pair_context(found: DataFrame, jobs: DataFrame, equipment: DataFrame | None, line_items: DataFrame | None, window: int = 30) -> DataFrame:
    """Pairs with both jobs (structs prior and followup), recurrence, part codes and the equipment's warranty.

    Jobs lie in buckets of (tenant, id), so neither of the two joins moves them: pairs go to their jobs. Only jobs that
    are in a pair lie there. ``found`` is read several times: give it as a written table.
    """
    wanted = staged(found.select("organization_id", F.explode(F.array("prior_id", "followup_id")).alias("id")).distinct())
    rows = job_facts(jobs, line_items, window, wanted)
    prior = rows.select("organization_id", F.col("id").alias("prior_id"), F.col("job").alias("prior"), "visits", F.col("codes").alias("prior_codes"))
    followup = rows.select("organization_id", F.col("id").alias("followup_id"), F.col("job").alias("followup"), F.col("codes").alias("followup_codes"))
    keys = found.select("organization_id", "prior_id", "followup_id", "days_between")
    out = keys.join(prior, ["organization_id", "prior_id"]).join(followup, ["organization_id", "followup_id"])
    if equipment is None:
        return out.withColumns({"warranty_expires_on": F.lit(None).cast("date"), "equipment_serial": F.lit(None).cast("string")})
    known = equipment.select(F.col("id").alias("_equipment"), "warranty_expires_on", F.col("serial_number").alias("equipment_serial"))
    return out.join(known, F.col("followup.equipment_id") == F.col("_equipment"), "left").drop("_equipment")


def evaluated(context: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """(organization_id, prior_id, followup_id, signals): an array with a struct for each rule, in rule order."""
    out = []
    for i, r in enumerate(checked(rules)):
        s = REGISTRY[r.key](r.params)
        weight = F.lit(r.weight).cast("decimal(8,2)")
        counts = F.lit(r.kind == "additive") & (s.outcome == M)
        contribution = F.when(counts, F.round(weight * s.strength, 2)).otherwise(0).cast("decimal(8,2)")
        out.append(F.struct(F.lit(r.key).alias("key"), F.lit(r.label).alias("label"), F.lit(r.kind).alias("kind"), F.lit(i).alias("position"), s.outcome.alias("outcome"), s.strength.alias("strength"), s.raw.alias("raw_value"), weight.alias("weight"), contribution.alias("contribution"), s.explanation.alias("explanation")))
    # As a concat: Spark writes a bare array out again at each of its uses, and scoring has many.
    return context.select("organization_id", "prior_id", "followup_id", F.concat(F.array(*out)).alias("signals"))
