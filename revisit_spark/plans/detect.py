"""A detection run: scope, pairs, snapshot, signals, scores, counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import candidates, pairs, scoring, signals
from ..sources.tables import staged


@dataclass(frozen=True)
class Run:
    """What a run leaves: the snapshot, this run's scored pairs (with evidence arrays) and one row of counters."""

    snapshot: DataFrame
    scored: DataFrame
    counters: DataFrame


def detect(jobs: DataFrame, equipment: DataFrame | None = None, line_items: DataFrame | None = None, old: DataFrame | None = None, run_id: str = "run-1", window: int = 30, cap: int = 25, rules: tuple[signals.Rule, ...] = signals.DEFAULT_RULES, date_from: str | None = None, date_to: str | None = None) -> Run:
    """Pairs of the scope are created or refreshed, pairs of the scope that no longer hold are suppressed
    and not rescored, and the pairs found are evaluated and scored.

    Pairs, snapshot and scores are each worked out once and written; counters are counted on what is written (two
    columns of it), so they are exact also where tasks ran twice. A caller keeps results by writing them
    under the run's id, which makes a rerun idempotent.
    """
    found = staged(pairs.candidate_pairs(jobs, window, cap, date_from, date_to))
    merged = candidates.upserted(old, found, run_id)
    scope = pairs.visits(jobs, date_from, date_to, window)
    snapshot = staged(candidates.out_of_window(merged, scope, run_id))
    context = signals.pair_context(found, jobs, equipment, line_items, window)
    scored = staged(scoring.scored(signals.evaluated(context, rules), rules).withColumn("run_id", F.lit(run_id)))
    changes = snapshot.agg(F.count_if(F.col("change") == "created").alias("created"), F.count_if(F.col("change") == "updated").alias("updated"), F.count_if(F.col("change") == "suppressed").alias("out_of_window"))
    vetoed = scored.agg(F.count("*").alias("scored"), F.count_if(F.col("suppressed_by").isNotNull()).alias("vetoed"))
    one = F.lit(1).alias("_one")  # two single rows
    counters = changes.select("*", one).join(vetoed.select("*", one), "_one").select((F.col("created") + F.col("updated")).alias("pairs"), "created", "updated", (F.col("out_of_window") + F.col("vetoed")).alias("suppressed"), "scored")
    return Run(snapshot, scored, counters)
