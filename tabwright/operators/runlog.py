"""Analytics over run logs: status, progress, metrics, one row per run.

Logs are append-only (run_id, ts, event_id, stage, status, event fields); one
run may hold most of the log, so every operator combines map-side and none
windows over a run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.columns import col, count_where


def _lookup(stage: Column, default: int) -> Column:
    table = F.create_map(*[x for k, v in fv.STAGE_PROGRESS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(table[stage], F.lit(default))


def run_latest_status(log: DataFrame, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """(run_id, stage, status, n_events): the latest entry of every run."""
    at = F.struct(*[col(c) for c in order])
    return (
        log.groupBy("run_id")
        .agg(F.max_by(F.struct("stage", "status"), at).alias("last"), F.count("*").alias("n_events"))
        .select("run_id", "last.stage", "last.status", "n_events")
    )


def stage_progress(latest: DataFrame) -> DataFrame:
    """Add `progress_pct`; finished and failed runs show 100."""
    pct = (
        F.when(F.col("status").isin("completed", "failed"), 100)
        .when(F.col("status") == "running", _lookup(F.col("stage"), 50))
        .otherwise(_lookup(F.col("stage"), 0))
    )
    return latest.withColumn("progress_pct", pct)


def stage_states(latest: DataFrame) -> DataFrame:
    """(run_id, stage, state) for every stage: earlier done, current by status, later pending."""
    stages = F.array(*[F.lit(s) for s in fv.STAGES])
    now = F.array_position(stages, F.col("stage"))
    state = (
        F.when(F.col("now") == 0, "unknown")
        .when(F.col("at") + 1 < F.col("now"), "completed")
        .when(F.col("at") + 1 > F.col("now"), "pending")
        .when(F.col("status") == "completed", "completed")
        .when(F.col("status") == "failed", "failed")
        .otherwise("running")
    )
    return (
        latest.withColumn("now", now)
        .select("run_id", "status", "now", F.posexplode(stages).alias("at", "stage_name"))
        .select("run_id", F.col("stage_name").alias("stage"), state.alias("state"))
    )


def list_runs(log: DataFrame) -> DataFrame:
    return log.select("run_id").distinct().orderBy("run_id")


def run_metric_summary(log: DataFrame, value: str = "value") -> DataFrame:
    """(run_id, validation_pct, rows_changed, best_metric, events, errors) by conditional aggregates."""
    v, stage = col(value), F.col("stage")
    return log.groupBy("run_id").agg(
        F.count("*").alias("events"),
        count_where(F.col("status") == "failed").alias("errors"),
        (count_where((stage == "validation") & (v >= 50)) * 100.0 / F.nullif(count_where(stage == "validation"), F.lit(0))).alias("validation_pct"),
        F.sum(F.when(stage == "prep", v)).alias("rows_changed"),
        F.max(F.when(stage == "automl", v)).alias("best_metric"),
    )


def run_results_rollup(parts: Sequence[DataFrame]) -> DataFrame:
    """One row per run from per-run report tables (each one row per run_id)."""
    result = parts[0]
    for p in parts[1:]:
        result = result.join(p, "run_id", "left")
    return result
