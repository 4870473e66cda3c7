"""Runs, stage events and artifact versions as append-only tables with latest views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], written_at: str, tie: str) -> DataFrame:
    """The newest row of each key; equal times go to the larger tie-break. One grouped aggregate with partial maxima, no sort of a key's versions."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(written_at, tie)).alias("r"))
    return newest.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def cache_lookup(events: DataFrame) -> DataFrame:
    """cache_key with its newest completed event (a cached one is not taken)."""
    done = events.where("status = 'completed'").select("cache_key", "finished_at", "event_id")
    return latest(done, ["cache_key"], "finished_at", "event_id")


def run_summary(events: DataFrame) -> DataFrame:
    """Per run: events, stages completed (status completed only), failures, first and last time, last stage and its status."""
    return events.groupBy("run_id").agg(
        F.count("*").alias("n_events"),
        F.count_distinct(F.when(F.col("status") == "completed", F.col("stage_name"))).alias("stages_completed"),
        F.count_if(F.col("status") == "failed").alias("failures"),
        F.min("finished_at").alias("started_at"),
        F.max("finished_at").alias("finished_at"),
        F.max_by("stage_name", F.struct("finished_at", "event_id")).alias("last_stage"),
        F.max_by("status", F.struct("finished_at", "event_id")).alias("last_status"),
    )


def run_listing(events: DataFrame, limit: int = 20) -> DataFrame:
    """The newest runs first; the limit is the listing's."""
    runs = events.groupBy("run_id").agg(F.max("finished_at").alias("finished_at"), F.count("*").alias("n_events"))
    return runs.orderBy(F.desc("finished_at"), "run_id").limit(limit)


def stage_listing(events: DataFrame) -> DataFrame:
    """Events of each run in order, with their number and the seconds since the one before."""
    w = Window.partitionBy("run_id").orderBy("finished_at", "event_id")
    gap = F.col("finished_at").cast("timestamp").cast("long") - F.lag("finished_at").over(w).cast("timestamp").cast("long")
    return events.select("run_id", "event_id", "stage_name", "status", F.row_number().over(w).alias("nth"), gap.alias("gap_s"))


def passing_streaks(events: DataFrame) -> DataFrame:
    """Per run, the number of events before the first failure."""
    w = Window.partitionBy("run_id").orderBy("finished_at", "event_id")
    rows = events.select("run_id", F.min((F.col("status") != "failed").cast("int")).over(w).alias("good"))
    return rows.groupBy("run_id").agg(F.sum("good").alias("streak"))


def run_manifest(events: DataFrame) -> DataFrame:
    """run_id, nth, stage: a run's events in order, a row each, so that a long run is no large cell."""
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("finished_at", "event_id"))
    return events.select("run_id", nth.alias("nth"), F.concat_ws(":", "stage_name", "status").alias("stage"))


def first_result(events: DataFrame, stage: str) -> DataFrame:
    """Per run, the first completed or cached event of a stage."""
    hit = events.where((F.col("stage_name") == stage) & F.col("status").isin("completed", "cached"))
    return hit.groupBy("run_id").agg(F.min("event_id").alias("event_id"))


def nearest_raster(rasters: DataFrame, target_dpi: int) -> DataFrame:
    """page_id with the raster (dpi, path) at the target, else the nearest, the lower one on ties; rasters without dpi come last."""
    rank = F.struct(F.coalesce(F.abs(F.col("dpi") - target_dpi), F.lit(2**31 - 1)).alias("d"), F.col("dpi"), F.col("path"))
    best = rasters.groupBy("page_id").agg(F.min(rank).alias("r"))
    return best.select("page_id", F.col("r.dpi").alias("dpi"), F.col("r.path").alias("path"))


def with_provenance(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """runs (run_id, with columns of their own) with the newest value of each column that updates (run_id, recorded_at, the same columns) set; nulls leave what is there."""
    names = [c for c in updates.columns if c not in ("run_id", "recorded_at")]
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("recorded_at"))).alias(f"new_{c}") for c in names]
    rows = runs.join(updates.groupBy("run_id").agg(*newest), "run_id", "left")
    return rows.withColumns({c: F.coalesce(f"new_{c}", c) if c in runs.columns else F.col(f"new_{c}") for c in names}).drop(*[f"new_{c}" for c in names])


def render_results(events: DataFrame) -> DataFrame:
    """run_id, artifact_ref of each run's first render that was completed or cached; a run without one, or whose result has no reference, is left out."""
    hit = events.where((F.col("stage_name") == "render") & F.col("status").isin("completed", "cached"))
    first = hit.groupBy("run_id").agg(F.min_by(F.struct("artifact_ref"), F.struct("finished_at", "event_id")).alias("r"))
    return first.where(F.coalesce("r.artifact_ref", F.lit("")) != "").select("run_id", "r.artifact_ref")
