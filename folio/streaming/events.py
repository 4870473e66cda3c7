"""Stage events as a stream: counts per window, sessions of runs, alerts on failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def window_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, stage_name, n, total: tumbling windows; state older than the watermark goes."""
    rows = events.withWatermark("finished_at", late).groupBy(F.window("finished_at", size).alias("w"), "stage_name")
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "stage_name", "n", "total")


def run_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """run_id, start, finish, n: a run's events with no longer pause than the gap."""
    rows = events.withWatermark("finished_at", late).groupBy(F.session_window("finished_at", gap).alias("s"), "run_id")
    return rows.agg(F.count("*").alias("n")).select("run_id", F.col("s.start").alias("start"), F.col("s.end").alias("finish"), "n")


def failures(events: DataFrame) -> DataFrame:
    return events.where("status = 'failed'")
