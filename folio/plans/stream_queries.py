"""Registered queries that run a stream to its end, with restarts from its checkpoint, against the same rows made at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.graph import scratch
from folio.plans.queries import query
from folio.sources import views
from folio.streaming import pairing

#: Parts of time in which events come to the stream; it is started anew for each.
SLICES = 3


@query("""WITH s AS (SELECT user_id AS run_id, event_id, event_type AS stage_name, epoch_us(ts) // 1000 AS began FROM events),
    f AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'failed' WHEN event_id % 5 = 0 THEN 'cached' ELSE 'completed' END AS status, epoch_us(ts) // 1000 + event_id % 9 * 3600000 AS ended FROM events WHERE event_id % 4 < 3),
    w AS (SELECT greatest((SELECT max(began) FROM s), (SELECT max(ended) FROM f)) - 3600000 AS mark),
    j AS (SELECT *, coalesce(ended - began <= 21600000, FALSE) AS kept FROM s LEFT JOIN f USING (event_id))
    SELECT run_id, event_id, stage_name, CASE WHEN kept THEN status ELSE 'lost' END AS status, began AS started_ms, CASE WHEN kept THEN ended END AS finished_ms, CASE WHEN kept THEN ended - began END AS duration_ms
    FROM j, w WHERE kept OR ended IS NOT NULL OR began + 21600000 <= mark""")
def registry_paired_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a stage's start; three of four have a finish, some hours later. Starts without one in six hours are lost."""
    rows = views.table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    key = ["user_id", "event_id", "event_type"]
    status = F.when(F.col("event_id") % 7 == 0, "failed").when(F.col("event_id") % 5 == 0, "cached").otherwise("completed")
    start = rows.select(*key, F.lit(pairing.STARTED).alias("status"), "at")
    finish = rows.where("event_id % 4 < 3").select(*key, status.alias("status"), F.timestamp_millis(F.unix_millis("at") + F.col("event_id") % 9 * 3600000).alias("at"))
    events = start.unionByName(finish).select(F.col("user_id").alias("run_id"), "event_id", F.col("event_type").alias("stage_name"), "status", "at")
    first, last = events.agg(F.min(F.unix_millis("at")), F.max(F.unix_millis("at"))).first()
    folder = scratch(spark, "stages")
    cuts = [] if first is None else [first + (last - first) * k // SLICES for k in range(1, SLICES)]
    ms = F.unix_millis("at")
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        own = events.where((F.lit(True) if low is None else ms >= low) & (F.lit(True) if high is None else ms < high))
        own.write.mode("append").parquet(f"{folder}/events")
        pairing.run(spark, f"{folder}/events", f"{folder}/paired", f"{folder}/checkpoint")
    found = pairing.results(spark, f"{folder}/paired")
    return found.select("run_id", "event_id", "stage_name", "status", F.unix_millis("started_at").alias("started_ms"), F.unix_millis("finished_at").alias("finished_ms"), "duration_ms")
