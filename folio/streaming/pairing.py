"""Starts and finishes of stages paired as they stream, with runs that never finish closed by a timer."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from folio.sources.artifacts import read_or_empty

EVENT = "run_id long, event_id long, stage_name string, status string, at timestamp"
PAIRED = "run_id long, event_id long, stage_name string, status string, started_at timestamp, finished_at timestamp, duration_ms long"
STARTED, LOST = "started", "lost"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Events are dealt by a hash into so many keys of state; a key's open events are read and written together, once a batch. A checkpoint holds on to it.
BUCKETS = 4096


class PairStages(StatefulProcessor):
    """For each event of a run: its start and its finish, whichever comes first; both make a result and leave the state.

    A start without a finish within ``limit_ms`` is closed as lost by a timer on event time, or at once where a finish comes that
    is later than that. A finish without a start waits as long for one, and goes then. What comes again after that is a new event.
    The state of a bucket is the list of its open events; its timer stands at the first of their ends.
    """

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "run_id long, event_id long, stage_name string, began_ms long, status string, ended_ms long")

    def _result(self, event: tuple[int, int], stage: str, began: int, status: str | None, ended: int | None) -> Row:
        kept = ended is not None and ended - began <= self.limit_ms
        values = (status, ended, ended - began) if kept else (LOST, None, None)
        return Row(run_id=event[0], event_id=event[1], stage_name=stage, status=values[0], started_ms=began, finished_ms=values[1], duration_ms=values[2])

    def _end(self, began: int | None, ended: int | None) -> int:
        return (ended if began is None else began) + self.limit_ms

    def _read(self) -> dict[tuple[int, int], tuple]:
        return {(r[0], r[1]): tuple(r[2:]) for r in self.open.get()}

    def _keep(self, events: dict[tuple[int, int], tuple]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if events:
            self.open.put([(*event, *known) for event, known in events.items()])
            self.handle.registerTimer(min(self._end(began, ended) for _, began, _, ended in events.values()))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        events = self._read()
        for row in rows:
            event = (row.run_id, row.event_id)
            stage, began, status, ended = events.get(event, (None, None, None, None))
            if row.status == STARTED:
                if began is None:
                    stage, began = row.stage_name, row.at_ms
            elif ended is None or row.at_ms < ended:
                status, ended = row.status, row.at_ms
            events[event] = (stage, began, status, ended)
        waiting = {}
        for event, known in events.items():
            if known[1] is not None and known[3] is not None:
                yield self._result(event, *known)
            else:
                waiting[event] = known
        self._keep(waiting)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # All that end before the watermark go with the first of them.
        last = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        waiting = {}
        for event, (stage, began, status, ended) in self._read().items():
            if self._end(began, ended) > last:
                waiting[event] = (stage, began, status, ended)
            elif began is not None:
                yield self._result(event, stage, began, None, None)
        self._keep(waiting)

    def close(self) -> None:
        pass


_OUT = "run_id long, event_id long, stage_name string, status string, started_ms long, finished_ms long, duration_ms long"


def paired(events: DataFrame, limit: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """PAIRED rows of a stream of EVENT rows (a start has the status ``started``), each once. Events behind the watermark are dropped."""
    spark = events.sparkSession
    limit_ms = int(spark.range(1).select((F.expr(f"timestamp_millis(0) + INTERVAL {limit}").cast("double") * 1000).cast("long")).first()[0])
    rows = events.withWatermark("at", late).select("run_id", "event_id", "stage_name", "status", "at", F.unix_millis("at").alias("at_ms"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("run_id", "event_id"), F.lit(BUCKETS)))
    found = rows.groupBy("bucket").transformWithState(PairStages(limit_ms), _OUT, "Append", "EventTime")
    return found.select("run_id", "event_id", "stage_name", "status", F.timestamp_millis("started_ms").alias("started_at"), F.timestamp_millis("finished_ms").alias("finished_at"), "duration_ms")


def write_batch(path: str):
    """A batch's rows go to a folder of the batch's number, so a batch that is run again after a failure replaces itself."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run(spark: SparkSession, source: str, sink: str, checkpoint: str, limit: str = "6 hours", late: str = "1 hour", files_per_trigger: int = 64) -> StreamingQuery:
    """Pairs the events that lie in ``source`` (Parquet files of EVENT rows) since the checkpoint, and ends. State is kept in RocksDB."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
        query = paired(events, limit, late).writeStream.foreachBatch(write_batch(sink)).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    query.awaitTermination()
    return query


def results(spark: SparkSession, sink: str) -> DataFrame:
    return read_or_empty(spark, sink, f"{PAIRED}, batch long").drop("batch")
