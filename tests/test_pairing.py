"""Pairing starts and finishes in a stream: order, timers, restarts, batches written twice."""

from datetime import datetime, timedelta

import pytest

from folio.streaming import pairing


def at(hours):
    return datetime(2024, 1, 1) + timedelta(hours=hours)


@pytest.fixture
def stream(spark, tmp_path):
    folder = f"file://{tmp_path}"

    def feed(*rows):
        spark.createDataFrame([(r[0], r[1], "s", r[2], at(r[3])) for r in rows], pairing.EVENT).write.mode("append").parquet(f"{folder}/in")
        pairing.run(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint")
        found = pairing.results(spark, f"{folder}/out").collect()
        return sorted((r["event_id"], r["status"], r["duration_ms"] and r["duration_ms"] // 3_600_000) for r in found)

    return feed


def test_over_restarts(stream):
    assert stream((1, 1, "started", 0), (1, 2, "started", 1), (2, 3, "completed", 3.9), (1, 4, "started", 3), (1, 4, "failed", 4), (1, 4, "started", 3)) == [(4, "failed", 1)]
    two = [(1, "completed", 5), (3, "completed", 0), (4, "failed", 1)]
    assert stream((1, 1, "completed", 5), (2, 3, "started", 3.2)) == two
    # The watermark passes what event 2 may take; its finish comes too late, that of event 5 says so itself.
    assert stream((1, 5, "started", 20), (1, 5, "completed", 29)) == [*two[:1], (2, "lost", None), *two[1:], (5, "lost", None)]
    assert (2, "lost", None) in stream((1, 2, "completed", 30)) and len(stream((9, 9, "completed", 60))) == 5


def test_a_batch_that_runs_twice_is_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "s", "lost", at(0), None, None)], pairing.PAIRED)
    write = pairing.write_batch(str(tmp_path))
    for batch in (0, 1, 1):
        write(rows, batch)
    assert pairing.results(spark, str(tmp_path)).count() == 2


def test_nothing_yet(spark, tmp_path):
    assert pairing.results(spark, f"{tmp_path}/none").count() == 0


def test_events_of_one_bucket(stream, monkeypatch):
    """Open events of one key of state end each in its time: some by the timer of the first, others later."""
    monkeypatch.setattr(pairing, "BUCKETS", 1)
    assert stream(*((1, k, "started", k) for k in range(5)), (1, 5, "completed", 0), (2, 0, "failed", 1)) == []
    assert stream((1, 6, "started", 9.5)) == [(0, "lost", None), (1, "lost", None), (2, "lost", None)]
    assert stream((1, 4, "completed", 9), (1, 3, "cached", 9.25)) == [(0, "lost", None), (1, "lost", None), (2, "lost", None), (3, "lost", None), (4, "completed", 5)]
