"""Stages by the content of their inputs, whole and page by page."""

import pytest
from pyspark.sql import functions as F

from folio.plans import build, stages


def counting(calls, name="double", version="1"):
    def run(tables):
        calls.append(sorted(r["page_id"] for r in tables["src"].select("page_id").distinct().collect()))
        return tables["src"].withColumn("v", F.col("v") * 2)

    return stages.PageStage(name, version, ["src"], run)


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id string, v int")


def test_hash_of_rows_not_of_their_order(spark):
    df = spark.createDataFrame([(1, "a", {"x": 1, "y": 2}), (2, None, None), (2, None, None)], "id int, t string, m map<string,int>")
    same = spark.createDataFrame([(None, 2, None), ("a", 1, {"y": 2, "x": 1}), (None, 2, None)], "t string, id int, m map<string,int>")
    assert stages.content_hash(df) == stages.content_hash(df.repartition(3)) == stages.content_hash(same)
    others = [df.where("id = 1"), df.dropDuplicates(["id"]), df.withColumn("t", F.lit("a")), df.withColumnRenamed("t", "u"), df.withColumn("id", F.col("id").cast("long")), df.withColumn("t", F.coalesce("t", F.lit("")))]
    assert len({stages.content_hash(d) for d in [df, *others]}) == 7


def test_a_changed_row_gives_a_changed_table(spark, tmp_path):
    run = lambda v, pages=(): stages.Runner(spark, str(tmp_path), pages=pages)
    stage = lambda v: stages.Stage("one", "1", lambda s, t: v.withColumn("w", F.col("v") % 2), [v])
    after = stages.Stage("two", "1", lambda s, t: t["one"].select("page_id", "w"))
    statuses = []
    for rows, want in (([("p", 1)], 1), ([("p", 2)], 0), ([("p", 1)], 1), ([("p", 3)], 1)):
        runner = run(1)
        assert runner.run([stage(table(spark, rows)), after])["two"].first()["w"] == want
        statuses.append([e[2] for e in runner.events])
    assert statuses == [["completed", "completed"], ["completed", "completed"], ["cached", "cached"], ["completed", "completed"]]
    filtered = run(1, ["p0001"])
    filtered.run([stage(table(spark, [("p", 1)])), after])
    assert [e[2] for e in filtered.events] == ["completed", "completed"]


def test_same_result_lets_later_stages_be(spark, tmp_path):
    first = lambda v: stages.Stage("one", v, lambda s, t: s.range(3))
    second = stages.Stage("two", "1", lambda s, t: t["one"].where("id > 0"))
    runner = stages.Runner(spark, str(tmp_path))
    runner.run([first("1"), second])
    runner.run([first("2"), second])
    assert [e[2] for e in runner.events] == ["completed", "completed", "completed", "cached"]


def test_a_failure_is_recorded(spark, tmp_path):
    runner = stages.Runner(spark, str(tmp_path))
    bad = stages.Stage("bad", "1", lambda s, t: s.range(1).select(F.raise_error(F.lit("broken")).alias("x")))
    for _ in range(2):  # and is not taken for done
        with pytest.raises(stages.StageError):
            runner.run([bad])
    assert [(e[0], e[2]) for e in runner.events] == [("bad", "failed")] * 2 and "broken" in runner.event_table().first()["error_message"]


def test_only_changed_pages_are_made_again(spark, tmp_path):
    calls = []
    stage = counting(calls)
    runner = stages.PageRunner(spark, str(tmp_path))
    go = lambda rows, version="1": sorted(map(tuple, runner.run({"src": table(spark, rows)}, [counting(calls, version=version)])["double"].collect()))
    assert stage.name == "double" and go([("p1", 1), ("p1", 2), ("p2", 3), (None, 9)]) == [("p1", 2), ("p1", 4), ("p2", 6)]
    assert go([("p2", 3), ("p1", 2), ("p1", 1)]) == [("p1", 2), ("p1", 4), ("p2", 6)]
    assert go([("p1", 1), ("p1", 2), ("p2", 4), ("p3", 5)]) == [("p1", 2), ("p1", 4), ("p2", 8), ("p3", 10)]
    assert go([("p1", 1), ("p2", 4)]) == [("p1", 2), ("p2", 8)]
    assert go([("p1", 1), ("p2", 4), ("p3", 5)]) == [("p1", 2), ("p2", 8), ("p3", 10)]
    assert go([("p2", 4), ("p3", 5)], "2") == [("p2", 8), ("p3", 10)]
    assert calls == [["p1", "p2"], ["p2", "p3"], ["p1"], ["p3"], ["p2", "p3"]]
    assert [e[1:] for e in runner.events] == [(2, 0, 0), (0, 2, 0), (2, 1, 0), (1, 1, 1), (1, 2, 0), (2, 0, 1)]


def test_a_page_that_comes_out_the_same_stops_there(spark, tmp_path):
    parity = stages.PageStage("parity", "1", ["src"], lambda t: t["src"].select("page_id", (F.col("v") % 2).alias("v")))
    names = spark.createDataFrame([(0, "even"), (1, "odd")], "v int, name string")
    named = lambda n: stages.PageStage("named", "1", ["parity"], lambda t: t["parity"].join(n, "v"), [n])
    runner = stages.PageRunner(spark, str(tmp_path))
    runner.run({"src": table(spark, [("p1", 1), ("p2", 2)])}, [parity, named(names)])
    out = runner.run({"src": table(spark, [("p1", 3), ("p2", 5)])}, [parity, named(names)])["named"]
    assert sorted((r["page_id"], r["name"]) for r in out.collect()) == [("p1", "odd"), ("p2", "odd")]
    assert [e[1] for e in runner.events] == [2, 2, 2, 1]
    runner.run({"src": table(spark, [("p1", 3), ("p2", 5)])}, [parity, named(names.replace("odd", "uneven"))])
    assert [e[1] for e in runner.events[4:]] == [0, 2]  # a shared table changes all pages


def test_rows_of_a_lost_run_are_not_read(spark, tmp_path):
    runner = stages.PageRunner(spark, str(tmp_path))
    stage = counting([])
    runner.run({"src": table(spark, [("p1", 1)])}, [stage])
    table(spark, [("p1", 77)]).write.parquet(f"{tmp_path}/double/rows/generation=2")
    assert [tuple(r) for r in runner.run({"src": table(spark, [("p1", 1)])}, [stage])["double"].collect()] == [("p1", 2)]
    assert [tuple(r) for r in runner.run({"src": table(spark, [("p1", 4)])}, [stage])["double"].collect()] == [("p1", 8)]


def test_page_build_equals_a_fresh_one(spark, tmp_path):
    rows = [(f"p{k}", f"p{k}.b{i}", i, "heading" if i == 0 else "paragraph", f"Text {k} {i} AB1234 end") for k in range(6) for i in range(4)]
    schema = "page_id string, block_id string, pos int, kind string, text string"
    old, new = spark.createDataFrame(rows, schema), spark.createDataFrame([(*r[:4], r[4] + "!") if r[0] == "p3" else r for r in rows], schema)
    runner = stages.PageRunner(spark, str(tmp_path / "a"))
    runner.run({"blocks": old}, build.page_build())
    after = runner.run({"blocks": new}, build.page_build())
    fresh = stages.PageRunner(spark, str(tmp_path / "b")).run({"blocks": new}, build.page_build())
    for name in fresh:
        assert sorted(map(str, after[name].collect())) == sorted(map(str, fresh[name].collect()))
    assert [e[1] for e in runner.events] == [6, 6, 6, 1, 1, 1] and [r[0] for r in runner.pages_made("summary", 2).collect()] == ["p3"]


def test_rows_are_exchanged_only_where_pages_are_kept(spark, tmp_path, monkeypatch):
    """A fresh build picks no pages and reads its tables as they are; a later one sends few pages to the rows, and many meet them by an exchange."""
    seen, rows = [], [(f"p{k}", k) for k in range(20)]
    def make(t):  # noqa: E306
        seen.append(t["src"]._jdf.queryExecution().executedPlan().toString())
        return t["src"].select("page_id", (F.col("v") * 2).alias("v"))

    stage = lambda: stages.PageStage("double", "1", ["src"], make)
    for most in (500_000, 0):
        monkeypatch.setattr(stages, "MOST_BROADCAST", most)
        runner = stages.PageRunner(spark, str(tmp_path / str(most)))
        fresh = runner.run({"src": table(spark, rows)}, [stage()])["double"]
        assert "Join" not in seen[-1] and "Join" not in fresh._jdf.queryExecution().executedPlan().toString()
        after = runner.run({"src": table(spark, [(p, v + (v == 3)) for p, v in rows[:-1]])}, [stage()])["double"]
        assert ("BroadcastHashJoin" in seen[-1]) == (most > 0) and runner.events[-1] == ("double", 1, 18, 1)
        assert sorted(map(tuple, after.collect())) == sorted((p, 2 * (v + (v == 3))) for p, v in rows[:-1])


def test_pages_removed_by_a_run_of_their_own_come_back(spark, tmp_path):
    """A run that only removes pages is a generation too, so that a page that comes back isn't of the one that removed it."""
    runner = stages.PageRunner(spark, str(tmp_path))
    go = lambda rows: sorted(map(tuple, runner.run({"src": table(spark, rows)}, [counting([])])["double"].collect()))
    assert go([("p1", 1), ("p2", 2)]) == [("p1", 2), ("p2", 4)]
    assert go([("p1", 1)]) == [("p1", 2)]
    assert go([("p1", 1), ("p2", 5)]) == [("p1", 2), ("p2", 10)]
    assert runner.index("double").orderBy("page_id").select("page_id", "generation").collect() == [("p1", 1), ("p2", 3)]
