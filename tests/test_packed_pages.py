"""Checks and lines that take whole pages: their rows are exchanged packed, with no aggregate or window that sorts and spills single rows."""

import pyarrow as pa
from pyspark.sql import functions as F

from folio.operators import asof, runs, structure, verify
from folio.plans import page_queries

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_inlines_are_made_behind_the_exchange(spark):
    collected = [line for line in plan(page_queries._page_ir(spark, SF_DIR)).splitlines() if "partial_collect_list" in line]
    assert collected and not any("w%04d" in line for line in collected)


def test_gathered_rows(spark):
    rows = [("a", 1), ("a", None), ("b", 2), (None, 3), ("a", 4), (None, 5)]
    found = runs.gathered(spark.createDataFrame(rows, "k string, v int").repartition(3), ["k"]).collect()
    assert {r["k"]: sorted(r["v"], key=str) for r in found} == {"a": [1, 4, None], "b": [2], None: [3, 5]} and len(found) == 3


def test_line_boxes_of_scattered_spans(spark):
    rows = [("p", 1, "s2", "b", 5, 1, 9, 4), ("p", 1, "s1", "a", 5, 0, 7, 3), ("p", 1, "s0", None, 1, 2, 3, 9), ("q", 1, "s", "z", None, 1, 2, 3), (None, 2, "t", "y", 1, 2, 3, 4)]
    lined = spark.createDataFrame(rows, "page_id string, line int, span_id string, text string, x0 int, y0 int, x1 int, y1 int").repartition(5)
    found = structure.line_boxes(lined)
    assert {tuple(r) for r in found.collect()} == {("p", 1, 1, 0, 9, 9, 3, "a b"), ("q", 1, None, 1, 2, 3, 1, "z"), (None, 2, 1, 2, 3, 4, 1, "y")}
    assert "Aggregate" not in plan(found)


def test_text_coverage_collects_nothing(spark):
    assert "Aggregate" not in plan(page_queries.layout_text_coverage(spark, SF_DIR))


def test_symbols_with_nulls_and_repeats(spark):
    make = lambda rows: spark.createDataFrame(rows, "page_id string, symbol_id string").repartition(3)
    found = verify.symbols(make([("p", "a"), ("p", "a"), ("p", "b"), ("p", None), (None, "n"), ("q", "x")]), make([("p", "b"), ("p", "c"), ("p", "c"), ("p", None), (None, "n")]))
    phantom, dropped = ("XREF_SYMBOL_TO_IR", "error"), ("XREF_SYMBOL_DROPPED", "warning")
    want = {(*phantom, "p", "c"), (*phantom, "p", None), (*phantom, None, "n"), (*dropped, "p", "a"), (*dropped, "p", None), (*dropped, None, "n"), (*dropped, "q", "x")}
    rows = [tuple(r)[:4] for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want) and "Aggregate" not in plan(found)


def test_cycles_without_a_group_a_call(spark):
    edges = [("p", "aside", "a", "b"), ("p", "aside", "b", "a"), ("q", "aside", "a", "b"), ("q", "aside", "a", "b"), ("q", "other", "b", "a"), ("r", "caption", None, None)]
    found = verify.anchor_cycles(spark.createDataFrame(edges, "page_id string, edge_kind string, source_id string, target_id string").repartition(3))
    assert sorted(r[0] for r in found.collect()) == ["p", "r"] and "FlatMapGroupsInPandas" not in plan(found)


def test_duplicate_instances_of_scattered_rows(spark):
    rows = [("p", "a", 3), ("p", "a", 1), ("q", "a", 2), ("p", "a", None), ("p", "", 1), ("p", "", 2), ("p", None, 1), (None, "b", 1), (None, "b", 2)]
    found = verify.duplicate_instances(spark.createDataFrame(rows, "page_id string, instance_id string, pos long").repartition(4))
    assert sorted(map(str, found.select("page_id", "entity_ref", "target").collect())) == sorted(map(str, spark.createDataFrame([("p", "a", "2"), ("p", "a", "3"), (None, "b", "2")], "page_id string, entity_ref string, target string").collect()))
    assert "Window" not in plan(found)


def test_no_duplicates_of_no_rows(spark):
    assert verify.duplicate_instances(spark.range(0).select(F.lit("p").alias("page_id"), F.lit("i").alias("instance_id"), F.col("id").alias("pos"))).isEmpty()


def test_squeezed_rows_come_back():
    """Strings and numbers with nulls, empty ones and all characters, over slices of a batch; a null value is a group without rows."""
    text = ["", None, "añ😀", "a\x00b", "x" * 70000, None, ""]
    table = pa.table({"k": ["a", "a", "b", "b", "b", None, None], "t": text, "n": pa.array([1.5, None, float("nan"), -0.0, 3.0, None, 7.0]), "i": pa.array([1, 2, None, -4, 5, 6, None], pa.int32())})
    rest = table.select(["t", "n", "i"])
    for batch in (table.to_batches()[0], table.to_batches()[0].slice(1, 5)):
        found = list(runs.squeeze(iter([batch]), ["k"], ["t", "n", "i"], "z"))
        assert sum(b.num_rows for b in found) == 3
        values = pa.concat_arrays([pa.nulls(1, pa.binary()), *(b.column("z") for b in found)])
        back = [a.flatten().to_pylist() for a in runs.spread(values, rest.schema)]
        assert repr(back) == repr([batch.column(c).to_pylist() for c in ("t", "n", "i")])
        assert [len(x) for x in runs.spread(values, rest.schema)[0].to_pylist()] == ([0, 2, 3, 2] if batch.num_rows == 7 else [0, 1, 3, 1])
    assert all(len(a) == 1 for a in runs.spread(pa.nulls(1, pa.binary()), rest.schema))


def test_icon_lines_exchange_compressed_values(spark):
    """Spans and icons go through their exchange as one compressed value a line, not as arrays of ids, boxes and texts."""
    spans = spark.createDataFrame([("p", 1, "s", "abcd", 0, 24)], "page_id string, line int, span_id string, text string, x0 int, x1 int")
    icons = spark.createDataFrame([("p", 1, "i", 3.0)], "page_id string, line int, icon_id string, x double")
    for text in (False, True):
        assert asof._packed_lines(spans, icons, text)[0].dtypes == [("page_id", "string"), ("line", "int"), ("s", "binary"), ("i", "binary")]
