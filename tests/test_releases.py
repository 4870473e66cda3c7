"""Metrics by protocol, examples for a model, icon candidates, what releases are made of."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from folio.operators import assets, evaluate, publish, translate


def test_metrics_of_ones_own(spark):
    class Longest:
        name = "longest"

        def evaluate(self, specs, pages):
            n = pages.blocks.groupBy("page_id").agg(F.count("*").cast("double").alias("value"))
            return specs.join(n, "page_id").select("page_id", F.lit(self.name).alias("metric"), "value", (F.col("value") > 1).alias("passed"))

    specs = spark.createDataFrame([("p1", 2, 1, ["a"], ["b1", "b2"])], "page_id string, expected int, symbol_count int, block_types array<string>, reading_order array<string>")
    blocks = spark.createDataFrame([("p1", "b1", "a"), ("p1", "b2", "c")], "page_id string, block_id string, kind string")
    pages = evaluate.PageTables(blocks, spark.createDataFrame([("p1",)], "page_id string"), spark.createDataFrame([("p1", ["b1", "b2"])], "page_id string, reading_order array<string>"))
    assert isinstance(Longest(), evaluate.EvalMetric) and all(isinstance(m, evaluate.EvalMetric) for m in evaluate.builtin_metrics())
    found = {r["metric"]: r["passed"] for r in evaluate.run_metrics(specs, pages, [*evaluate.builtin_metrics(), Longest()]).collect()}
    assert found == dict.fromkeys(("block_count", "symbol_count", "type_coverage", "reading_order", "longest"), True)
    with pytest.raises(ValueError):
        evaluate.run_metrics(specs, pages, [Longest(), Longest()])


def test_examples_show_the_concepts_of_a_batch(spark):
    pairs = [("s1", "paragraph", "A long text on danger", "x", ["danger"]), ("s2", "heading", "Danger", "Опасность", ["danger", "fate"]), ("s3", "heading", "Fate", "", ["fate"]), ("s4", "paragraph", "die", "кубик", ["die"]), ("s5", "paragraph", "no concept", "y", [])]
    batched = [("p1", 0, ["danger", "fate"]), ("p1", 0, ["die", "none"]), ("p1", 1, ["die"]), ("p2", 0, [])]
    found = translate.few_shot_examples(spark.createDataFrame(batched, "page_id string, batch int, concept_ids array<string>"), spark.createDataFrame(pairs, "segment_id string, kind string, text string, target string, concept_ids array<string>"))
    rows = found.orderBy("page_id", "batch", "nth").collect()
    assert [tuple(r)[:4] for r in rows] == [("p1", 0, 1, "s2"), ("p1", 0, 2, "s4"), ("p1", 1, 1, "s4")]
    assert json.loads(rows[0]["user"]) == {"batch_id": "example_1", "segments": [{"segment_id": "s2", "block_type": "heading", "source": "Danger", "required_concepts": ["danger", "fate"]}]}
    assert json.loads(rows[0]["assistant"]) == {"batch_id": "example_1", "segments": [{"segment_id": "s2", "target": "Опасность"}]}


def test_icon_candidates(spark):
    rows = [(2, 1, 80, 10, b"a"), (1, 5, 40, 40, b"a"), (1, 4, 81, 40, b"b"), (1, 3, 40, 9, b"c"), (3, 1, 10, 10, b""), (3, 2, 10, 10, None), (4, 1, 20, 20, b"d")]
    found = assets.icon_candidates(spark.createDataFrame(rows, "page_number int, xref int, width int, height int, content binary")).orderBy("page_number").collect()
    assert [tuple(r)[1:] for r in found] == [("p0001", 1, 5, 40, 40), ("p0004", 4, 1, 20, 20)] and found[0]["hash"] == hashlib.sha256(b"a").hexdigest()[:16]


def test_what_a_release_is_made_of(spark):
    render = {"page_refs": {"p1": "a", "p2": "b"}, "image_refs": {"i": "c"}, "raster_refs": {"p1": {"150": "d"}}, "glossary_ref": "g", "nav_ref": ""}
    stages = lambda *s: json.dumps({"source_pdf_sha256": "f", "stages": [{"stage_name": n, "artifact_ref": r} for n, r in s]})
    artifacts = [("m1", stages(("qa", "q"), ("render", "r1"), ("render", "r2"))), ("m2", stages(("qa", "q"))), ("m3", stages(("render", "r2"))), ("m4", "not json"), ("m5", stages(("render", "lost"))), ("m6", stages(("render", None))), ("r1", json.dumps(render)), ("r2", "{}")]
    runs = [("a", "m1"), ("b", "m2"), ("c", "m3"), ("d", "m4"), ("e", "m5"), ("f", "m6"), ("g", None), ("h", ""), ("i", "none")]
    refs, problems = publish.bundle_refs(spark.createDataFrame(runs, "run_id string, run_manifest_ref string"), spark.createDataFrame(artifacts, "ref string, body string"))
    assert sorted(map(tuple, refs.collect())) == sorted([("a", "f", "page", "p1", "a"), ("a", "f", "page", "p2", "b"), ("a", "f", "companion", "glossary_ref", "g"), ("a", "f", "image", "i", "c"), ("a", "f", "raster", "p1__150dpi", "d")])
    assert {r["run_id"]: r["problem"] for r in problems.collect()} == {"b": "no_render_stage", "c": "no_page_refs", "d": "no_manifest", "e": "no_page_refs", "f": "no_render_stage", "g": "no_manifest", "h": "no_manifest", "i": "no_manifest"}
