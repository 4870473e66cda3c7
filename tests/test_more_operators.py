"""Operators whose parts are queries of their own, together; rules at their edges; configuration tables."""

import json

import pytest
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import evaluate, layout, publish, qa, registry, search, structure, translate, verify
from folio.sources import config


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "before, after",
    [("Co- Op", "Co- Op"), ("CO- op", "CO-op"), ("re- roll", "re-roll"), ("Self- made", "Self-made"), ("exam- ple", "example"), ("more- all", "moreall"), ("self- a- b", "self-a- b"), ("x- co- op", "xcoop"), ("taco- op", "tacoop")],
)
def test_line_end_hyphens(spark, before, after):
    assert one(spark, T.dehyphenate(F.col("t")), t=before) == after


def test_garbled_leaves_out_spaces_only(spark):
    assert one(spark, T.is_garbled(F.col("t")), t="a\t\t\t")
    assert not one(spark, T.is_garbled(F.col("t")), t="a   ")


def test_rules_skip_what_is_not_to_be_translated(spark):
    text = "all of this is in Latin letters"
    rows = [("p1", f"b{k}", k, kind, text, flag) for k, (kind, flag) in enumerate((("paragraph", True), ("divider", True), ("unknown", True), ("paragraph", False), ("paragraph", None)))]
    blocks = spark.createDataFrame(rows, "page_id string, block_id string, pos int, kind string, text string, translatable boolean")
    assert {r["entity_ref"] for r in qa.untranslated(blocks).collect()} == {"b0", "b4"}


def test_leaked_identifiers_in_titles(spark):
    blocks = spark.createDataFrame([("p1", "b1", 0, "paragraph", "see core_rule_v1"), ("p1", "b2", 1, "divider", "core_rule_v1")], "page_id string, block_id string, pos int, kind string, text string")
    titles = spark.createDataFrame([("p1", "UNKNOWN"), ("p2", "Fine")], "page_id string, title string")
    assert {(r["page_id"], r["entity_ref"]) for r in qa.leaked_identifiers(blocks, titles).collect()} == {("p1", "page.title"), ("p1", "b1")}


def test_rules_together_are_the_rules_alone(spark):
    texts = ["see page 7", "x" * 1200, "UNKNOWN", "done.Next", "AB1234", "fine"]
    blocks = spark.createDataFrame([("p1", f"b{k}", k, "paragraph", t) for k, t in enumerate(texts)], "page_id string, block_id string, pos int, kind string, text string")
    alone = sorted(map(tuple, (r for rule in qa.RULES for r in rule(blocks).collect())), key=str)
    assert sorted(map(tuple, qa.run_rules(blocks).collect()), key=str) == alone and len(alone) >= 5


def test_navigation_in_runs(spark):
    rows = [("a" if k % 3 else None, k, f"p{k}") for k in range(200)]
    pages = spark.createDataFrame(rows, "source string, n long, page_id string")
    for runs in (4, 256):
        found = {r["page_id"]: (r["prev_page"], r["next_page"]) for r in search.navigation(pages, "source", "n", runs).collect()}
        for source in ("a", None):
            own = [p for s, _, p in rows if s == source]
            assert all(found[p] == (own[k - 1] if k else None, own[k + 1] if k + 1 < len(own) else None) for k, p in enumerate(own))


def test_cross_stage_needs_both_sides(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    words = frame([("p1", "w1")], "page_id string, word_id string")
    refs = frame([("p1", "b1", "w1"), ("p1", "b1", "w9"), ("p2", "b2", "w1")], "page_id string, entity_ref string, word_id string")
    found = verify.cross_stage({"words": words, "word_refs": refs})
    assert [tuple(r) for r in found.collect()] == [("XREF_NATIVE_WORD", "error", "p1", "b1", "w9")]
    blocks = frame([("p1", "b1", "figure", "a1", True), ("p1", "b2", "paragraph", None, True), ("p1", "b3", "paragraph", None, False)], "page_id string, block_id string, kind string, asset_id string, translatable boolean")
    rendered = frame([("p1", "b1", "figure", "a2")], "page_id string, block_id string, kind string, asset_id string")
    figures = frame([("p1", "a2", "img/a2.png"), ("p1", "a3", "")], "page_id string, asset_id string, src string")
    files = frame([("pages/p1.json",)], "path string")
    tables = {"blocks": blocks, "rendered": rendered, "figures": figures, "files": files, "referenced": frame([("p1", "a2"), ("p1", "a9")], "page_id string, asset_id string")}
    codes = sorted((r["code"], r["severity"], r["entity_ref"]) for r in verify.cross_stage(tables).collect())
    assert codes == [("XREF_IR_FIGURE_REMAP", "error", "b1"), ("XREF_IR_TO_RENDER", "warning", "b2"), ("XREF_RENDER_ASSET", "error", "a9"), ("XREF_RENDER_TO_PUBLISH", "error", "a2")]
    report = {r["page_id"]: r["passed"] for r in verify.page_report(refs, found).collect()}
    assert report == {"p1": False, "p2": True}
    totals = verify.report_totals(found).first()
    assert (totals["error"], totals["passed"]) == (1, False)
    with pytest.raises(ValueError):
        verify.cross_stage({"words": words})


def test_cycles_among_long_chains(spark):
    edges = [("chain", k, k + 1) for k in range(300)] + [("loop", k, (k + 1) % 50) for k in range(50)] + [("tail", 0, 1), ("tail", 1, 2), ("tail", 2, 1)] + [("self", 4, 4)] + [("twice", 1, 2), ("twice", 1, 2)]
    df = spark.createDataFrame([(p, "aside", s, t) for p, s, t in edges], "page_id string, edge_kind string, source_id long, target_id long")
    assert {r["page_id"] for r in verify.anchor_cycles(df).collect()} == {"loop", "tail", "self"}


def test_semantics_of_a_page(spark):
    schema = "page_id string, block_id string, pos int, kind string, text string, x0 double, y0 double, x1 double, y1 double"
    rows = [
        ("p1", "b1", 0, "figure", "", 50.0, 100.0, 300.0, 200.0),
        ("p1", "b2", 1, "paragraph", "A caption", 60.0, 205.0, 290.0, 215.0),
        ("p1", "b3", 2, "paragraph", "label", 100.0, 120.0, 120.0, 130.0),
        ("p1", "b4", 3, "paragraph", "In a box.", 410.0, 100.0, 500.0, 110.0),
        ("p1", "b5", 4, "paragraph", "More of it.", 410.0, 120.0, 500.0, 130.0),
        ("p1", "b6", 5, "paragraph", "a b c", 60.0, 400.0, 200.0, 420.0),
        ("p1", "b7", 6, "paragraph", "Prose.", 60.0, 600.0, 200.0, 620.0),
    ]
    areas = spark.createDataFrame([("p1", 1, "r001", "figure_area", 40.0, 90.0, 310.0, 202.0), ("p1", 2, "r002", "callout_area", 400.0, 90.0, 520.0, 140.0), ("p1", 3, "r003", "body", 0.0, 0.0, 600.0, 800.0)], "page_id string, ordinal int, region_id string, kind string, x0 double, y0 double, x1 double, y1 double")
    tables = spark.createDataFrame([("p1", "e1", 50.0, 390.0, 300.0, 500.0, 0.9), ("p1", "e2", 0.0, 0.0, 600.0, 800.0, 0.2)], "page_id string, evidence_id string, x0 double, y0 double, x1 double, y1 double, confidence double")
    blocks, edges = layout.resolve_semantics(spark.createDataFrame(rows, schema), areas, tables)
    found = {r["block_id"]: (r["kind"], r["region_id"], r["text"]) for r in blocks.collect()}
    assert found == {"b1": ("figure", "r001", ""), "b2": ("caption", "r003", "A caption"), "b4": ("callout", "r002", "In a box. More of it."), "b6": ("table", "r003", "a b c"), "b7": ("paragraph", "r003", "Prose.")}
    kinds = {(r["edge_kind"], r["source_id"], r["target_id"]) for r in edges.collect()}
    assert {("caption", "b2", "b1"), ("table", "b6", "e1"), ("block_to_region", "b4", "r002"), ("block_to_region", "b7", "r003")} <= kinds
    flow = spark.createDataFrame([("p1", "r003", 1), ("p1", "r002", 2)], "page_id string, region_id string, position int")
    order = layout.in_region_order(layout.assign_to_regions(spark.createDataFrame(rows, schema), areas), areas, flow)
    assert [r["block_id"] for r in order.orderBy("nth").collect()] == ["b2", "b6", "b7", "b1", "b4", "b3", "b5"]


def test_metrics_and_regressions(spark):
    specs = spark.createDataFrame([("p1", 1, ["paragraph"], 2, ["a", "b"]), ("p2", 0, [], 0, [])], "page_id string, expected long, block_types array<string>, symbol_count int, reading_order array<string>")
    blocks = spark.createDataFrame([("p1", "paragraph")], "page_id string, kind string")
    icons = spark.createDataFrame([("p1",), ("p1",)], "page_id string")
    orders = spark.createDataFrame([("p1", ["b", "a"])], "page_id string, reading_order array<string>")
    found = {(r["page_id"], r["metric"]): r["passed"] for r in evaluate.default_metrics(specs, blocks, icons, orders).collect()}
    assert found == {("p1", "block_count"): True, ("p1", "symbol_count"): True, ("p1", "type_coverage"): True, ("p1", "reading_order"): False, ("p2", "block_count"): True, ("p2", "symbol_count"): True, ("p2", "type_coverage"): True, ("p2", "reading_order"): True}
    now = spark.createDataFrame([("l", 1, True), ("l", 2, False), ("l", 3, False)], "ladder string, order int, passed boolean")
    before = spark.createDataFrame([("l", 1, True), ("l", 3, True)], "ladder string, order int, passed boolean")
    rows = {r["order"]: (r["frontier"], r["regression"]) for r in evaluate.regressions(now, before).collect()}
    assert rows == {1: (False, False), 2: (True, False), 3: (False, True)}


def test_chunks_carry_what_their_inlines_mark(spark):
    chunks = spark.createDataFrame([("c1", ["b1", "b2"], "Text É"), ("c2", ["b3"], "x")], "anchor string, block_ids array<string>, text string")
    marks = [("b1", "term_mark", "k1", "Term", None, 1), ("b2", "term_mark", "k1", "terms", None, 5), ("b2", "icon", None, None, "sym.a", 6), ("b1", "icon", None, None, "sym.b", 2), ("b1", "text", None, None, None, 3)]
    inlines = spark.createDataFrame(marks, "block_id string, type string, concept_id string, surface_form string, symbol_id string, at long")
    rows = {r["anchor"]: r for r in search.harvest(chunks, inlines).collect()}
    assert [tuple(c) for c in rows["c1"]["concepts"]] == [("k1", "Term")] and rows["c1"]["symbols"] == ["sym.b", "sym.a"] and rows["c2"]["symbols"] == []
    index = {r["anchor"]: r for r in search.searchable(search.harvest(chunks, inlines).withColumn("section_path", F.array(F.lit("A"), F.lit("B")))).collect()}
    assert (index["c1"]["normalized_text"], index["c1"]["section_text"], index["c1"]["glossary_text"], index["c1"]["symbol_text"]) == ("text é", "A,B", "k1 Term", "sym.b,sym.a")


def test_messages(spark):
    rows = [("p1", 0, 1, "s2", "paragraph", "two", "Head", ["c1"]), ("p1", 0, 0, "s1", "heading", "Head", None, [])]
    batched = spark.createDataFrame(rows, "page_id string, batch int, pos int, segment_id string, kind string, text string, section string, concept_ids array<string>")
    message = json.loads(translate.user_messages(batched).first()["message"])
    assert message["batch_id"] == "p1.0" and [s["segment_id"] for s in message["segments"]] == ["s1", "s2"]
    assert message["segments"][1] == {"segment_id": "s2", "block_type": "paragraph", "source": "two", "required_concepts": ["c1"], "context": {"prev_heading": "Head"}} and "context" not in message["segments"][0]
    schema = json.loads(translate.response_schema(batched).first()["schema"])
    assert schema["properties"]["segments"]["items"]["properties"]["segment_id"] == {"enum": ["s1", "s2"], "type": "string"}


def test_reader_blocks(spark):
    long = "One sentence of some length that goes on. " * 30
    blocks = spark.createDataFrame([("p1", "b1", 0, "paragraph", long), ("p1", "b2", 1, "paragraph", "same"), ("p1", "b3", 2, "paragraph", "same")], "page_id string, block_id string, pos int, kind string, text string")
    found = structure.postprocess(blocks).orderBy("pos").collect()
    assert [r["block_id"] for r in found][0] == "b1.1" and "b3" not in {r["block_id"] for r in found} and all(len(r["text"]) <= 600 for r in found)


def test_provenance_and_release_rows(spark):
    runs = spark.createDataFrame([("r1", "old"), ("r2", None)], "run_id string, branch string")
    updates = spark.createDataFrame([("r1", 1, "new", "c1"), ("r1", 2, None, "c2")], "run_id string, recorded_at long, branch string, git string")
    assert {r["run_id"]: (r["branch"], r["git"]) for r in registry.with_provenance(runs, updates).collect()} == {"r1": ("new", "c2"), "r2": (None, None)}
    pages = spark.createDataFrame([("p1", {"72": "https://x/y.png", "300": "r/1.png", "150": "/abs.png"})], "page_id string, rasters map<string,string>")
    assert publish.facsimile_urls(pages, "/site/").first()["rasters"] == {"72": "https://x/y.png", "300": "/site/r/1.png", "150": "/abs.png"}


def test_configuration_tables(spark):
    symbols = config.symbol_table(spark, {"symbols": [{"symbol_id": "sym.a", "label": "A", "match_threshold": 0.9}, {"symbol_id": "sym.b"}]})
    assert [tuple(r) for r in symbols.collect()] == [("sym.a", "A", "", 0.9), ("sym.b", "", "", None)]
    waivers = config.waiver_table(spark, [{"waiver_id": "w1", "code": "X", "page_id": ""}, {"waiver_id": "w2", "code": "X", "page_id": "p1"}])
    assert [(r["ordinal"], r["page_id"]) for r in waivers.collect()] == [(0, None), (1, "p1")] and config.waiver_table(spark, {}).count() == 0
    fixtures = config.fixture_table(spark, {"fixtures": [{"document_id": "d", "checksums": {"b": "2", "a": "1"}}]})
    assert [tuple(r) for r in fixtures.collect()] == [("d", "a", "1"), ("d", "b", "2")]


def test_a_document_is_built_by_stages(spark, tmp_path):
    from folio.plans import build

    items = [("p1", f"b{k}", k, "text", "paragraph", f"Text of block {k}.", 50.0, 100.0 + 40 * k, 500.0, 120.0 + 40 * k, 600.0) for k in range(5)]
    evidence = spark.createDataFrame(items, "page_id string, item_id string, pos int, category string, kind string, text string, x0 double, y0 double, x1 double, y1 double, width double")
    candidates = spark.createDataFrame([], "page_id string, evidence_id string, x0 double, y0 double, x1 double, y1 double, confidence double")
    concepts = spark.createDataFrame([("c1", "block")], "concept_id string, lemma string")
    text = translate.inline_checksum(F.struct("text")).alias("checksum")
    memory = evidence.where("pos = 1").select(F.col("item_id").alias("segment_id"), text, F.lit("remembered").alias("target"))
    files = spark.createDataFrame([("pages/p1.json", "ab")], "ref string, sha256 string")
    stages = build.document_build(candidates, concepts, memory, files, evidence, lambda: translate.MockTranslator({"Text": "Wort"}))
    tables = build.run_build(spark, str(tmp_path / "build"), stages)
    texts = {r["block_id"]: r["text"] for r in tables["translate"].collect()}
    assert texts == {f"b{k}": "remembered" if k == 1 else f"Wort of block {k}." for k in range(5)}
    assert [r["block_id"] for r in tables["structure"].orderBy("pos").collect()] == [f"b{k}" for k in range(5)]
    assert tables["render"].count() == 1 and tables["chunks"].count() == 5
    release = tables["publish"].first()
    assert (release["ref"], release["sha256"], len(release["build_id"])) == ("pages/p1.json", "ab", 12)


def test_schemas_without_additional_properties():
    schema = {"type": "object", "additionalProperties": False, "properties": {"a": {"type": "array", "items": {"type": "object", "additionalProperties": True}}}}
    assert translate.without_additional_properties(schema) == {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "object"}}}}
    assert "additionalProperties" in schema
