"""Operators that SQL can't express, and edge cases, on small literals."""

import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folio import schemas
from folio.functions import geometry as G
from folio.functions import ids
from folio.functions import text as T
from folio.operators import assets, evaluate, graph, layout, patch, publish, qa, registry, render, search, structure, translate, verify
from folio.operators.terms import match_terms
from folio.plans import stages
from folio.sources import artifacts, config, ir, reader
from folio.streaming import events as stream


def one(spark, column, **values):
    """A column expression's value over one row."""
    names = list(values)
    schema = ", ".join(f"{n} {'string' if isinstance(values[n], str | None) else 'double' if isinstance(values[n], float) else 'binary' if isinstance(values[n], bytes) else 'int'}" for n in names)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("exam- ple", "example"),
        ("self- made and Non- zero", "self-made and Non-zero"),
        ("unself- made", "unselfmade"),
        ("ONE.Two", "ONE.Two"),
        ("one.Two!Three", "one. Two! Three"),
        ("bell\u0007 tab\tkept", "bell tab\tkept"),
        ("", ""),
    ],
)
def test_normalize(spark, before, after):
    assert one(spark, T.normalize(F.col("t")), t=before) == after


def test_text_rules(spark):
    reason = lambda t: one(spark, T.first_reason(F.col("t"), T.GLUED), t=t)
    assert [reason(t) for t in ("словоСЛОВО", "banabana", "конец.Новое", "глава5", "end.Next", "fine text")] == ["case", "repeat", "sentence_ru", "digit", "sentence_en", None]
    icon = lambda t: one(spark, T.first_reason(F.col("t"), T.DECORATIVE), t=t)
    assert [icon(t) for t in ("x AB1234 y", "T01T02", "a \ue001 b", "a . b", "plain.")] == ["asset_token", "stage_code", "private_use", "placeholder", None]
    leak = lambda t: one(spark, T.leaked_identifier(F.col("t")), t=t)
    assert [leak(t) for t in ("see core_rule_v1_2", "UNKNOWN x", "а one_two_three", "one_two_three")] == ["core_rule_v1_2", "UNKNOWN", "one_two_three", None]
    toc = one(spark, F.to_json(T.toc_entries(F.col("t"))), t="Setup..... 12 Play..... 34")
    assert json.loads(toc) == [{"title": "Setup", "page": 12}, {"title": "Play", "page": 34}]
    assert one(spark, F.size(T.toc_entries(F.col("t"))), t="Setup..... 12") == 0
    assert one(spark, F.size(T.toc_entries(F.col("t"))), t="none") == 0
    garbage = lambda t: one(spark, T.is_garbage_title(F.col("t")), t=t)
    assert [garbage(t) for t in ("", "12.", "a", "ab", "Глава 1")] == [True, True, True, False, False]
    assert one(spark, T.identical_translation(F.col("a"), F.col("b")), a="Straße  x", b="STRASSE X")
    assert not one(spark, T.identical_translation(F.col("a"), F.col("b")), a="x", b="")
    assert one(spark, T.nfkd_lower(F.col("t")), t="Ünï  ﬁ") == "ünï fi"
    assert one(spark, F.to_json(T.extract_json(F.col("t"))), t='text ```json\n{"a": 1}\n``` more') == '{"a":1}'
    assert one(spark, T.extract_json(F.col("t")).isNull(), t="no json")
    assert one(spark, T.is_garbled(F.col("t")), t="#$% &*(a") and not one(spark, T.is_garbled(F.col("t")), t="word")


def test_identifiers(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    assert tuple(one(spark, ids.png_size(F.col("c")), c=png)) == (640, 480)
    assert one(spark, ids.png_size(F.col("c")), c=b"xx") is None
    assert one(spark, ids.asset_class_id(F.lit("image"), F.col("d")), d="") == "ac.image.000000000000"
    assert one(spark, ids.color_to_int(F.col("r"), F.lit(0.5), F.lit(2.0)), r=1.0) == 0xFF80FF
    assert one(spark, ids.page_id(F.col("n")), n=12345) == "p12345"


def test_nearest_gap(spark):
    gap = G.nearest_gap_x(F.col("x"), F.lit(10.0), F.lit(3), F.lit(26.0))
    assert one(spark, gap, x=0.0) == 30.0


BLOCKS = "page_id string, block_id string, pos int, kind string, text string"


def blocks(spark, rows, schema=BLOCKS):
    return spark.createDataFrame([("p0001", f"b{i}", i, *r) for i, r in enumerate(rows)], schema)


def test_duplicate_rule_edges(spark):
    same = "one two three four five six seven eight nine ten"
    rows = [("paragraph", same), ("divider", "x"), ("paragraph", same + " eleven"), ("paragraph", ""), ("paragraph", "")]
    found = [r["entity_ref"] for r in qa.duplicate_content(blocks(spark, rows)).collect()]
    assert found == ["b2"]  # 10 of 11 words exceed 0.9, empty texts never match


def test_waivers_take_the_first_by_ordinal(spark):
    findings = spark.createDataFrame([("A", "p1"), ("A", "p2"), ("B", "p1")], "code string, page_id string").withColumn("severity", F.lit("error"))
    waivers = spark.createDataFrame([(2, "w2", "A", "p1"), (1, "w1", "A", None), (3, "w3", "A", "p1")], "ordinal int, waiver_id string, code string, page_id string")
    out = qa.apply_waivers(findings, waivers)
    assert {(r["code"], r["page_id"]): r["waiver_id"] for r in out.collect()} == {("A", "p1"): "w1", ("A", "p2"): "w1", ("B", "p1"): None}
    assert qa.gate(out).first()["blocked"] and not qa.gate(out.where("waived")).first()["blocked"]
    counts, rows = qa.review_pack(out)
    assert tuple(counts.first()) == (3, 2, 1) and rows.count() == 1
    assert qa.waiver_templates(out.withColumn("entity_ref", F.lit("b1"))).count() == 3


def test_anchor_cycles(spark):
    edges = [("acyclic", "aside", "a", "b"), ("acyclic", "aside", "b", "c"), ("two", "aside", "a", "b"), ("two", "caption", "b", "a"), ("self", "aside", "a", "a"), ("other", "table", "a", "a"), ("tail", "aside", "x", "a"), ("tail", "aside", "a", "b"), ("tail", "aside", "b", "a")]
    df = spark.createDataFrame(edges, "page_id string, edge_kind string, source_id string, target_id string")
    assert {r[0] for r in verify.anchor_cycles(df).collect()} == {"two", "self", "tail"}
    anchors = verify.dangling_anchors(df, df.select("page_id", F.col("source_id").alias("block_id")), df.limit(0).select("page_id", F.col("source_id").alias("region_id")))
    assert {(r["page_id"], r["target"]) for r in anchors.collect()} == {("acyclic", "c")}


def items(spark, rows):
    return spark.createDataFrame([("p1", f"i{i}", c, float(a), float(b), float(x), float(y), 600.0) for i, (c, a, b, x, y) in enumerate(rows)], "page_id string, item_id string, category string, x0 double, y0 double, x1 double, y1 double, width double")


def test_regions_of_a_page(spark):
    rows = [("text", 20, 10, 200, 20), ("image", 20, 100, 580, 160)]
    rows += [("text", 20, 170 + 12 * k, 250, 180 + 12 * k) for k in range(6)] + [("text", 340, 170 + 12 * k, 580, 180 + 12 * k) for k in range(6)]
    rows += [("text", 20, 760, 200, 770)]
    found = layout.regions(items(spark, rows)).orderBy("ordinal").collect()
    assert [(r["kind"], r["n"]) for r in found] == [("header", 1), ("footer", 1), ("figure_area", 1), ("body", 6), ("body", 6)]
    order = {r["region_id"]: r for r in layout.reading_order(layout.regions(items(spark, rows))).collect()}
    main = sorted((r["position"], r["region_id"]) for r in order.values() if r["role"] == "main")
    assert [m[1] for m in main] == ["r003", "r004", "r005"] and order["r001"]["role"] == "furniture"
    assert layout.regions(items(spark, rows).limit(0)).count() == 0


def test_border_items_join_both_bands(spark):
    rows = [("text", 20, 70, 100, 80), ("image", 20, 100, 580, 120), ("text", 20, 95, 100, 105), ("text", 20, 140, 100, 150)]
    out = layout.bands(layout.split_furniture(items(spark, rows))).collect()
    assert sorted((r["item_id"], r["band"]) for r in out if r["item_id"] == "i2") != [] and len([r for r in out if r["item_id"] == "i2"]) == 2


def test_suppression_and_clusters(spark):
    boxes = spark.createDataFrame([("p", "a", 0.9, 0.0, 0.0, 10.0, 10.0), ("p", "b", 0.8, 1.0, 1.0, 11.0, 11.0), ("p", "c", 0.7, 20.0, 20.0, 30.0, 30.0)], "page_id string, box_id string, score double, x0 double, y0 double, x1 double, y1 double")
    assert {r["box_id"] for r in layout.suppress_overlaps(boxes).collect()} == {"a", "c"}
    clusters = layout.vector_clusters(boxes.withColumnRenamed("box_id", "path_id")).collect()
    assert [(r["cluster"], r["n"], r["x1"]) for r in clusters] == [("p/a", 2, 11.0)]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 60), (60, 55), (70, 70)], "a long, b long")
    found = {r["id"]: r["component"] for r in graph.components(edges, "a", "b").collect()}
    assert found == {**dict.fromkeys(range(31), 0), 50: 50, 55: 50, 60: 50}


def test_lists_and_repeats(spark):
    schema = BLOCKS + ", x0 double, y0 double, x1 double, y1 double"
    rows = [("list_item", "1.", 10.0, 0.0, 20.0, 10.0), ("paragraph", "first", 5.0, 12.0, 90.0, 22.0), ("paragraph", "second", 15.0, 40.0, 90.0, 50.0), ("paragraph", "far", 15.0, 90.0, 90.0, 99.0)]
    out = structure.merge_list_continuations(blocks(spark, rows, schema)).orderBy("pos").collect()
    assert [(r["block_id"], r["text"], r["y1"]) for r in out] == [("b0", "1. first second", 50.0), ("b3", "far", 99.0)]
    again = [("paragraph", t) for t in ("same", "one1", "two2", "thr3", "fou4", "same", "fiv5", "ab", "ab", "six6", "same")]
    kept = {r["block_id"] for r in structure.drop_recent_repeats(blocks(spark, again)).collect()}
    assert kept == {f"b{i}" for i in range(11)} - {"b5"}  # a block at distance six stays, short ones too
    short = [("heading", "A"), ("heading", "B"), ("heading", "C"), ("paragraph", "x"), ("heading", "A"), ("heading", "B")]
    assert {r["block_id"] for r in structure.drop_heading_clusters(blocks(spark, short)).collect()} == {"b3", "b4", "b5"}


def test_split_long_keeps_the_text(spark):
    sentence = "Word " * 30 + "end. "
    text = (sentence * 12).strip()
    parts = structure.split_long(blocks(spark, [("paragraph", text), ("heading", text), ("paragraph", "short")])).collect()
    long = sorted((r["part"], r["block_id"], r["text"]) for r in parts if r["block_id"].startswith("b0"))
    assert [p[1] for p in long] == [f"b0.{k + 1}" for k in range(len(long))] and all(len(p[2]) <= 600 for p in long)
    assert " ".join(p[2] for p in long) == text
    assert {r["block_id"] for r in parts if r["block_id"][:2] in ("b1", "b2")} == {"b1", "b2"}


def test_term_matches_prefer_the_longest(spark):
    terms = spark.createDataFrame([("c1", "fire"), ("c2", "fire ball"), ("c3", "ball")], "concept_id string, form string")
    found = match_terms(blocks(spark, [("paragraph", "A Fire Ball and fireballs, fire."), ("paragraph", "")]), terms).collect()
    assert sorted((r["start"], r["end"], r["concept_id"]) for r in found) == [(2, 11, "c2"), (27, 31, "c1")]


def test_spans_and_levels(spark):
    spans = spark.createDataFrame([("p", "s1", "a", 0.0, 0.0, 5.0, 9.0, "b"), ("p", "s2", "b", 5.0, 1.0, 9.0, 9.0, "b"), ("p", "s3", "c", 20.0, 4.5, 25.0, 9.0, ""), ("p", "s4", "d", 0.0, 9.0, 5.0, 19.0, "")], "page_id string, span_id string, text string, x0 double, y0 double, x1 double, y1 double, marks string")
    chain = {r["span_id"]: r["line"] for r in structure.lines_by_chain(spans).collect()}
    anchor = {r["span_id"]: r["line"] for r in structure.lines_by_anchor(spans).collect()}
    assert chain == {"s1": 1, "s2": 1, "s3": 2, "s4": 3} and anchor == {"s1": 1, "s2": 1, "s3": 1, "s4": 2}
    joined = structure.joined_spans(structure.lines_by_anchor(spans)).orderBy("line", "nth").collect()
    assert [r["text"] for r in joined] == ["ab", "c", "d"]
    heads = spark.createDataFrame([("p", 16.0), ("p", 12.0), ("p", 12.0), ("q", 9.0)], "page_id string, font_size double")
    assert sorted((r["page_id"], r["level"]) for r in structure.heading_levels(heads).collect()) == [("p", 1), ("p", 2), ("p", 2), ("q", 3)]


def test_chunks_follow_the_walk(spark):
    kinds = ["paragraph", "heading", "paragraph", "paragraph", "paragraph", "paragraph", "table", "paragraph", "divider", "paragraph", "figure", "heading", "paragraph"]
    rows = [(k, "" if k in ("divider", "figure") else f"t{i}") for i, k in enumerate(kinds)]
    groups, current, heading, count = [], [], False, 0
    for i, k in enumerate(kinds):
        if k in ("divider", "figure", "table", "heading"):
            if current:
                groups.append(current)
            current, heading, count = ([i], True, 0) if k == "heading" else ([], False, 0)
            if k == "table":
                groups.append([i])
        elif heading and count < 3:
            current.append(i)
            count += 1
        else:
            if current:
                groups.append(current)
            current, heading, count = [i], False, 0
    groups.append(current)
    found = search.chunks(blocks(spark, rows)).collect()
    assert sorted(r["block_ids"] for r in found) == sorted([f"b{i}" for i in g] for g in groups)


def test_patches(spark):
    doc = json.dumps({"blocks": [{"text": "a"}, {"text": "b"}], "m/n": 1})
    pages = spark.createDataFrame([("p1", doc), ("p2", doc), ("p3", doc)], "page_id string, doc string")
    ops = [("p1", 1, "replace", "/blocks/0/text", '"x"'), ("p1", 2, "insert", "/blocks/1", '{"text":"new"}'), ("p1", 3, "delete", "/blocks/2", None), ("p1", 4, "replace", "/m~1n", "2"), ("p2", 1, "delete", "/blocks/9", None)]
    out = {r["page_id"]: r for r in patch.apply_patches(pages, spark.createDataFrame(ops, "page_id string, ordinal int, op string, path string, value string")).collect()}
    assert json.loads(out["p1"]["doc"]) == {"blocks": [{"text": "x"}, {"text": "new"}], "m/n": 2}
    assert out["p2"]["error"].startswith("IndexError") and json.loads(out["p2"]["doc"]) == json.loads(doc) and out["p3"]["error"] is None
    with pytest.raises(ValueError):
        patch.pointer_tokens("no")


def test_fixes_mend_findings(spark):
    long = ("Some words here. " * 80).strip()
    b = blocks(spark, [("paragraph", "see AB1234 now"), ("paragraph", long)]).withColumn("index", F.col("pos"))
    findings = qa.decorative_icons(b).unionByName(qa.paragraph_length(b))
    doc = json.dumps({"blocks": [{"text": "see AB1234 now"}, {"text": long}]})
    out = patch.apply_patches(spark.createDataFrame([("p0001", doc)], "page_id string, doc string"), patch.fixes_for(b, findings)).first()
    texts = [x["text"] for x in json.loads(out["doc"])["blocks"]]
    assert out["error"] is None and texts[0] == "see now" and len(texts) == 3 and " ".join(texts[1:]) == long


def test_translation(spark):
    segments = spark.createDataFrame([("s1", "the cat", ["c1"]), ("s2", "x", []), ("s3", "y", ["c2"])], "segment_id string, text string, concept_ids array<string>")
    concepts = spark.createDataFrame([("c1", "Katze", ["kater"], ["Hund"]), ("c2", "Y", [], [])], "concept_id string, target_lemma string, allowed array<string>, forbidden array<string>")
    results = spark.createDataFrame([("s1", "der Hund", ), ("s3", "y da"), ("s9", " "), ("s3", "y")], "segment_id string, target string")
    found = {(r["segment_id"], r["problem"]) for r in translate.validate(segments, results, concepts).collect()}
    assert found == {("s2", "missing"), ("s9", "extra"), ("s3", "duplicate"), ("s9", "empty"), ("s1", "forbidden_form"), ("s1", "concept_not_realized")}

    class Broken:
        name = "broken"

        def translate(self, texts):
            raise OSError("down")

    waits = []
    client = translate.FallbackTranslator([Broken(), translate.MockTranslator({"cat": "Katze"})], sleep=waits.append)
    assert client.translate(["the cat"]) == ["the Katze"] and client.name == "mock" and waits == [1.0, 1.0]
    with pytest.raises(RuntimeError):
        translate.FallbackTranslator([Broken()], retries=0).translate(["x"])
    prompt = translate.system_prompt(concepts.withColumn("lemma", F.col("concept_id")), "Rules").first()[0]
    assert prompt == "Rules\nc1 = Katze\nc2 = Y"


def test_evaluation(spark):
    order = evaluate.order_accuracy(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("a"), F.lit("c")))
    assert one(spark, order, x=1) == pytest.approx(1 / 3)
    empty = F.array().cast("array<string>")
    assert one(spark, evaluate.order_accuracy(empty, empty), x=1) == 1.0
    totals = spark.createDataFrame([("a", 0.9)], "metric string, value double")
    limits = spark.createDataFrame([("a", 0.95), ("b", 0.1)], "metric string, least double")
    assert not any(r["ok"] for r in evaluate.check_thresholds(totals, limits).collect())
    assert [one(spark, evaluate.confidence_band(F.col("v")), v=v) for v in (0.85, 0.6, 0.3, 0.29)] == ["primary", "hard_route", "qa", "block"]
    a = spark.createDataFrame([("p", 0, "x"), ("p", 1, "y")], "page_id string, pos int, block_id string")
    assert evaluate.compare_orders(a, a.where("pos = 0")).count() == 1


def test_registry_ties(spark):
    rows = spark.createDataFrame([("k", 5, "a"), ("k", 5, "b"), ("k", 4, "z")], "k string, at int, h string")
    assert registry.latest(rows, ["k"], "at", "h").first()["h"] == "b"
    rasters = spark.createDataFrame([("p", 100, "a"), ("p", 200, "b"), ("q", None, "old")], "page_id string, dpi int, path string")
    assert {r["page_id"]: r["path"] for r in registry.nearest_raster(rasters, 150).collect()} == {"p": "a", "q": "old"}


def test_artifact_store(spark, tmp_path):
    store = artifacts.ArtifactStore(spark, f"file://{tmp_path}/store")
    row = lambda body, at: spark.createDataFrame([("d", "page_ir", "page", "p0001", body, at)], "document_id string, family string, scope string, entity_id string, body string, written_at string").withColumn("written_at", F.to_timestamp("written_at"))
    assert store.latest("page_ir").count() == 0
    for body, at in (('{"a":1}', "2024-01-01 00:00:00"), ('{"a":2}', "2024-01-02 00:00:00"), ('{"a":1}', "2024-01-03 00:00:00")):
        refs = store.put(row(body, at))
    assert store.bodies.count() == 2 and store.latest("page_ir").first()["body"] == '{"a":1}'
    assert store.get(refs).first()["body"] == '{"a":1}'
    with pytest.raises(Exception, match="no artifact"):
        store.get(refs.withColumn("content_hash", F.lit("missing"))).collect()
    assert [r[0] for r in store.pages("d", ("page_ir",)).collect()] == ["p0001"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"abc")
    files = artifacts.fingerprints(spark, f"file://{tmp_path}", "*.txt").collect()
    assert [(r["length"], r["sha256"][:8]) for r in files] == [(3, "ba7816bf")]
    assert {r[0] for r in artifacts.page_filter(spark, "15, 18-20").collect()} == {"p0015", "p0018", "p0019", "p0020"}
    assert artifacts.page_manifest(spark.createDataFrame([("d", 3), ("e", 0)], "document_id string, page_count int")).count() == 3
    (tmp_path / "base.toml").write_text('x = 1\nlist = [1, 2]\n[t]\na = 1\nb = 2\n')
    (tmp_path / "over.toml").write_text('list = [3]\n[t]\nb = 3\n')
    assert config.load_layers(tmp_path / "base.toml", tmp_path / "none.toml", tmp_path / "over.toml") == {"x": 1, "list": [3], "t": {"a": 1, "b": 3}}
    with pytest.raises(ValueError):
        config.band_table(spark, {"bands": [{"name": "a", "min_confidence": 0.0, "max_confidence": 0.3}, {"name": "b", "min_confidence": 0.4, "max_confidence": 1.0}]})
    concepts = config.concept_table(spark, {"concepts": [{"concept_id": "c", "source": {"lemma": "x"}, "target": {"lemma": "y"}}]}).first()
    assert concepts["kind"] == "term" and concepts["allowed"] == []


def test_publishing(spark):
    files = lambda rows: spark.createDataFrame(rows, "path string, sha256 string")
    problems = publish.checksum_problems(files([("a", "1"), ("b", "2"), ("c", "3")]), files([("a", "1"), ("b", "9"), ("d", "4")]))
    assert {tuple(r) for r in problems.collect()} == {("b", "changed"), ("c", "missing"), ("d", "extra")}
    refs = spark.createDataFrame([("page", "x"), ("nav", "y")], "kind string, ref string")
    assert publish.build_id(refs).first() == publish.build_id(refs.orderBy("ref")).first()
    figures = spark.createDataFrame([("p1", {"fig": "a/b/c.png", "p1.g": "d.png"})], "page_id string, figures map<string,string>")
    assert publish.figure_urls(figures, "img/").first()["figures"] == {"p1.fig": "img/c.png", "p1.g": "img/d.png"}
    rows = [("p", f"a{i}", "heading", 100 - i, "src", "tgt" if i else "SRC", 0.0, 0.0, 0.1, 0.1) for i in range(4)]
    found = publish.annotations(spark.createDataFrame(rows, "page_id string, annotation_id string, kind string, priority int, source string, target string, x0 double, y0 double, x1 double, y1 double"))
    assert {r["annotation_id"] for r in found.collect()} == {"a1", "a2", "a3"}


def test_reader(spark):
    notes = spark.createDataFrame([("p", "a", 0.5, 0.10, 0.6, 0.11), ("p", "b", 0.1, 0.101, 0.2, 0.111), ("p", "c", 0.0, 0.5, 0.1, 0.6)], "page_id string, annotation_id string, x0 double, y0 double, x1 double, y1 double")
    assert [r["annotation_id"] for r in reader.reader_order(notes).orderBy("nth").collect()] == ["b", "a", "c"]
    glossary = spark.createDataFrame([("Fire", None, None, ["Flame"]), ("Ice", None, "cold", None)], "term string, source_term string, notes string, aliases array<string>")
    assert [search.glossary_matches(glossary, q).count() for q in ("FLA", "cold", "zzz")] == [1, 1, 0]


def test_validation(spark):
    rows = spark.createDataFrame([("p0001", "heading", 0.5), ("x1", "other", 1.5), (None, "heading", 0.0)], "page_id string, kind string, score double").withColumn("key", F.monotonically_increasing_id())
    found = schemas.validate(rows, "key", ("page_id",), {"page_id": schemas.PATTERNS["page_id"]}, {"kind": schemas.BLOCK_TYPES}, {"score": (0.0, 1.0)})
    assert sorted(r["problem"] for r in found.collect()) == ["allowed", "pattern", "range", "required"]


def test_event_stream_agrees_with_batch(spark, tmp_path):
    rows = [(i, f"r{i % 3}", "render", "failed" if i % 7 == 0 else "completed", datetime(2024, 1, 1) + timedelta(minutes=7 * i), float(i)) for i in range(60)]
    schema = "event_id long, run_id string, stage_name string, status string, finished_at timestamp, value double"
    df = spark.createDataFrame(rows, schema)
    df.repartitionByRange(4, "finished_at").write.parquet(f"{tmp_path}/events")
    query = stream.window_counts(stream.read_events(spark, f"{tmp_path}/events", schema)).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination(120)
    streamed = {tuple(r) for r in spark.table("counts").collect()}
    assert streamed == {tuple(r) for r in stream.window_counts(df).collect()}
    assert stream.run_sessions(df).agg(F.sum("n")).first()[0] == 60 and stream.failures(df).count() == 9


def test_contents_by_title_and_by_number(spark):
    pages = spark.createDataFrame([("p0003", "Setup", 3), ("p0005", "Play", 5), ("p0006", "play", 6), ("p0007", "", 7)], "page_id string, title string, number int")
    entries = lambda rows: spark.createDataFrame(rows, "title string, page int, pos int")
    assert {tuple(r) for r in render.contents(entries([("SETUP", 1, 0), ("Play", 4, 1)]), pages).collect()} == {("p0003", 2), ("p0006", 2)}
    assert {tuple(r) for r in render.contents(entries([("x", 2, 0), ("y", 4, 1)]), pages).collect()} == {("p0003", 1), ("p0005", 1)}
    assert render.contents(entries([("x", 6, 0)]), pages).collect()[0]["offset"] == 0 and render.contents(entries([("x", 40, 0)]), pages).count() == 0


def test_render_rules(spark):
    rows = [("heading", "12."), ("callout", "x"), ("heading", "Real title"), ("figure", ""), ("divider", "")]
    assert [r["kind"] for r in render.render_blocks(blocks(spark, rows)).orderBy("nth").collect()] == ["heading", "heading", "figure"]
    assert render.render_pages(blocks(spark, rows)).first()["title"] == "Real title"
    images = spark.createDataFrame([("p", f"i{k}", k) for k in range(30)], "page_id string, image_id string, pos int")
    used = spark.createDataFrame([("p", "i0"), ("p", "i1")], "page_id string, asset_id string")
    assert render.inject_figures(used, images).count() == 18
    inlines = spark.sql("SELECT array(named_struct('type', 'icon', 'symbol_id', 'sym.art_1'), named_struct('type', 'icon', 'symbol_id', 'sym.ok'), named_struct('type', 'text', 'symbol_id', NULL)) AS c")
    assert inlines.select(F.size(render.visible_inlines(F.col("c")))).first()[0] == 2


def test_symbols_find_their_line(spark):
    lines = spark.createDataFrame([("p", 1, 0.0, 10.0), ("p", 2, 30.0, 40.0)], "page_id string, line int, y0 double, y1 double")
    symbols = spark.createDataFrame([("p", "a", 2.0, 12.0), ("p", "b", 14.0, 24.0), ("p", "c", 90.0, 99.0), ("q", "d", 0.0, 1.0)], "page_id string, symbol_id string, y0 double, y1 double")
    out = {r["symbol_id"]: (r["line"], r["anchor"]) for r in assets.nearest_lines(symbols, lines).collect()}
    assert out == {"a": (1, "inline"), "b": (1, "near_text"), "c": (2, "block"), "d": (None, "page")}


def test_stages_are_cached(spark, tmp_path):
    assert stages.stage_range("render", "publish") == ["render", "qa", "publish"]
    assert "translate" not in stages.stage_range(edition="en")
    for bad in (("nope", None), ("qa", "ingest")):
        with pytest.raises(ValueError):
            stages.stage_range(*bad)
    first = stages.Stage("ingest", "1", lambda s, t: s.range(3))
    second = lambda v: stages.Stage("render", v, lambda s, t: t["ingest"].where("id > 0"))
    runner = stages.Runner(spark, f"file://{tmp_path}/build")
    assert runner.run([first, second("1")])["render"].count() == 2
    runner.run([first, second("2")])
    assert [e[2] for e in runner.events] == ["completed", "completed", "cached", "completed"] and runner.event_table().count() == 4


def page_ir(spark, tmp_path):
    text = lambda t, **more: {"type": "text", "text": t, **more}
    icon = {"type": "icon", "symbol_id": "sym.a", "instance_id": "i1", "confidence": 0.5}
    page = {
        "document_id": "d", "page_id": "p0001", "reading_order": ["b1", "b1", "zz"],
        "blocks": [
            {"type": "heading", "block_id": "b1", "bbox": {"x0": 1.0, "y0": 2.0, "x1": 3.0, "y1": 4.0}, "children": [text("One.Two", source_word_ids=["w1", "w2"]), icon, text(" exam- ple")]},
            {"type": "divider", "block_id": "b2"},
        ],
    }
    (tmp_path / "page.json").write_text(json.dumps(page))
    return artifacts.read_json_table(spark, f"file://{tmp_path}/page.json", "page_ir")


def test_flat_ir_tables(spark, tmp_path):
    pages = page_ir(spark, tmp_path)
    flat = ir.blocks(pages).orderBy("pos").collect()
    assert [(r["block_id"], r["kind"], r["text"], r["x1"]) for r in flat] == [("b1", "heading", "One.Two exam- ple", 3.0), ("b2", "divider", "", None)]
    assert [r["type"] for r in ir.inlines(pages).orderBy("child").collect()] == ["text", "icon", "text"]
    assert {r["word_id"] for r in ir.source_words(pages).collect()} == {"w1", "w2"}
    assert ir.symbols(pages).first()["instance_id"] == "i1"
    assert tuple(ir.page_signals(pages).first()) == ("p0001", 0.5, 0.5)
    first = ir.blocks(pages).where("block_id = 'b1'")
    assert first.select(ir.inline_text(ir.normalized_inlines(F.col("children")))).first()[0] == "One. Two example"
    for at in (0, 3, 7, 9, 17):
        left, right = first.select(*[ir.inline_text(c) for c in ir.split_inlines(F.col("children"), F.lit(at))]).first()
        assert left == "One.Two exam- ple"[:at] and left + right == "One.Two exam- ple"


def test_mentions_by_one_pass_and_by_a_join(spark, monkeypatch):
    """Lemmas anywhere in a text, within one another too; a small dictionary needs no row for each stretch of three letters."""
    from folio.operators import terms

    texts = ["Alpha beta ALP", "x", "gam ma", "\u0416\u0423\u041a alphabet", "  "]
    blocks = spark.createDataFrame([("p1", f"b{i}", i, "paragraph", t) for i, t in enumerate(texts)], "page_id string, block_id string, pos int, kind string, text string")
    lemmas = [("c1", "alp"), ("c2", "Alphabet"), ("c3", "a"), ("c4", "\u0436\u0443"), ("c5", "a"), ("c6", "zz"), ("c7", None)]
    want = [sorted(c for c, w in lemmas if w and w.lower() in t.lower()) for t in texts if t.strip()]
    for most in (1 << 20, 0):
        monkeypatch.setattr(terms, "MOST_CHARS", most)
        plan = translate.plan_segments(blocks, spark.createDataFrame(lemmas, "concept_id string, lemma string"))
        assert [r["concept_ids"] for r in plan.orderBy("pos").collect()] == want
        assert ("gram" in plan._jdf.queryExecution().toString()) == (most == 0)
    assert [r["concept_ids"] for r in translate.plan_segments(blocks, spark.createDataFrame([], "concept_id string, lemma string")).collect()] == [[]] * 4


def test_inlines_are_split_in_one_pass(spark):
    """20,000 inlines: time that grows with their square takes minutes."""
    kind = F.when(F.col("id") % 3 == 2, "icon").otherwise("text")
    item = F.struct("id", F.struct(kind.alias("type"), F.when(F.col("id") % 5 < 4, F.lit("abc")).alias("text"), F.col("id").alias("n")).alias("c"))
    children = spark.range(20_000).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["c"]).alias("children")).checkpoint()
    began = time.monotonic()
    for at in (0, 10, 15_001, 10**6):
        left, right = ir.split_inlines(F.col("children"), F.lit(at))
        left, right, whole = children.select(left, right, "children").first()
        length = lambda c: len(c["text"] or "") if c["type"] == "text" else 0
        assert sum(map(length, left)) == min(at, sum(map(length, whole))) and sum(map(length, left + right)) == sum(map(length, whole))
        assert [c["n"] for c in left + right if c["n"] != (left[-1]["n"] if left else -1)] == [c["n"] for c in whole if c["n"] != (left[-1]["n"] if left else -1)]
    left, right = ir.split_inlines(F.col("children"), F.lit(None).cast("int"))
    assert children.select(left, right).first() == ([], [])
    assert time.monotonic() - began < 60


def test_native_tables(spark, tmp_path):
    box = lambda a, b, c, d: {"x0": a, "y0": b, "x1": c, "y1": d}
    page = {"page_id": "p0001", "dimensions_pt": {"width": 100.0, "height": 100.0}, "words": [{"word_id": "w1", "text": "a", "bbox": box(0.0, 0.0, 50.0, 10.0)}], "spans": [], "image_blocks": [{"image_id": "i1", "bbox": box(0.0, 0.0, 100.0, 100.0)}, {"image_id": "i2", "bbox": box(0.0, 0.0, 9.0, 9.0)}]}
    (tmp_path / "native.json").write_text(json.dumps(page))
    native = artifacts.read_json_table(spark, f"file://{tmp_path}/native.json", "native_page")
    assert ir.words(native).first()["x1"] == 50.0 and ir.spans(native).count() == 0
    assert [r["image_id"] for r in ir.images(native).collect()] == ["i1"] and ir.images(native, significant=False).count() == 2
    assert ir.text_coverage(native).first()["coverage"] == 0.05


def test_annotation_candidates_and_order_confidence(spark):
    schema = "page_id string, block_id string, kind string, text string, x0 double, y0 double, x1 double, y1 double, width double, height double"
    source = spark.createDataFrame([("p", "b1", "heading", "Title", -5.0, 0.0, 50.0, 10.0, 100.0, 200.0), ("p", "b2", "divider", "x", 0.0, 0.0, 1.0, 1.0, 100.0, 200.0), ("p", "b3", "note", "n", 0.0, 0.0, 1.0, 1.0, 100.0, 200.0)], schema)
    target = spark.createDataFrame([("p", "b1", "Titel")], "page_id string, block_id string, text string")
    out = {r["annotation_id"]: r for r in publish.annotation_candidates(source, target).collect()}
    assert set(out) == {"b1", "b3"} and tuple(out["b1"])[2:] == ("title", 100, "Title", "Titel", 0.0, 0.0, 0.5, 0.05) and (out["b3"]["priority"], out["b3"]["target"]) == (20, "")
    order = spark.createDataFrame([("p", "main", 1), ("p", "main", 1), ("p", "main", 2), ("p", "aside", None)], "page_id string, role string, band int")
    assert layout.order_confidence(order).first()["confidence"] == pytest.approx(0.82)
    moved = translate.translated_blocks(source, spark.createDataFrame([("b1", "Titel")], "segment_id string, target string"))
    assert {r["block_id"]: (r["text"], r["translated"]) for r in moved.collect()} == {"b1": ("Titel", True), "b2": ("x", False), "b3": ("n", False)}


def test_golden_and_ladder_tables(spark):
    golden = {"name": "g", "pages": [{"page_id": "p0001", "block_count": 2, "block_types": ["heading"], "reading_order": ["b1"]}]}
    assert config.golden_table(spark, golden).first()["expected"] == 2
    ladder = {"name": "l", "checkpoints": [{"order": 2, "golden_set": "b"}, {"order": 1, "golden_set": "a"}]}
    assert [r["golden_set"] for r in config.ladder_table(spark, ladder).collect()] == ["a", "b"]


def test_patches_have_no_group_a_page(spark):
    """Operations are gathered in a row beside their page, in their order; pages without any, and without an id, come through."""
    pages = spark.createDataFrame([("p1", "[1]"), ("p1", "[]"), ("p2", "no json"), (None, "[2]")], "page_id string, doc string")
    ops = [("p1", 2, "insert", "/0", "3"), ("p1", 1, "delete", "/0", None), (None, 1, "replace", "", "null"), ("p9", 1, "delete", "/0", None)]
    out = patch.apply_patches(pages, spark.createDataFrame(ops, "page_id string, ordinal int, op string, path string, value string"))
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()
    found = sorted(map(tuple, out.collect()), key=str)
    assert [(*r[:2], r[2] and r[2].split(":")[0]) for r in found] == sorted([("p1", "[3]", None), ("p1", "[]", "IndexError"), ("p2", "no json", None), (None, "null", None)], key=str)


def test_folds_have_no_group_a_page(spark):
    """Pages are exchanged packed and folded many at once; rows of a page may come in any order."""
    rows = [(f"p{p}", f"b{k}", k, "list_item" if k == 0 else "paragraph", "1." if k == 0 else f"t{k}", 0.0, 12.0 * k, 9.0, 12.0 * k + 10) for k in (2, 0, 1) for p in range(30)]
    out = structure.merge_list_continuations(spark.createDataFrame(rows, "page_id string, block_id string, pos int, kind string, text string, x0 double, y0 double, x1 double, y1 double"))
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == sorted((f"p{p}", "b0", 0, "list_item", "1. t1 t2", 0.0, 0.0, 9.0, 34.0) for p in range(30))


def test_reading_order_has_no_group_a_page(spark):
    """Main regions by bands, then from left to right; an aside by its nearest main region, furniture by none; many pages at once."""
    areas = [(3, "r3", "body", 300.0, 100.0, 500.0, 200.0), (1, "r1", "header", 0.0, 0.0, 500.0, 20.0), (4, "r4", "sidebar", 520.0, 100.0, 580.0, 200.0), (2, "r2", "body", 0.0, 110.0, 200.0, 190.0)]
    out = layout.reading_order(spark.createDataFrame([(f"p{p}", *a) for a in areas for p in range(20)], "page_id string, ordinal int, region_id string, kind string, x0 double, y0 double, x1 double, y1 double"))
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()
    want = [("r1", "furniture", None, None, None), ("r2", "main", 1, 1, None), ("r3", "main", 1, 2, None), ("r4", "aside", None, None, "r3")]
    assert sorted(map(tuple, out.collect()), key=lambda r: r[:2]) == sorted(((f"p{p}", *w) for w in want for p in range(20)), key=lambda r: r[:2])
