"""The registered queries over document tables, each with its oracle SQL where SQL can express it.

All read whole tables. Boxes are made from positions (see folio.sources.views).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import ids
from folio.functions import text as T
from folio.operators import assets, evaluate, layout, patch, publish, qa, registry, render, search, structure, terms, translate, verify
from folio.sources import views
from folio.sources.views import with_views
from folio.streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _finding(layer: str, severity: str, code: str, detail: str, where: str, source: str = "v_block") -> str:
    return f"SELECT '{layer}' AS layer, '{severity}' AS severity, '{code}' AS code, page_id, block_id AS entity_ref, CAST({detail} AS VARCHAR) AS detail FROM {source} WHERE {where}"


_LONG = _finding("structure", "warning", "PARAGRAPH_TOO_LONG", "length(text)", "kind = 'paragraph' AND length(text) > 1000")
_LATIN = "len(regexp_extract_all(text, '[a-zA-Z]'))"
_UNTRANSLATED = _finding("terminology", "error", "UNTRANSLATED_TEXT", _LATIN, f"length(text) >= 20 AND 10 * {_LATIN} > 5 * length(text)")
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda x: x <> ''))"
_DUPLICATE = f"""SELECT 'structure' AS layer, 'warning' AS severity, 'DUPLICATE_CONTENT' AS code, page_id, block_id AS entity_ref, block_before AS detail FROM (
    SELECT page_id, block_id, block_before, w, b, len(list_intersect(w, b)) AS i FROM (
        SELECT page_id, block_id, {_WORDS.format("text")} AS w, lag({_WORDS.format("text")}) OVER p AS b, lag(block_id) OVER p AS block_before FROM v_block WINDOW p AS (PARTITION BY page_id ORDER BY pos))
    WHERE b IS NOT NULL) WHERE CASE WHEN len(w) = 0 AND len(b) = 0 THEN TRUE ELSE 10 * i > 9 * (len(w) + len(b) - i) END"""


@query(f"{with_views('v_block')} {_LONG}")
def qa_paragraph_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.paragraph_length(views.blocks(spark, sf_dir))


@query(f"{with_views('v_block')} {_UNTRANSLATED}")
def qa_untranslated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.untranslated(views.blocks(spark, sf_dir))


_REF = "coalesce(nullif(regexp_extract(text, 'стр\\.?\\s*\\d+', 0), ''), nullif(regexp_extract(text, '(?i)\\bp\\.\\s*\\d+', 0), ''), nullif(regexp_extract(text, '(?i)\\bpage\\s+\\d+', 0), ''))"


@query(f"{with_views('v_defect')} {_finding('render', 'warning', 'DEAD_PAGE_REF', _REF, f'{_REF} IS NOT NULL', 'v_defect')}")
def qa_dead_page_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.dead_page_refs(views.defects(spark, sf_dir))


_LEAK = f"coalesce(nullif(regexp_extract(text, '{T.VERSIONED_ID}', 0), ''), nullif(regexp_extract(text, '\\bUNKNOWN\\b', 0), ''), CASE WHEN regexp_matches(text, '{T.CYRILLIC}') THEN nullif(regexp_extract(text, '{T.SNAKE_ID}', 0), '') END)"


@query(f"{with_views('v_defect')} {_finding('render', 'error', 'LEAKED_TECHNICAL_ID', _LEAK, f'{_LEAK} IS NOT NULL', 'v_defect')}")
def qa_leaked_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.leaked_identifiers(views.defects(spark, sf_dir))


def _reasons(rules: tuple[tuple[str, str], ...]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in rules) + ")"


_DECORATIVE = _reasons(T.DECORATIVE)
_GLUED_RULES = tuple(r for r in T.GLUED if r[0] != "repeat")  # DuckDB has no back references
_GLUED = _reasons(_GLUED_RULES)


@query(f"{with_views('v_defect')} {_finding('render', 'warning', 'DECORATIVE_ICON_LEAKED', _DECORATIVE, f'{_DECORATIVE} IS NOT NULL', 'v_defect')}")
def qa_decorative_icons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.decorative_icons(views.defects(spark, sf_dir))


@query(f"{with_views('v_defect')} {_finding('extraction', 'warning', 'GLUED_TEXT', _GLUED, f'{_GLUED} IS NOT NULL', 'v_defect')}")
def qa_glued_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.glued_text(views.defects(spark, sf_dir), _GLUED_RULES)


@query()
def qa_glued_text_with_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.glued_text(views.defects(spark, sf_dir))


@query(f"{with_views('v_block')} {_DUPLICATE}")
def qa_duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.duplicate_content(views.blocks(spark, sf_dir))


_THREE = f"f AS ({_LONG} UNION ALL {_UNTRANSLATED} UNION ALL {_DUPLICATE})"


def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.run_rules(views.blocks(spark, sf_dir), (qa.paragraph_length, qa.untranslated, qa.duplicate_content))


@query(f"{with_views('v_block')}, {_THREE} SELECT " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in qa.SEVERITIES) + " FROM f")
def qa_tally_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.tally_by_severity(_three(spark, sf_dir))


@query(f"{with_views('v_block')}, {_THREE} SELECT code, severity, count(*) AS n FROM f GROUP BY ALL")
def qa_tally_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.tally_by_code(_three(spark, sf_dir))


def _waivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waivers made from labels: each labelled document waives long paragraphs on its page, and some waive duplicates anywhere."""
    rows = views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ordinal"), F.format_string("w%d", "doc_id").alias("waiver_id"), "doc_id")
    own = rows.select("ordinal", "waiver_id", F.lit("PARAGRAPH_TOO_LONG").alias("code"), ids.page_id(F.col("doc_id")).alias("page_id"))
    wide = views.table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("ordinal"), F.format_string("w%d", "doc_id").alias("waiver_id")).select((F.col("ordinal") + 1000000).alias("ordinal"), "waiver_id", F.lit("DUPLICATE_CONTENT").alias("code"), F.lit(None).cast("string").alias("page_id"))
    return own.unionByName(wide)


_WAIVED = f"""{with_views('v_block')}, {_THREE}, w AS (
    SELECT doc_id AS ordinal, 'w' || doc_id AS waiver_id, 'PARAGRAPH_TOO_LONG' AS code, printf('p%04d', doc_id) AS page_id FROM labels
    UNION ALL SELECT doc_id + 1000000, 'w' || doc_id, 'DUPLICATE_CONTENT', NULL FROM labels WHERE quality = 0
), x AS (
    SELECT f.*, (SELECT arg_min(w.waiver_id, w.ordinal) FROM w WHERE w.code = f.code AND (w.page_id IS NULL OR w.page_id = f.page_id)) AS waiver_id FROM f
)"""


@query(f"{_WAIVED} SELECT *, waiver_id IS NOT NULL AS waived FROM x")
def qa_waived_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.apply_waivers(_three(spark, sf_dir), _waivers(spark, sf_dir))


@query(f"{_WAIVED} SELECT count(*) AS total, count(waiver_id) AS waived, count(*) FILTER (severity IN ('error', 'critical') AND waiver_id IS NULL) AS blocking FROM x")
def qa_review_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.review_pack(qa.apply_waivers(_three(spark, sf_dir), _waivers(spark, sf_dir)))[0]


@query(f"""{with_views('v_word')}, s AS (SELECT page_id, count(*) AS n FROM v_word WHERE length(word) > 9 GROUP BY 1), t AS (SELECT page_id, count(*) AS n FROM v_word WHERE length(word) > 9 AND wpos % 50 <> 7 GROUP BY 1)
    SELECT 'icon_symbol' AS layer, 'error' AS severity, 'ICON_COUNT_SRC_TGT_MISMATCH' AS code, page_id, page_id AS entity_ref, coalesce(s.n, 0) || ':' || coalesce(t.n, 0) AS detail
    FROM s FULL JOIN t USING (page_id) WHERE coalesce(s.n, 0) <> coalesce(t.n, 0)""")
def qa_icon_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long words as icons; the target has the same rows, some of them without their icon."""
    icons = views.words(spark, sf_dir).where("length(word) > 9").select("page_id", "wpos", F.col("word").alias("icon"))
    return qa.icon_count(icons, icons.withColumn("icon", F.when(F.col("wpos") % 50 != 7, F.col("icon"))))


@query(f"""{with_views('v_word')} SELECT 'XREF_NATIVE_WORD' AS code, 'error' AS severity, page_id, block_id AS entity_ref, printf('%s.w%04d', block_id, wpos + 1) AS target FROM v_word a
    WHERE NOT EXISTS (SELECT 1 FROM v_word b WHERE b.page_id = a.page_id AND b.word_id = printf('%s.w%04d', a.block_id, a.wpos + 1))""")
def verify_native_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = views.words(spark, sf_dir)
    refs = words.select("page_id", F.col("block_id").alias("entity_ref"), F.format_string("%s.w%04d", "block_id", F.col("wpos") + 1).alias("word_id"))
    return verify.native_words(refs, words)


@query(f"""{with_views('v_word')}, m AS (SELECT DISTINCT page_id, CASE WHEN wpos % 2 = 0 THEN word ELSE '~' || word END AS s FROM v_word), p AS (SELECT DISTINCT page_id, CASE WHEN wpos % 3 = 0 THEN word ELSE '~' || word END AS s FROM v_word)
    SELECT 'XREF_SYMBOL_TO_IR' AS code, 'error' AS severity, page_id, s AS entity_ref, s AS target FROM (FROM p EXCEPT FROM m)
    UNION ALL SELECT 'XREF_SYMBOL_DROPPED', 'warning', page_id, s, s FROM (FROM m EXCEPT FROM p)""")
def verify_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words as symbols, on both sides: marked by one rule where they are matched, by another where they are placed."""
    words = views.words(spark, sf_dir)
    side = lambda n: words.select("page_id", F.when(F.col("wpos") % n == 0, F.col("word")).otherwise(F.concat(F.lit("~"), "word")).alias("symbol_id"))
    return verify.symbols(side(2), side(3))


@query(f"""{with_views('v_block')} SELECT 'DANGLING_REGION_REF' AS code, 'error' AS severity, page_id, block_id AS entity_ref, printf('r%03d', pos % 7) AS target FROM v_block a
    WHERE NOT EXISTS (SELECT 1 FROM v_block b WHERE b.page_id = a.page_id AND (2 * b.pos) % 9 = a.pos % 7)""")
def verify_dangling_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = views.blocks(spark, sf_dir).withColumn("region_id", ids.region_id(F.col("pos") % 7))
    return verify.dangling_regions(blocks, blocks.withColumn("region_id", ids.region_id((2 * F.col("pos")) % 9)))


@query(f"""{with_views('v_block')} SELECT 'ORPHAN_CAPTION' AS code, 'warning' AS severity, page_id, block_id AS entity_ref, block_id AS target FROM v_block WHERE pos % 3 = 1 AND pos % 4 <> 1""")
def verify_orphan_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = views.blocks(spark, sf_dir)
    captions = blocks.withColumn("kind", F.when(F.col("pos") % 3 == 1, "caption").otherwise(F.col("kind")))
    edges = blocks.select("page_id", F.when(F.col("pos") % 4 == 1, "caption").otherwise("aside").alias("edge_kind"), F.col("block_id").alias("source_id"))
    return verify.orphan_captions(captions, edges)


@query(f"""{with_views('v_word')} SELECT 'DUPLICATE_SYMBOL_INSTANCE' AS code, 'error' AS severity, page_id, word AS entity_ref, CAST(nth AS VARCHAR) AS target
    FROM (SELECT page_id, word, row_number() OVER (PARTITION BY page_id, word ORDER BY pos * 100000 + wpos) AS nth FROM v_word WHERE length(word) > 8) WHERE nth > 1""")
def verify_duplicate_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = views.words(spark, sf_dir).where("length(word) > 8")
    return verify.duplicate_instances(words.select("page_id", F.col("word").alias("instance_id"), (F.col("pos") * 100000 + F.col("wpos")).alias("pos")))


@query(f"{with_views('v_word')} SELECT 'BBOX_OUT_OF_PAGE' AS code, 'error' AS severity, page_id, word_id AS entity_ref, CAST(NULL AS VARCHAR) AS target FROM v_word WHERE x1 > 560 OR y1 > 400")
def verify_boxes_out_of_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = views.words(spark, sf_dir).withColumns({"entity_ref": F.col("word_id"), "width": F.lit(560), "height": F.lit(400)})
    return verify.boxes_out_of_page(words)


@query(f"""{with_views('v_block')}, n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY page_id) AS n FROM v_block),
    e AS (SELECT page_id, i AS s, (i * 7 + 3) % n AS t, n FROM n WHERE (i * 7 + 3) % n > i OR i % 6 = 5)
    SELECT DISTINCT page_id FROM (
        WITH RECURSIVE r(page_id, o, p, d, n) AS (SELECT page_id, s, t, 1, n FROM e UNION ALL SELECT r.page_id, r.o, e.t, d + 1, r.n FROM r JOIN e ON e.page_id = r.page_id AND e.s = r.p WHERE r.p <> r.o AND d <= r.n)
        SELECT page_id FROM r WHERE p = o)""")
def verify_anchor_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("page_id")
    nodes = views.blocks(spark, sf_dir).select("page_id", (F.row_number().over(w.orderBy("pos")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    edges = nodes.withColumn("t", (F.col("i") * 7 + 3) % F.col("n"))
    kind = F.when((F.col("t") > F.col("i")) | (F.col("i") % 6 == 5), "aside").otherwise("flow")
    return verify.anchor_cycles(edges.select("page_id", kind.alias("edge_kind"), F.col("i").cast("long").alias("source_id"), F.col("t").alias("target_id")))


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY ALL")
def registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return registry.latest(events, ["user_id", "event_type"], "ts", "event_id")


@query(f"{with_views('v_event')} SELECT cache_key, max(finished_at) AS finished_at, arg_max(event_id, (finished_at, event_id)) AS event_id FROM v_event WHERE status = 'completed' GROUP BY 1")
def registry_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.cache_lookup(views.stage_events(spark, sf_dir))


@query(f"""{with_views('v_event')} SELECT run_id, count(*) AS n_events, count(DISTINCT CASE WHEN status = 'completed' THEN stage_name END) AS stages_completed, count(*) FILTER (status = 'failed') AS failures,
    min(finished_at) AS started_at, max(finished_at) AS finished_at, arg_max(stage_name, (finished_at, event_id)) AS last_stage, arg_max(status, (finished_at, event_id)) AS last_status FROM v_event GROUP BY 1""")
def registry_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.run_summary(views.stage_events(spark, sf_dir))


@query(f"{with_views('v_event')} SELECT run_id, max(finished_at) AS finished_at, count(*) AS n_events FROM v_event GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def registry_run_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.run_listing(views.stage_events(spark, sf_dir))


@query(f"""{with_views('v_event')} SELECT run_id, event_id, stage_name, status, CAST(row_number() OVER w AS INTEGER) AS nth,
    CAST(floor(epoch(finished_at)) - floor(epoch(lag(finished_at) OVER w)) AS BIGINT) AS gap_s FROM v_event WINDOW w AS (PARTITION BY run_id ORDER BY finished_at, event_id)""")
def registry_stage_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.stage_listing(views.stage_events(spark, sf_dir))


@query(f"""{with_views('v_event')} SELECT run_id, CAST(sum(good) AS BIGINT) AS streak FROM (
    SELECT run_id, min(CASE WHEN status <> 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY finished_at, event_id ROWS UNBOUNDED PRECEDING) AS good FROM v_event) GROUP BY 1""")
def registry_passing_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.passing_streaks(views.stage_events(spark, sf_dir))


@query(f"{with_views('v_event')} SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY finished_at, event_id) AS INTEGER) AS nth, stage_name || ':' || status AS stage FROM v_event")
def registry_run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.run_manifest(views.stage_events(spark, sf_dir))


@query(f"{with_views('v_event')} SELECT run_id, min(event_id) AS event_id FROM v_event WHERE stage_name = 'click' AND status IN ('completed', 'cached') GROUP BY 1")
def registry_first_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.first_result(views.stage_events(spark, sf_dir), "click")


@query("SELECT source, printf('p%04d', doc_id) AS page_id, lag(printf('p%04d', doc_id)) OVER w AS prev_page, lead(printf('p%04d', doc_id)) OVER w AS next_page FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def nav_prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.table(spark, sf_dir, "documents").select("source", "doc_id", ids.page_id(F.col("doc_id")).alias("page_id"))
    return search.navigation(pages, "source", "doc_id").drop("doc_id")


@query(f"{with_views('v_block')} SELECT block_id, last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM v_block")
def nav_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.section_of(views.blocks(spark, sf_dir), ["pos"]).select("block_id", "section")


_FURNITURE = """l AS (SELECT page_id, CASE WHEN pos = min(pos) OVER p THEN 'top' WHEN pos = max(pos) OVER p THEN 'bottom' ELSE 'body' END AS zone, lower(trim(text)) AS text FROM v_block WINDOW p AS (PARTITION BY page_id)),
    g AS (SELECT zone, text, count(DISTINCT page_id) AS n_pages FROM l WHERE zone <> 'body' AND text <> '' AND NOT regexp_matches(text, '^[0-9]+$') GROUP BY 1, 2)
    SELECT * FROM g WHERE 100 * n_pages >= 2 * (SELECT count(DISTINCT page_id) FROM l WHERE zone <> 'body')"""


@query(f"{with_views('v_block')}, {_FURNITURE}")
def layout_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("page_id")
    zone = F.when(F.col("pos") == F.min("pos").over(w), "top").when(F.col("pos") == F.max("pos").over(w), "bottom").otherwise("body")
    return layout.furniture(views.blocks(spark, sf_dir).withColumn("zone", zone).where("zone <> 'body'"), share_percent=2)


def _block_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as layout items: a category and a box by rules on the block's number and length, on pages of 600 points width."""
    b = views.blocks(spark, sf_dir)
    x0 = (F.col("pos") % 3) * 180 + 20
    width = F.when(F.col("pos") % 11 == 10, 560).otherwise(F.least(F.length("text"), F.lit(150)))
    y0 = 30 + 13 * F.col("pos") + (F.col("pos") / 5).cast("int") * 12
    category = F.when(F.col("pos") % 11 == 10, "image").when(F.col("pos") % 7 == 6, "vector").otherwise("text")
    return b.select("page_id", "block_id", F.col("block_id").alias("item_id"), "pos", "kind", "text", category.alias("category"), F.when(F.col("pos") % 11 == 10, 20).otherwise(x0).cast("double").alias("x0"), y0.cast("double").alias("y0"), (F.when(F.col("pos") % 11 == 10, 20).otherwise(x0) + width).cast("double").alias("x1"), (y0 + 10).cast("double").alias("y1"), F.lit(600.0).alias("width"))


_ITEM = """i AS (SELECT page_id, block_id, block_id AS item_id, pos, kind, text, CASE WHEN pos % 11 = 10 THEN 'image' WHEN pos % 7 = 6 THEN 'vector' ELSE 'text' END AS category,
    CAST(CASE WHEN pos % 11 = 10 THEN 20 ELSE (pos % 3) * 180 + 20 END AS DOUBLE) AS x0, CAST(30 + 13 * pos + (pos // 5) * 12 AS DOUBLE) AS y0,
    CAST(CASE WHEN pos % 11 = 10 THEN 580 ELSE (pos % 3) * 180 + 20 + least(length(text), 150) END AS DOUBLE) AS x1, CAST(40 + 13 * pos + (pos // 5) * 12 AS DOUBLE) AS y1, 600.0 AS width FROM v_block),
    pl AS (SELECT *, CASE WHEN y1 <= 60 THEN 'header' WHEN y0 >= 750 THEN 'footer' WHEN category IN ('image', 'vector', 'table') AND (x1 - x0) / width >= 0.85 THEN 'full_width' ELSE 'content' END AS place FROM i)"""
_BOUNDS = """bd AS (SELECT DISTINCT page_id, CAST(y AS DOUBLE) AS y FROM (
        SELECT page_id, unnest([bottom, y0]) AS y FROM (SELECT page_id, y0, greatest(60.0, coalesce(max(y1) OVER (PARTITION BY page_id ORDER BY y0, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 60.0)) AS bottom FROM pl WHERE place = 'content') WHERE y0 - bottom >= 15
        UNION ALL SELECT page_id, unnest([y0, y1]) FROM pl WHERE place = 'full_width'
        UNION ALL SELECT page_id, unnest([60.0, 750.0]) FROM (SELECT DISTINCT page_id FROM pl WHERE place IN ('content', 'full_width'))))"""


@query(f"{with_views('v_block')}, {_ITEM}, {_BOUNDS} SELECT * FROM bd")
def layout_band_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.band_boundaries(layout.split_furniture(_block_boxes(spark, sf_dir)))


_BANDS = """sp AS (SELECT * FROM (SELECT page_id, y AS f, lead(y) OVER (PARTITION BY page_id ORDER BY y) AS t, row_number() OVER (PARTITION BY page_id ORDER BY y) AS nth FROM bd) WHERE t IS NOT NULL),
    c AS (SELECT *, (y0 + y1) / 2 AS cy FROM pl WHERE place = 'content'),
    ins AS (SELECT c.*, nth FROM c JOIN sp ON sp.page_id = c.page_id AND cy BETWEEN f AND t),
    al AS (SELECT * FROM ins UNION ALL SELECT c.*, 2147483647 FROM c WHERE NOT EXISTS (SELECT 1 FROM ins WHERE ins.page_id = c.page_id AND ins.item_id = c.item_id))"""


@query(f"{with_views('v_block')}, {_ITEM}, {_BOUNDS}, {_BANDS} SELECT page_id, item_id, CAST(dense_rank() OVER (PARTITION BY page_id ORDER BY nth) AS INTEGER) AS band FROM al")
def layout_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.bands(layout.split_furniture(_block_boxes(spark, sf_dir))).select("page_id", "item_id", "band")


@query()
def layout_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.regions(_block_boxes(spark, sf_dir)).withColumn("item_ids", F.array_join("item_ids", ","))


@query()
def layout_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(layout.regions(_block_boxes(spark, sf_dir)))


@query(f"""{with_views('v_word')}, h AS (SELECT page_id, least(greatest(x0 * 10 // 600, 0), 9) AS bin, count(*) AS n FROM v_word GROUP BY 1, 2), t AS (SELECT page_id, sum(n) AS total FROM h GROUP BY 1),
    g AS (SELECT t.page_id, b.b, t.total, coalesce(sum(n) FILTER (bin = b.b), 0) AS here, coalesce(sum(n) FILTER (bin < b.b), 0) AS l, coalesce(sum(n) FILTER (bin > b.b), 0) AS r FROM t CROSS JOIN (SELECT unnest([3, 4, 5, 6]) AS b) b JOIN h USING (page_id) GROUP BY 1, 2, 3)
    SELECT page_id, CASE WHEN bool_or(50 * here < total AND 5 * l >= total AND 5 * r >= total) THEN 2 ELSE 1 END AS columns FROM g GROUP BY 1""")
def layout_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.columns_of_pages(views.words(spark, sf_dir), 600.0)


_AREAS = ((1, "header", 0, 0, 600, 60), (2, "body", 0, 60, 400, 750), (3, "sidebar", 380, 60, 600, 750), (4, "footer", 0, 750, 600, 800))


@query(f"""{with_views('v_block')}, {_ITEM}, a AS (SELECT * FROM (VALUES {', '.join(f"({o}, 'r{o:03d}', {x0}, {y0}, {x1}, {y1})" for o, _, x0, y0, x1, y1 in _AREAS)}) v(o, region_id, a, b, c, d))
    SELECT page_id, block_id, (SELECT arg_min(region_id, o) FROM a WHERE (x0 + x1) / 2 BETWEEN a AND c AND (y0 + y1) / 2 BETWEEN b AND d) AS region_id FROM i""")
def layout_region_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _block_boxes(spark, sf_dir)
    areas = F.array(*[F.struct(F.lit(o).alias("ordinal"), F.lit(f"r{o:03d}").alias("region_id"), *[F.lit(float(v)).alias(c) for v, c in zip(b, ("x0", "y0", "x1", "y1"), strict=True)]) for o, _, *b in _AREAS])
    regions = blocks.select("page_id").distinct().select("page_id", F.inline(areas))
    return layout.assign_to_regions(blocks, regions).select("page_id", "block_id", "region_id")


@query(f"""{with_views('v_block')}, {_ITEM}, k AS (SELECT *, CASE WHEN pos % 6 = 2 THEN 'figure' ELSE kind END AS k FROM i), n AS (
    SELECT p.page_id, p.block_id, p.pos, arg_min(f.block_id, (p.y0 - f.y1, f.pos)) AS figure_id FROM k p JOIN k f ON p.page_id = f.page_id
    WHERE f.k = 'figure' AND p.k = 'paragraph' AND length(p.text) <= 200 AND p.y0 - f.y1 BETWEEN 0 AND 25 AND p.x0 <= f.x1 AND f.x0 <= p.x1 GROUP BY 1, 2, 3)
    SELECT page_id, figure_id, arg_min(block_id, pos) AS caption_id FROM n GROUP BY 1, 2""")
def layout_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.captions(_block_boxes(spark, sf_dir).withColumn("kind", F.when(F.col("pos") % 6 == 2, "figure").otherwise(F.col("kind"))))


@query()
def layout_vector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.vector_clusters(_block_boxes(spark, sf_dir).withColumn("path_id", F.col("block_id")), margin=4.0)


@query(f"""{with_views('v_word')} SELECT page_id, word_id, CAST(sum(new) OVER (PARTITION BY page_id ORDER BY y, x0, word_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line FROM (
    SELECT *, CASE WHEN lag(y) OVER w IS NULL OR abs(y - lag(y) OVER w) >= 3 THEN 1 ELSE 0 END AS new FROM (SELECT *, y0 + (wpos % 3) * 2 AS y FROM v_word) WINDOW w AS (PARTITION BY page_id ORDER BY y, x0, word_id))""")
def structure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = views.words(spark, sf_dir).withColumn("y0", F.col("y0") + (F.col("wpos") % 3) * 2).withColumn("span_id", F.col("word_id"))
    return structure.lines_by_chain(spans).select("page_id", "word_id", "line")


@query(f"""{with_views('v_word')}, b AS (SELECT page_id, word_id, pos * 100000 + wpos AS pos, length(word) <= 3 AS short FROM v_word),
    c AS (SELECT *, CASE WHEN short <> coalesce(lag(short) OVER (PARTITION BY page_id ORDER BY pos), FALSE) THEN 1 ELSE 0 END AS ch FROM b), d AS (SELECT *, sum(ch) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS isl FROM c)
    SELECT page_id, word_id FROM (SELECT *, count(*) OVER (PARTITION BY page_id, isl) AS run FROM d) WHERE NOT short OR run < 3""")
def structure_heading_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = views.words(spark, sf_dir)
    blocks = words.select("page_id", "word_id", (F.col("pos") * 100000 + F.col("wpos")).alias("pos"), F.when(F.length("word") <= 3, "heading").otherwise("paragraph").alias("kind"), F.col("word").alias("text"))
    return structure.drop_heading_clusters(blocks).select("page_id", "word_id")


@query(f"""{with_views('v_block')} SELECT block_id FROM (SELECT block_id, substring(text, 1, 80) AS k, lag(substring(text, 1, 80)) OVER (PARTITION BY page_id ORDER BY pos) AS b FROM v_block) WHERE b IS NULL OR k = '' OR k <> b""")
def structure_repeats_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.drop_repeated(views.blocks(spark, sf_dir)).select("block_id")


@query()
def structure_recent_repeats_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.drop_recent_repeats(views.blocks(spark, sf_dir)).select("block_id")


@query()
def structure_split_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.split_long(views.blocks(spark, sf_dir)).select("page_id", "block_id", "part", "text")


@query()
def structure_list_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _block_boxes(spark, sf_dir).withColumn("kind", F.when(F.col("pos") % 4 == 0, "list_item").otherwise("paragraph"))
    return structure.merge_list_continuations(blocks.select("page_id", "block_id", "pos", "kind", "text", "x0", "y0", "x1", "y1"))


@query(f"""{with_views('v_block')}, {_ITEM}, k AS (SELECT *, CASE WHEN pos % 7 >= 5 THEN 'r' || (pos // 7) END AS r FROM i), s AS (SELECT *, CASE WHEN r IS NULL OR r IS DISTINCT FROM lag(r) OVER (PARTITION BY page_id ORDER BY pos) THEN 1 ELSE 0 END AS new FROM k),
    g AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS isl FROM s)
    SELECT page_id, arg_min(block_id, pos) AS block_id, min(pos) AS pos, CASE WHEN max(r) IS NOT NULL THEN 'callout' ELSE arg_min(kind, pos) END AS kind, max(r) AS region_id, string_agg(text, ' ' ORDER BY pos) AS text FROM g GROUP BY page_id, isl""")
def structure_callouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.col("pos") % 7 >= 5
    blocks = _block_boxes(spark, sf_dir).withColumn("region_id", F.when(inside, F.concat(F.lit("r"), (F.col("pos") / 7).cast("int").cast("string")))).withColumn("region_kind", F.when(inside, "callout_area").otherwise("body"))
    return structure.promote_callouts(blocks)


@query(f"""{with_views('v_word')}, t AS (SELECT page_id, block_id, word, word_id, x0, x1, y0, y1, length(word) > 9 AS icon FROM v_word)
    SELECT i.page_id, i.block_id, i.word_id AS icon_id, count(*) FILTER (w.x1 < i.x0) AS before FROM t i JOIN t w ON w.page_id = i.page_id AND w.block_id = i.block_id AND NOT w.icon WHERE i.icon GROUP BY 1, 2, 3""")
def structure_icon_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = views.words(spark, sf_dir)
    icon = F.length("word") > 9
    return structure.place_icons(words.where(~icon), words.where(icon).withColumn("icon_id", F.col("word_id")), tolerance=-4.0)


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A concept registry stand-in: the words that occur at least 5 times in the benchmark's texts."""
    words = views.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).alias("form"))
    return words.groupBy("form").count().where("count >= 5").select(F.concat(F.lit("c."), "form").alias("concept_id"), "form")


@query()
def glossary_term_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.match_terms(views.blocks(spark, sf_dir), _terms(spark, sf_dir))


_TERMS = "tm AS (SELECT form FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS form FROM benchmark) GROUP BY 1 HAVING count(*) >= 5)"
_DOC_TERMS = "dt AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents)"


@query(f"WITH {_TERMS}, {_DOC_TERMS} SELECT 'c.' || form AS concept_id, printf('p%04d', doc_id) AS page_id FROM tm JOIN dt ON term = form")
def glossary_page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.postings(views.table(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id", "text")
    mentions = index.join(_terms(spark, sf_dir), F.col("term") == F.col("form")).select("concept_id", ids.page_id(F.col("key")).alias("page_id"))
    return search.page_references(mentions)


@query(f"""{with_views('v_block')}, b AS (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS br FROM v_block),
    n AS (SELECT *, row_number() OVER w - CASE WHEN first_value(kind) OVER w = 'heading' THEN 1 ELSE 0 END AS nth, first_value(kind) OVER w AS o FROM b WINDOW w AS (PARTITION BY page_id, br ORDER BY pos)),
    g AS (SELECT page_id, br, CASE WHEN o = 'heading' AND nth <= 3 THEN 0 ELSE nth + 3 END AS gr, string_agg(block_id, '|' ORDER BY pos) AS ids, count(*) AS n, string_agg(trim(text), ' ' ORDER BY pos) AS text FROM n GROUP BY ALL)
    SELECT page_id, 'chunk.' || substring(page_id, 2) || '.' || substring(sha256(ids), 1, 8) AS anchor, CAST(n AS INTEGER) AS n_blocks, text FROM g""")
def search_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.chunks(views.blocks(spark, sf_dir)).drop("block_ids")


@query("WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY 1")
def search_term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.term_statistics(search.postings(views.table(spark, sf_dir, "documents"), "doc_id", "text"))


_BM25 = """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS l FROM documents), p AS (SELECT doc_id, len(l) AS length, unnest(l) AS term FROM t), i AS (SELECT doc_id, term, count(*) AS tf, any_value(length) AS length FROM p GROUP BY 1, 2),
    s AS (SELECT count(*) AS n, avg(length) AS mean FROM (SELECT doc_id, any_value(length) AS length FROM i GROUP BY 1)), d AS (SELECT term, count(*) AS df FROM i GROUP BY 1),
    q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark)),
    x AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM q JOIN i USING (term) JOIN d USING (term) CROSS JOIN s GROUP BY 1, 2)
    SELECT query_id, rank, key, score FROM (SELECT item_id AS query_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id AS key, score FROM x) WHERE rank <= 10"""


@query(_BM25)
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = search.postings(views.table(spark, sf_dir, "benchmark"), "item_id", "text").select(F.col("key").alias("query_id"), "term")
    return search.bm25(views.table(spark, sf_dir, "documents"), "doc_id", "text", queries)


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 1), lambda w: regexp_replace(w, '^[.,;:!?]+|[.,;:!?]+$', '', 'g')))), '|') AS terms FROM documents""")
def search_document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_documents(views.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.array_join("terms", "|").alias("terms"))


_METRICS = f"""{with_views('v_block')}, sp AS (SELECT doc_id, printf('p%04d', doc_id) AS page_id, n_chars % 12 + 1 AS expected, CASE WHEN doc_id % 2 = 0 THEN ['heading', 'paragraph'] ELSE ['paragraph'] END AS want FROM documents),
    a AS (SELECT page_id, count(*) AS n, list_distinct(list(kind)) AS kinds FROM v_block GROUP BY 1),
    m AS (SELECT 'block_count' AS metric, CASE WHEN coalesce(n, 0) = expected THEN 1.0 ELSE 0.0 END AS value, coalesce(n, 0) = expected AS passed FROM sp LEFT JOIN a USING (page_id)
        UNION ALL SELECT 'type_coverage', len(list_intersect(want, coalesce(kinds, []))) / len(want), len(list_intersect(want, coalesce(kinds, []))) = len(want) FROM sp LEFT JOIN a USING (page_id))"""


@query(f"{_METRICS} SELECT metric, count(*) AS n, avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) AS pass_rate, avg(CAST(value AS DOUBLE)) AS mean FROM m GROUP BY GROUPING SETS ((metric), ())")
def eval_metric_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = views.blocks(spark, sf_dir)
    specs = views.table(spark, sf_dir, "documents").select(ids.page_id(F.col("doc_id")).alias("page_id"), (F.col("n_chars") % 12 + 1).alias("expected"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("heading"), F.lit("paragraph"))).otherwise(F.array(F.lit("paragraph"))).alias("block_types"))
    return evaluate.aggregate(evaluate.block_count(specs, blocks).unionByName(evaluate.type_coverage(specs, blocks)))


@query("""WITH s AS (SELECT doc_id, (n_chars % 100) / 128.0 AS c, (n_chars % 8) / 8.0 AS o, coalesce(quality, 0) / 2.0 AS q FROM documents LEFT JOIN labels USING (doc_id)),
    v AS (SELECT doc_id, round_even(greatest(0.0, least(1.0, 0.30 * CASE WHEN c >= 0.7 THEN 1.0 WHEN c <= 0.1 THEN 0.0 ELSE (c - 0.1) / (0.7 - 0.1) END + 0.35 * o + 0.35 * q)), 4) AS confidence FROM s)
    SELECT doc_id, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN confidence >= 0.85 THEN 'primary' WHEN confidence >= 0.6 THEN 'hard_route' WHEN confidence >= 0.3 THEN 'qa' ELSE 'block' END AS band FROM v""")
def eval_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "documents").join(views.table(spark, sf_dir, "labels"), "doc_id", "left")
    value = evaluate.page_confidence((F.col("n_chars") % 100) / 128.0, (F.col("n_chars") % 8) / 8.0, F.coalesce("quality", F.lit(0)) / 2.0)
    return rows.select("doc_id", value.alias("confidence")).withColumn("band", evaluate.confidence_band(F.col("confidence")))


@query(f"""{with_views('v_block')}, a AS (SELECT page_id, block_id, kind FROM v_block), e AS (SELECT page_id, CASE WHEN pos % 7 = 0 THEN block_id || '.1' ELSE block_id END AS block_id, CASE WHEN pos % 3 = 0 THEN 'table' ELSE kind END AS kind FROM v_block)
    SELECT page_id, block_id, CASE WHEN a.kind IS NULL THEN 'missing' WHEN e.kind IS NULL THEN 'extra' WHEN a.kind = e.kind THEN 'match' ELSE 'type_mismatch' END AS status FROM a FULL JOIN e USING (page_id, block_id)""")
def eval_compare_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks against a specification of all blocks, in which some have another name or kind."""
    blocks = views.blocks(spark, sf_dir)
    name = F.when(F.col("pos") % 7 == 0, F.concat("block_id", F.lit(".1"))).otherwise(F.col("block_id"))
    return evaluate.compare_blocks(blocks, blocks.withColumn("kind", F.when(F.col("pos") % 3 == 0, "table").otherwise(F.col("kind"))).withColumn("block_id", name))


@query(f"""{with_views('v_block')}, b AS ({_LONG}), a AS ({_LONG.replace('> 1000', '> 600')} UNION ALL {_UNTRANSLATED})
    SELECT code, coalesce(x.n, 0) AS before, coalesce(y.n, 0) AS after, coalesce(y.n, 0) - coalesce(x.n, 0) AS change FROM (SELECT code, count(*) AS n FROM b GROUP BY 1) x FULL JOIN (SELECT code, count(*) AS n FROM a GROUP BY 1) y USING (code)""")
def eval_audit_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = views.blocks(spark, sf_dir)
    return evaluate.audit_delta(qa.paragraph_length(blocks), qa.paragraph_length(blocks, 600).unionByName(qa.untranslated(blocks)))


@query("""WITH c AS (SELECT user_id AS ladder, event_id AS "order", event_id % 6 <> 5 AS passed FROM events)
    SELECT ladder, "order", passed, min(CASE WHEN passed THEN 1 ELSE 0 END) OVER (PARTITION BY ladder ORDER BY "order" ROWS UNBOUNDED PRECEDING) = 1 AS frontier, min("order") FILTER (NOT passed) OVER (PARTITION BY ladder) AS first_failure FROM c""")
def eval_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("ladder"), F.col("event_id").alias("order"), (F.col("event_id") % 6 != 5).alias("passed"))
    return evaluate.ladder(rows)


_NORMAL = f"regexp_replace(text, '{T.CONTROL}', '', 'g')"
_NORMAL = f"regexp_replace({_NORMAL}, '(^|[^a-zA-Z])((?i:{'|'.join(T.COMPOUND_PREFIXES)}))- ([a-z])', '\\1\\2-\\3' || chr(1), 'g')"
_NORMAL = f"replace(regexp_replace({_NORMAL}, '([a-zA-Z])- ([a-z])', '\\1\\2', 'g'), chr(1), '')"
_NORMAL = f"regexp_replace({_NORMAL}, '([a-z])([.!?])([A-Z])', '\\1\\2 \\3', 'g')"


@query(f"{with_views('v_defect')} SELECT block_id, {_NORMAL} AS text FROM v_defect")
def text_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.defects(spark, sf_dir).select("block_id", T.normalize(F.col("text")).alias("text"))


@query(f"""{with_views('v_defect')}, e AS (SELECT block_id, list_transform(regexp_extract_all(text, '{T.TOC_ENTRY}', 1), lambda x: trim(x)) AS t, regexp_extract_all(text, '{T.TOC_ENTRY}', 2) AS p FROM v_defect)
    SELECT block_id, unnest(t) AS title, CAST(unnest(p) AS INTEGER) AS page FROM e WHERE len(t) >= 2""")
def text_toc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.defects(spark, sf_dir).select("block_id", F.explode(T.toc_entries(F.col("text"))).alias("e"))
    return rows.select("block_id", F.col("e.title").alias("title"), F.col("e.page").alias("page"))


@query(f"""{with_views('v_word')}, w AS (SELECT DISTINCT word FROM v_word) SELECT word FROM w WHERE trim(word) = '' OR regexp_matches(trim(word), '^\\d+[.):]?\\s*$') OR len(regexp_extract_all(trim(word), '\\p{{L}}')) < 2""")
def text_garbage_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = views.words(spark, sf_dir).select("word").distinct()
    return words.where(T.is_garbage_title(F.col("word")))


@query("SELECT page_id, url, unnest(regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)</h[1-6]>', 1)) AS heading FROM pages")
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r"<h[1-6][^>]*>([^<]*)</h[1-6]>"), F.lit(1))).alias("heading"))


@query("""WITH a AS (SELECT doc_id AS path, sha256(coalesce(text, '')) AS h FROM documents), b AS (SELECT CASE WHEN doc_id % 7 = 0 THEN -doc_id - 1 ELSE doc_id END AS path, sha256(coalesce(lower(text), '')) AS h FROM documents)
    SELECT path, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b USING (path)""")
def publish_release_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all of them in small letters, some under another path."""
    docs = views.table(spark, sf_dir, "documents")
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256).alias("sha256")
    moved = F.when(F.col("doc_id") % 7 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    return publish.release_diff(docs.select(F.col("doc_id").alias("path"), digest(F.col("text"))), docs.select(moved.alias("path"), digest(F.lower("text"))))


@query("SELECT doc_id AS page_id, 'missing_file' AS problem FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unlisted_file' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def publish_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda t: views.table(spark, sf_dir, t).select(F.col("doc_id").alias("page_id"))
    return publish.completeness(named("documents"), named("labels"))


@query("SELECT source AS document_id, string_agg(DISTINCT lang, ',' ORDER BY lang) AS editions FROM documents GROUP BY 1")
def publish_document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.col("lang").alias("edition"))
    return publish.document_index(files).withColumn("editions", F.array_join("editions", ","))


@query(f"{with_views('v_block')} SELECT page_id, count(*) AS n_blocks, count(*) FILTER (kind = 'heading') AS n_heading, count(*) FILTER (kind = 'paragraph') AS n_paragraph, count(*) FILTER (kind = 'paragraph' AND length(text) > 800) AS n_long FROM v_block GROUP BY 1")
def publish_block_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.block_statistics(views.blocks(spark, sf_dir))


@query("""WITH r AS (SELECT source AS page_id, CASE WHEN doc_id % 3 = 0 THEN lang END AS edition, doc_id AS written_at FROM documents),
    f AS (SELECT * FROM (SELECT *, max(edition IS NOT NULL) OVER (PARTITION BY page_id) AS tagged FROM r) WHERE edition = 'en' OR (edition IS NULL AND NOT tagged))
    SELECT page_id, arg_max(edition, written_at) AS edition, max(written_at) AS written_at FROM f GROUP BY 1""")
def publish_pick_edition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "documents").select(F.col("source").alias("page_id"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("edition"), F.col("doc_id").alias("written_at"))
    return publish.pick_edition(rows, "en")


@query("SELECT doc_id, substring(sha256('{\"lang\":\"' || lang || '\",\"n\":' || n_chars || ',\"source\":\"' || source || '\"}'), 1, 12) AS content_hash FROM documents")
def ids_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", ids.content_hash(F.col("lang"), F.col("n_chars").alias("n"), F.col("source")).alias("content_hash"))


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turns = views.table(spark, sf_dir, "conversations").withColumn("segment_id", F.concat_ws(".", "conv_id", F.floor(F.col("turn") / 2)))
    source = turns.where("role = 'user'").select("segment_id", "text", F.array().cast("array<string>").alias("concept_ids"))
    target = turns.where("role = 'assistant'").select("segment_id", F.when(F.length("text") % 5 == 0, "").otherwise(F.col("text")).alias("target"))
    return source, target


@query("""WITH t AS (SELECT conv_id || '.' || (turn // 2) AS segment_id, role, text FROM conversations), s AS (SELECT segment_id FROM t WHERE role = 'user'), r AS (SELECT segment_id, CASE WHEN length(text) % 5 = 0 THEN '' ELSE text END AS target FROM t WHERE role = 'assistant')
    SELECT segment_id, 'missing' AS problem, CAST(NULL AS VARCHAR) AS detail FROM s WHERE segment_id NOT IN (SELECT segment_id FROM r)
    UNION ALL SELECT segment_id, 'extra', NULL FROM r WHERE segment_id NOT IN (SELECT segment_id FROM s)
    UNION ALL SELECT segment_id, 'duplicate', CAST(count(*) AS VARCHAR) FROM r GROUP BY 1 HAVING count(*) > 1
    UNION ALL SELECT segment_id, 'empty', NULL FROM r WHERE coalesce(trim(target), '') = ''""")
def translation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = _pairs(spark, sf_dir)
    concepts = _terms(spark, sf_dir).select("concept_id", F.col("form").alias("target_lemma"), F.array().cast("array<string>").alias("allowed"), F.array().cast("array<string>").alias("forbidden"))
    return translate.validate(source, target, concepts)


@query()
def translation_mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = _pairs(spark, sf_dir)[0]
    return translate.translate(segments, lambda: translate.MockTranslator({"the": "der", "and": "und"}))


@query(f"""{with_views('v_block')}, {_TERMS} SELECT b.page_id, b.block_id AS segment_id, b.section, (SELECT coalesce(string_agg('c.' || form, ',' ORDER BY 'c.' || form), '') FROM tm WHERE contains(lower(b.text), form)) AS concept_ids
    FROM (SELECT *, last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM v_block) b""")
def translation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = _terms(spark, sf_dir).select("concept_id", F.col("form").alias("lemma"))
    plan = translate.plan_segments(views.blocks(spark, sf_dir), concepts)
    return plan.select("page_id", "segment_id", "section", F.array_join("concept_ids", ",").alias("concept_ids"))


def _page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = structure.build_page(views.defects(spark, sf_dir))
    blocks = F.transform("blocks", lambda b: F.struct(b["block_id"].alias("block_id"), b["kind"].alias("kind"), b["text"].alias("text")))
    return page.select("page_id", F.to_json(F.struct(blocks.alias("blocks"))).alias("doc"))


@query()
def patch_findings_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    blocks = views.defects(spark, sf_dir).withColumn("index", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1)
    findings = qa.decorative_icons(blocks).unionByName(qa.paragraph_length(blocks))
    return patch.apply_patches(_page_json(spark, sf_dir), patch.fixes_for(blocks, findings))


@query(f"{with_views('v_event')} SELECT time_bucket(INTERVAL 1 HOUR, finished_at) AS start, stage_name, count(*) AS n, round(sum(value), 4) AS total FROM v_event GROUP BY 1, 2")
def events_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stream.window_counts(views.stage_events(spark, sf_dir).withColumn("finished_at", F.col("finished_at").cast("timestamp")))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


@query(f"""{with_views('v_event')}, g AS (SELECT run_id, finished_at, CASE WHEN finished_at < lag(finished_at) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM v_event WINDOW w AS (PARTITION BY run_id ORDER BY finished_at, event_id)),
    s AS (SELECT run_id, finished_at, sum(new) OVER (PARTITION BY run_id ORDER BY finished_at ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT run_id, min(finished_at) AS start, max(finished_at) + INTERVAL 30 MINUTE AS finish, count(*) AS n FROM s GROUP BY run_id, s""")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stream.run_sessions(views.stage_events(spark, sf_dir).withColumn("finished_at", F.col("finished_at").cast("timestamp")))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("finish", F.col("finish").cast("timestamp_ntz"))


_GARBAGE = "(trim(text) = '' OR regexp_matches(trim(text), '^\\d+[.):]?\\s*$') OR len(regexp_extract_all(trim(text), '\\p{L}')) < 2)"


@query(f"""{with_views('v_block')} SELECT page_id, count(*) AS n_blocks, string_agg(block_id, ',' ORDER BY pos) AS block_refs,
    coalesce(arg_min(text, pos) FILTER (kind = 'heading' AND NOT {_GARBAGE}), '') AS title FROM v_block GROUP BY 1""")
def render_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.render_pages(views.blocks(spark, sf_dir)).withColumn("block_refs", F.array_join("block_refs", ","))


@query("""WITH p AS (SELECT doc_id, (n_chars % 64) / 64.0 AS coverage, CASE WHEN doc_id % 9 = 0 THEN 'article' END AS o FROM documents)
    SELECT doc_id, coalesce(o, CASE WHEN coverage < 0.15 THEN 'facsimile' ELSE 'article' END) AS mode FROM p""")
def render_presentation_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 64) / 64.0).alias("coverage"), F.when(F.col("doc_id") % 9 == 0, "article").alias("override"))
    return render.presentation_mode(pages).select("doc_id", "mode")


@query("""WITH t AS (SELECT printf('p%04d', doc_id) AS page_id, doc_id AS number, split_part(text, chr(10), 1) AS title FROM documents WHERE text IS NOT NULL), l AS (SELECT lower(trim(title)) AS k, arg_max(page_id, number) AS page_id, max(number) AS number FROM t WHERE trim(title) <> '' GROUP BY 1),
    h AS (SELECT t.number AS pos, t.number AS page, l.page_id, l.number FROM t JOIN l ON k = lower(t.title))
    SELECT DISTINCT page_id, (SELECT arg_min(number - page, pos) FROM h) AS "offset" FROM h""")
def render_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents made of all documents' titles (their first lines), against all documents as pages: the last page of a title has the entry."""
    pages = views.table(spark, sf_dir, "documents").where("text IS NOT NULL").select(ids.page_id(F.col("doc_id")).alias("page_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("doc_id").alias("number"))
    return render.contents(pages.select("title", F.col("number").alias("page"), F.col("number").alias("pos")), pages)


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as evidence: images and vector clusters by the block's number, their text's hash as content."""
    kind = F.when(F.col("pos") % 3 == 0, "image").when(F.col("pos") % 3 == 1, "vector_cluster").otherwise("line")
    return _block_boxes(spark, sf_dir).select("page_id", F.col("block_id").alias("evidence_id"), kind.alias("kind"), F.substring(F.sha2("text", 256), 1, 12).alias("content_hash"), "x0", "y0", "x1", "y1")


_OCCURRENCE = """o AS (SELECT page_id, block_id AS evidence_id, printf('ao.%s.%03d', page_id, row_number() OVER (PARTITION BY page_id ORDER BY block_id) - 1) AS occurrence_id,
    'ac.' || CASE WHEN pos % 3 = 0 THEN 'image' ELSE 'vector_cluster' END || '.' || substring(sha256(text), 1, 12) AS class_id,
    CASE WHEN pos % 3 = 1 THEN 'decoration' WHEN (x1 - x0) * (y1 - y0) < 900 THEN 'inline' ELSE 'float' END AS context FROM i WHERE pos % 3 < 2)"""


@query(f"{with_views('v_block')}, {_ITEM}, {_OCCURRENCE} SELECT occurrence_id, class_id, page_id, evidence_id, context FROM o")
def asset_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets.occurrences(_evidence(spark, sf_dir))


@query(f"{with_views('v_block')}, {_ITEM}, {_OCCURRENCE} SELECT class_id, arg_min(page_id, (page_id, occurrence_id)) AS first_page, arg_min(context, (page_id, occurrence_id)) AS context, count(*) AS n FROM o GROUP BY 1")
def asset_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets.classes(assets.occurrences(_evidence(spark, sf_dir)))


@query(f"""{with_views('v_word')}, c AS (SELECT page_id, lower(word) AS symbol_id, (900 + (wpos * 13 + pos) % 100) / 1000.0 AS score, x0, y0, word_id FROM v_word WHERE length(word) > 4),
    r AS (SELECT *, row_number() OVER w AS nth, first_value(score) OVER w AS best FROM c WHERE score >= 0.93 WINDOW w AS (PARTITION BY page_id, symbol_id ORDER BY score DESC, y0, x0, word_id))
    SELECT page_id, symbol_id, count(*) AS n, CAST(max(score) AS DOUBLE) AS best FROM r WHERE nth <= 50 AND score >= 0.98 * best GROUP BY 1, 2""")
def asset_symbol_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = views.words(spark, sf_dir).where("length(word) > 4")
    candidates = words.select("page_id", F.lower("word").alias("symbol_id"), ((900 + F.pmod(F.col("wpos") * 13 + F.col("pos"), F.lit(100))) / 1000.0).alias("score"), F.lit(None).cast("double").alias("threshold"), "x0", "y0")
    return assets.accepted_matches(candidates).groupBy("page_id", "symbol_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long paragraphs and repeated content, counted by code."""
    return qa.tally_by_code(qa.run_rules(views.blocks(spark, sf_dir), (qa.paragraph_length, qa.duplicate_content)))
