"""Registered queries over translation examples, icon candidates and what releases are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import ids
from folio.operators import assets, memory, publish, translate
from folio.operators.graph import scratch
from folio.plans.queries import _TERMS, _terms, query
from folio.sources import artifact_source, views
from folio.sources.views import with_views

_WORDS = r"([\p{L}\p{N}]+)"


def _mentions(spark: SparkSession, sf_dir: str, rows: DataFrame, key: list[str]) -> DataFrame:
    """rows (key, text) with concept_ids: the terms that are words of the text."""
    words = rows.select(*key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORDS), F.lit(1)))).alias("form"))
    found = words.join(_terms(spark, sf_dir), "form").groupBy(*key).agg(F.sort_array(F.collect_set("concept_id")).alias("concept_ids"))
    return rows.join(found, key, "left").withColumn("concept_ids", F.coalesce("concept_ids", F.array().cast("array<string>")))


@query(f"""WITH {_TERMS}, t AS (SELECT conv_id || '.' || (turn // 2) AS segment_id, role, text FROM conversations),
    s AS (SELECT segment_id, any_value(text) FILTER (role = 'user') AS text, any_value(text) FILTER (role = 'assistant') AS target FROM t GROUP BY 1),
    p AS (SELECT * FROM s WHERE trim(text) <> '' AND trim(target) <> ''),
    w AS (SELECT DISTINCT segment_id, length(text) AS size, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS form FROM p),
    e AS (SELECT form, arg_min(segment_id, (size, segment_id)) AS segment_id FROM w JOIN tm USING (form) GROUP BY 1),
    d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS form FROM documents),
    n AS (SELECT doc_id, segment_id, count(*) AS n FROM d JOIN e USING (form) GROUP BY 1, 2)
    SELECT printf('p%04d', doc_id) AS page_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, segment_id) AS INTEGER) AS nth, segment_id FROM n QUALIFY nth <= 2""")
def translation_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = views.table(spark, sf_dir, "conversations").withColumn("segment_id", F.concat_ws(".", "conv_id", F.floor(F.col("turn") / 2)))
    said = lambda role: F.max(F.when(F.col("role") == role, F.col("text")))
    pairs = turns.groupBy("segment_id").agg(said("user").alias("text"), said("assistant").alias("target")).withColumn("kind", F.lit("paragraph"))
    pages = views.table(spark, sf_dir, "documents").where("text IS NOT NULL").select(ids.page_id(F.col("doc_id")).alias("page_id"), F.lit(0).alias("batch"), "text")
    batched = _mentions(spark, sf_dir, pages, ["page_id", "batch"]).drop("text")
    return translate.few_shot_examples(batched, _mentions(spark, sf_dir, pairs, ["segment_id"])).select("page_id", "nth", "segment_id")


@query("""WITH i AS (SELECT doc_id AS page_number, doc_id % 3 AS xref, n_chars % 100 AS width, 2 * n_chars % 90 AS height, left(text, 8) AS content FROM documents),
    s AS (SELECT *, left(sha256(content), 16) AS hash FROM i WHERE greatest(width, height) <= 80 AND least(width, height) >= 10 AND content <> '')
    SELECT hash, printf('p%04d', page_number) AS page_id, page_number, xref, width, height FROM s QUALIFY row_number() OVER (PARTITION BY hash ORDER BY page_number, xref) = 1""")
def asset_icon_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pictures: sizes from their lengths, contents from their first characters."""
    docs = views.table(spark, sf_dir, "documents")
    images = docs.select(F.col("doc_id").alias("page_number"), (F.col("doc_id") % 3).alias("xref"), (F.col("n_chars") % 100).alias("width"), (2 * F.col("n_chars") % 90).alias("height"), F.encode(F.substring("text", 1, 8), "UTF-8").alias("content"))
    return assets.icon_candidates(images)


@query("""WITH u AS (SELECT user_id AS run_id, count(*) FILTER (event_type = 'view') AS n FROM events GROUP BY 1),
    p AS (SELECT run_id, CASE WHEN run_id % 5 = 0 THEN 'no_manifest' WHEN run_id % 7 = 0 THEN 'no_render_stage' WHEN n = 0 THEN 'no_page_refs' END AS problem FROM u)
    SELECT run_id, 'problem' AS kind, problem AS key, CAST(NULL AS VARCHAR) AS ref FROM p WHERE problem IS NOT NULL
    UNION ALL SELECT run_id, 'page', 'p' || event_id, 'pages/' || event_id FROM p JOIN events ON user_id = run_id WHERE problem IS NULL AND event_type = 'view'
    UNION ALL SELECT run_id, 'raster', 'p' || event_id || '__150dpi', 'r/' || event_id FROM p JOIN events ON user_id = run_id WHERE problem IS NULL AND event_type = 'click'
    UNION ALL SELECT run_id, 'companion', 'nav_ref', 'nav/' || run_id FROM p WHERE problem IS NULL""")
def publish_bundle_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as runs: their views are the pages that were rendered, their clicks the rasters; a fifth has no manifest, a seventh no render stage."""
    events = views.table(spark, sf_dir, "events")
    own = lambda kind: F.filter(F.collect_list(F.when(F.col("event_type") == kind, F.col("event_id").cast("string"))), lambda e: e.isNotNull())
    runs = events.groupBy(F.col("user_id").alias("run_id")).agg(own("view").alias("seen"), own("click").alias("clicked"))
    of = lambda ids_, value: F.map_from_entries(F.transform(ids_, lambda e: F.struct(F.concat(F.lit("p"), e), value(e))))
    name = F.col("run_id").cast("string")
    render = F.to_json(F.struct(of(F.col("seen"), lambda e: F.concat(F.lit("pages/"), e)).alias("page_refs"), of(F.col("clicked"), lambda e: F.create_map(F.lit("150"), F.concat(F.lit("r/"), e))).alias("raster_refs"), F.concat(F.lit("nav/"), name).alias("nav_ref")))
    stage = F.when(F.col("run_id") % 7 == 0, "publish").otherwise("render")
    manifest = F.to_json(F.struct(F.lit("sha").alias("source_pdf_sha256"), F.array(F.struct(stage.alias("stage_name"), F.concat(F.lit("render/"), name).alias("artifact_ref"))).alias("stages")))
    artifacts = runs.select(F.concat(F.lit("render/"), name).alias("ref"), render.alias("body")).unionByName(runs.select(F.concat(F.lit("manifest/"), name).alias("ref"), manifest.alias("body")))
    refs, problems = publish.bundle_refs(runs.select("run_id", F.when(F.col("run_id") % 5 != 0, F.concat(F.lit("manifest/"), name)).alias("run_manifest_ref")), artifacts)
    return refs.drop("source_pdf_sha256").unionByName(problems.select("run_id", F.lit("problem").alias("kind"), F.col("problem").alias("key"), F.lit(None).cast("string").alias("ref")))


_EDITED = """CASE item_id % 6 WHEN 0 THEN text WHEN 1 THEN 'x' || text WHEN 2 THEN left(text, 20) || substring(text, 22) WHEN 3 THEN left(text, 10) || 'ab' || substring(text, 11) || '!'
    WHEN 4 THEN substring(text, 3) || 'yz' ELSE left(text, 7) END"""


#: DuckDB counts the edits of bytes, so its texts are of single bytes.
_BYTES = "strip_accents(replace({}, 'ß', 's'))"
_DISTANCE = f"levenshtein({_BYTES.format('s.text')}, {_BYTES.format('m.text')})"


@query(f"""WITH s AS (SELECT item_id AS segment_id, {_EDITED} AS text FROM benchmark), m AS (SELECT text, min(item_id) AS item_id FROM benchmark WHERE item_id % 10 < 9 GROUP BY text)
    SELECT s.segment_id, m.item_id AS memory_id, CAST({_DISTANCE} AS INTEGER) AS distance, 't' || m.item_id AS target
    FROM s JOIN m ON s.text = m.text OR (length(s.text) >= 8 AND length(m.text) >= 8 AND {_DISTANCE} <= 3)
    QUALIFY row_number() OVER (PARTITION BY s.segment_id ORDER BY distance, m.item_id) = 1""")
def translation_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with a few edits, asked of a memory of the passages as they are."""
    items = views.table(spark, sf_dir, "benchmark")
    segments = items.select(F.col("item_id").alias("segment_id"), F.expr(_EDITED).alias("text"))
    kept = items.select(F.col("item_id").alias("segment_id"), "text", F.when(F.col("item_id") % 10 < 9, F.concat(F.lit("t"), F.col("item_id").cast("string"))).alias("target"))
    return memory.recall(segments, kept)


@query(f"""{with_views('v_block')} SELECT page_id AS entity_id, kind AS family, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars, min(left(sha256(text), 12)) AS first_hash FROM v_block GROUP BY 1, 2""")
def source_artifacts_by_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as artifacts, written and read again by the data source."""
    artifact_source.register(spark)
    folder = scratch(spark, "artifacts")
    uri = folder if "://" in folder else f"file://{folder}"
    blocks = views.blocks(spark, sf_dir).select(F.lit("d").alias("document_id"), F.col("kind").alias("family"), F.lit("page").alias("scope"), F.col("page_id").alias("entity_id"), F.col("text").alias("body"))
    blocks.write.format(artifact_source.NAME).mode("append").save(uri)
    found = spark.read.format(artifact_source.NAME).load(uri)
    return found.groupBy("entity_id", "family").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("n_chars"), F.min("content_hash").alias("first_hash"))
