"""Release checks and manifests: differences of file listings, checksums, bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T


def completeness(manifest: DataFrame, files: DataFrame, key: str = "page_id") -> DataFrame:
    """key, problem: in the manifest but not on disk (missing_file), and the other way (unlisted_file)."""
    a, b = manifest.select(key).distinct(), files.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("problem", F.lit("missing_file")).unionByName(b.join(a, key, "left_anti").withColumn("problem", F.lit("unlisted_file")))


def checksum_problems(expected: DataFrame, actual: DataFrame, key: str = "path") -> DataFrame:
    """key, problem (changed, missing or extra) over two tables of key, sha256."""
    rows = expected.select(key, F.col("sha256").alias("want")).join(actual.select(key, F.col("sha256").alias("have")), key, "full")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") != F.col("have"), "changed")
    return rows.withColumn("problem", problem).where("problem IS NOT NULL").select(key, "problem")


def release_diff(before: DataFrame, after: DataFrame, key: str = "path") -> DataFrame:
    """key, change (added, removed, changed, same) between two releases."""
    rows = before.select(key, F.col("sha256").alias("a")).join(after.select(key, F.col("sha256").alias("b")), key, "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return rows.select(key, change.alias("change"))


def title_problems(pages: DataFrame) -> DataFrame:
    return pages.where(T.is_garbage_title(F.col("title"))).select("page_id", "title")


def build_id(refs: DataFrame) -> DataFrame:
    """One row: 12 hex digits over all references (kind, ref) in order.

    Each reference is hashed first and only the digests meet, so their list is short; a release has
    a few thousand files at most.
    """
    lines = F.sort_array(F.collect_list(F.concat_ws(" ", "kind", "ref")))
    return refs.agg(F.substring(F.sha2(F.array_join(lines, "\n"), 256), 1, 12).alias("build_id"))


def flat_rasters(pages: DataFrame) -> DataFrame:
    """key ({page}__{dpi}dpi), ref from page_id and a map of dpi to reference."""
    return pages.select("page_id", F.explode("rasters").alias("dpi", "ref")).select(F.format_string("%s__%sdpi", "page_id", "dpi").alias("key"), "ref")


def document_index(files: DataFrame) -> DataFrame:
    """document_id with its sorted editions; a document without one has ["default"]."""
    rows = files.groupBy("document_id").agg(F.sort_array(F.collect_set("edition")).alias("editions"))
    return rows.withColumn("editions", F.when(F.size("editions") == 0, F.array(F.lit("default"))).otherwise(F.col("editions")))


def pick_edition(rows: DataFrame, edition: str, written_at: str = "written_at") -> DataFrame:
    """Per page the newest row of the edition; an untagged one only where the page has no tagged row at all."""
    tagged = F.max(F.col("edition").isNotNull()).over(Window.partitionBy("page_id"))
    fit = rows.withColumn("tagged", tagged).where((F.col("edition") == edition) | (F.col("edition").isNull() & ~F.col("tagged"))).drop("tagged")
    rest = [c for c in rows.columns if c != "page_id"]
    best = fit.groupBy("page_id").agg(F.max_by(F.struct(*rest), F.struct(written_at, F.xxhash64(*rest))).alias("r"))
    return best.select("page_id", *[F.col("r")[c].alias(c) for c in rest])


def block_statistics(blocks: DataFrame, long_at: int = 800) -> DataFrame:
    """page_id with counts by kind and of long paragraphs."""
    count = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    return blocks.groupBy("page_id").agg(F.count("*").alias("n_blocks"), count("heading"), count("paragraph"), F.count_if((F.col("kind") == "paragraph") & (F.length("text") > long_at)).alias("n_long"))


def figure_urls(pages: DataFrame, prefix: str) -> DataFrame:
    """pages with the values of their figures map rewritten to the prefix and the file's name, and bare keys given the page's name space."""
    renamed = F.transform_keys("figures", lambda k, _: F.when(F.contains(k, F.lit(".")), k).otherwise(F.concat("page_id", F.lit("."), k)))
    return pages.withColumn("figures", F.transform_values(renamed, lambda _, v: F.concat(F.lit(prefix), F.substring_index(v, "/", -1))))


# An annotation's kind and priority by its block's kind; others are body with 20.
ANNOTATION_KINDS = {"heading": ("title", 100), "callout": ("callout", 80), "caption": ("caption", 60), "paragraph": ("body", 40), "list_item": ("body", 40), "list": ("body", 40), "table": ("body", 30), "figure": ("label", 10)}


def annotation_candidates(source: DataFrame, target: DataFrame) -> DataFrame:
    """page_id, annotation_id, kind, priority, source, target, x0.. in shares of the page, of source blocks (text, x0.., width, height) with their translation, or an empty one."""
    from folio.functions import geometry as G

    kind = F.coalesce(*[F.when(F.col("kind") == k, F.struct(F.lit(name).alias("kind"), F.lit(p).alias("priority"))) for k, (name, p) in ANNOTATION_KINDS.items()], F.struct(F.lit("body").alias("kind"), F.lit(20).alias("priority")))
    rows = source.where(~F.col("kind").isin("divider", "unknown") & (F.trim("text") != "") & F.col("x0").isNotNull())
    rows = rows.join(target.select("page_id", "block_id", F.col("text").alias("target")), ["page_id", "block_id"], "left").withColumn("k", kind).withColumn("box", G.normalized("width", "height"))
    return rows.select("page_id", F.col("block_id").alias("annotation_id"), "k.kind", "k.priority", F.col("text").alias("source"), F.coalesce("target", F.lit("")).alias("target"), "box.*")


def annotations(candidates: DataFrame, most: int = 25, box: float = 0.10, total: float = 0.30, ratio: float = 0.3, drop: float = 0.5) -> DataFrame:
    """Annotations (page_id, annotation_id, kind, priority, source, target, x0.. in shares of the page) of the pages whose quality allows any.

    Dropped: targets that say the same as the source, boxes over a tenth of the page, garbled texts.
    A page passes if it keeps one, at most 25 count (the highest priority first), they cover less
    than 0.30, and not more than half were dropped.
    """
    from folio.functions import geometry as G

    good = ~T.identical_translation(F.col("source"), F.col("target")) & (G.area() <= box) & ~T.is_garbled(F.col("target"), ratio)
    w = Window.partitionBy("page_id")
    rows = candidates.withColumn("good", good).withColumn("share", F.avg(F.col("good").cast("double")).over(w)).where("good")
    rows = rows.withColumn("nth", F.row_number().over(w.orderBy(F.desc("priority"), "annotation_id"))).where(F.col("nth") <= most)
    rows = rows.withColumn("covered", F.sum(G.area()).over(w)).where((F.col("covered") <= total) & (F.col("share") >= 1 - drop))
    return rows.select(*candidates.columns)


def unresolved_figures(blocks: DataFrame, figures: DataFrame) -> DataFrame:
    """page_id, block_id, asset_id of figures (page_id, block_id, kind, asset_id) whose asset isn't among the page's figures (page_id, asset_id)."""
    shown = blocks.where((F.col("kind") == "figure") & (F.coalesce("asset_id", F.lit("")) != ""))
    return shown.join(figures.select("page_id", "asset_id"), ["page_id", "asset_id"], "left_anti").select("page_id", "block_id", "asset_id")


def facsimile_urls(pages: DataFrame, prefix: str) -> DataFrame:
    """pages with the references of their rasters map under a prefix; absolute ones stay."""
    return pages.withColumn("rasters", F.transform_values("rasters", lambda _, v: F.when(v.startswith("/") | v.rlike("^[a-z]+://"), v).otherwise(F.concat(F.lit(prefix), v))))


def raster_copies(pages: DataFrame, folder: str) -> DataFrame:
    """page_id, dpi, source, target of the files that a release copies: {folder}/{page}__{dpi}dpi.png."""
    rows = pages.select("page_id", F.explode("rasters").alias("dpi", "source"))
    return rows.withColumn("target", F.format_string(f"{folder}/%s__%sdpi.png", "page_id", "dpi"))


def glossary_export(concepts: DataFrame, references: DataFrame) -> DataFrame:
    """concept_id, term, source_term, n_pages, first_page of the glossary that readers get; concepts without a page too."""
    pages = references.groupBy("concept_id").agg(F.count_distinct("page_id").alias("n_pages"), F.min("page_id").alias("first_page"))
    rows = concepts.select("concept_id", F.col("target_lemma").alias("term"), F.col("lemma").alias("source_term")).join(pages, "concept_id", "left")
    return rows.na.fill(0, ["n_pages"])


def bundle_manifest(pages: DataFrame, files: DataFrame) -> DataFrame:
    """kind, key, ref, sha256: the rows of a release: each page's document, and each raster (page_id, rasters); a reference without a file (ref, sha256) has no digest."""
    documents = pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("key"), F.concat(F.lit("pages/"), "page_id", F.lit(".json")).alias("ref"))
    rasters = flat_rasters(pages).select(F.lit("raster").alias("kind"), "key", "ref")
    return documents.unionByName(rasters).join(files.select("ref", "sha256"), "ref", "left").select("kind", "key", "ref", "sha256")


_MANIFEST = "source_pdf_sha256 string, stages array<struct<stage_name:string,artifact_ref:string>>"
_RENDERED = "page_refs map<string,string>, image_refs map<string,string>, raster_refs map<string,map<string,string>>, glossary_ref string, search_docs_ref string, nav_ref string"
COMPANIONS = ("glossary_ref", "search_docs_ref", "nav_ref")


def bundle_refs(runs: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a release of each run is made of, from its manifest and its render result; and the runs that have none of it.

    runs: run_id, run_manifest_ref. artifacts: ref, body (JSON). First table: run_id, source_pdf_sha256, kind (page, companion, image, raster), key,
    ref. Second table: run_id, problem (no_manifest, no_render_stage, no_page_refs). The first render stage of a manifest counts; a reference whose
    artifact is missing or isn't JSON is one that says nothing. A raster's key is {page}__{dpi}dpi.
    """
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    body = lambda ref: artifacts.select(F.col("ref").alias(ref), "body")
    rows = runs.select("run_id", "run_manifest_ref").join(body("run_manifest_ref"), "run_manifest_ref", "left").withColumn("m", F.from_json("body", _MANIFEST)).drop("body")
    render = F.get(F.filter("m.stages", lambda s: s["stage_name"] == "render"), 0)["artifact_ref"]
    rows = rows.withColumn("render_ref", render).join(body("render_ref"), "render_ref", "left").withColumn("r", F.from_json("body", _RENDERED))
    problem = F.when(~filled(F.col("run_manifest_ref")) | F.col("m.stages").isNull(), "no_manifest").when(~filled(F.col("render_ref")), "no_render_stage").when(F.coalesce(F.size("r.page_refs"), F.lit(0)) <= 0, "no_page_refs")
    rows = rows.withColumn("problem", problem)
    entries = lambda c, kind: F.transform(F.coalesce(F.map_entries(c), F.array()), lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("key"), e["value"].alias("ref")))
    companions = F.filter(F.array(*[F.struct(F.lit("companion").alias("kind"), F.lit(c).alias("key"), F.col(f"r.{c}").alias("ref")) for c in COMPANIONS]), lambda e: F.coalesce(e["ref"], F.lit("")) != "")
    rasters = F.flatten(F.transform(F.map_entries("r.raster_refs"), lambda p: F.transform(F.map_entries(p["value"]), lambda e: F.struct(F.lit("raster").alias("kind"), F.format_string("%s__%sdpi", p["key"], e["key"]).alias("key"), e["value"].alias("ref")))))
    every = F.concat(entries("r.page_refs", "page"), companions, entries("r.image_refs", "image"), F.coalesce(rasters, F.array()))
    good = rows.where("problem IS NULL").select("run_id", "m.source_pdf_sha256", F.explode(every).alias("e")).select("run_id", "source_pdf_sha256", "e.*")
    return good, rows.where("problem IS NOT NULL").select("run_id", "problem")
