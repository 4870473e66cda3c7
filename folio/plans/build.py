"""A document's build as cached stages over Spark tables: symbols, structure, translation, render, chunks, release.

Each function makes a stage's table from those before it; ``document_build`` puts them in order for ``folio.plans.stages.Runner``.
The first table, ``evidence``, holds items with boxes (page_id, item_id, pos, category, kind, text, x0.., width), one row an item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import assets, layout, publish, render, search, translate
from folio.plans.stages import PageStage, Stage

Tables = dict[str, DataFrame]


def structure_stage(evidence: DataFrame, candidates: DataFrame, cfg: layout.LayoutConfig = layout.DEFAULT) -> DataFrame:
    """page_id, block_id, pos, kind, region_id, text of pages in reading order: regions, their order, what they make of the blocks, and the blocks in that order."""
    areas = layout.regions(evidence, cfg)
    order = layout.reading_order(areas).where("role = 'main'").select("page_id", "region_id", "position")
    blocks = evidence.select("page_id", F.col("item_id").alias("block_id"), "pos", "kind", "text", "x0", "y0", "x1", "y1")
    resolved, _ = layout.resolve_semantics(blocks, areas, candidates, cfg)
    placed = resolved.join(blocks.select("page_id", "block_id", "x0", "y0", "x1", "y1"), ["page_id", "block_id"])
    return layout.in_region_order(placed, areas, order).withColumn("pos", F.col("nth") - 1).select("page_id", "block_id", "pos", "kind", "region_id", "text")


def symbols_stage(candidates: DataFrame, lines: DataFrame) -> DataFrame:
    """References of the accepted symbols (page_id, symbol_id, instance_id, score, threshold, x0..) to their nearest lines."""
    return assets.symbol_refs(assets.nearest_lines(assets.accepted_matches(candidates), lines))


def translation_stage(structure: DataFrame, concepts: DataFrame, memory: DataFrame, make) -> DataFrame:
    """The blocks with their translations: from the memory (segment_id, checksum, target) where that has one of the same text, else from the translator."""
    segments = translate.plan_segments(structure, concepts).withColumn("checksum", translate.inline_checksum(F.struct("text")))
    new = translate.translate(translate.pending(segments, memory), make).select("segment_id", "target")
    old = memory.where(F.col("target").isNotNull()).join(segments.select("segment_id", "checksum"), ["segment_id", "checksum"]).groupBy("segment_id").agg(F.min("target").alias("target"))
    return translate.translated_blocks(structure, new.unionByName(old))


def chunk_stage(structure: DataFrame) -> DataFrame:
    """page_id, anchor, block_ids, n_blocks, text, length: the chunks of a search pack, with their number of words."""
    return search.chunks(structure).withColumn("length", F.size(F.split("text", " ")))


def release_stage(rendered: DataFrame, files: DataFrame) -> DataFrame:
    """kind, key, ref, sha256, build_id: a release's rows, and the id that all of them make."""
    pages = rendered.select("page_id").withColumn("rasters", F.create_map().cast("map<string,string>"))
    rows = publish.bundle_manifest(pages, files)
    return rows.crossJoin(F.broadcast(publish.build_id(rows)))  # one row


def document_build(candidates: DataFrame, concepts: DataFrame, memory: DataFrame, files: DataFrame, evidence: DataFrame, make) -> list[Stage]:
    """The stages in order, for a runner that keeps their tables."""

    def of(name: str):
        return {
            "evidence": lambda spark, t: evidence,
            "structure": lambda spark, t: structure_stage(t["evidence"], candidates),
            "translate": lambda spark, t: translation_stage(t["structure"], concepts, memory, make),
            "render": lambda spark, t: render.render_pages(t["translate"]),
            "chunks": lambda spark, t: chunk_stage(t["structure"]),
            "publish": lambda spark, t: release_stage(t["render"], files),
        }[name]

    sources = {"evidence": [evidence], "structure": [candidates], "translate": [concepts, memory], "render": [], "chunks": [], "publish": [files]}
    return [Stage(name, "1.0", of(name), tables) for name, tables in sources.items()]


def page_build() -> list[PageStage]:
    """From blocks (page_id, block_id, pos, kind, text) page by page: texts without decorative tokens, search chunks, and what a page's index row says."""
    text = T.strip_decorative(F.col("text"))
    chunks = F.count("*").cast("int").alias("n_chunks")
    return [
        PageStage("clean", "1.0", ["blocks"], lambda t: t["blocks"].withColumn("text", text).select("page_id", "block_id", "pos", "kind", "text")),
        PageStage("chunks", "1.0", ["clean"], lambda t: chunk_stage(t["clean"])),
        PageStage("summary", "1.0", ["chunks"], lambda t: t["chunks"].groupBy("page_id").agg(chunks, F.sum("n_blocks").cast("int").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))),
    ]


def run_build(spark: SparkSession, path: str, stages: list[Stage]) -> Tables:
    """All tables of a build below a path that all executors reach; stages whose inputs hold the same rows as before are read, not run."""
    from folio.plans.stages import Runner

    return Runner(spark, path).run(stages)
