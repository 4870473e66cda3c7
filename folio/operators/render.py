"""Render pages: the blocks a reader shows, page titles, figures, presentation, contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T

# Kinds that a render page shows (callouts, captions and lists are not among them) and symbols that are decoration.
SHOWN = ("heading", "paragraph", "table", "list_item", "figure")
DECORATIVE_SYMBOLS = ("sym.board_tile", "sym.art_", "sym.terrain_", "sym.marker_", "sym.crown_", "sym.die_", "sym.titan_helmet")


def render_blocks(blocks: DataFrame) -> DataFrame:
    """The blocks a render page shows, in their order, with a number from 1; every block stays among the page's references."""
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return blocks.where(F.col("kind").isin(*SHOWN)).withColumn("nth", nth)


def page_titles(blocks: DataFrame) -> DataFrame:
    """page_id, title: the first heading that isn't garbage; empty if there is none."""
    good = (F.col("kind") == "heading") & ~T.is_garbage_title(F.col("text"))
    return blocks.groupBy("page_id").agg(F.coalesce(F.min_by("text", F.when(good, F.col("pos"))), F.lit("")).alias("title"))


def render_pages(blocks: DataFrame) -> DataFrame:
    """page_id, title, n_blocks, block_refs of every page, and its neighbours prev_page and next_page."""
    rows = blocks.groupBy("page_id").agg(F.count_if(F.col("kind").isin(*SHOWN)).alias("n_blocks"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "block_id"))), lambda b: b["block_id"]).alias("block_refs"))
    return rows.join(page_titles(blocks), "page_id")


def visible_inlines(inlines: Column) -> Column:
    """Inlines without decorative symbols."""
    hidden = lambda i: (i["type"] == "icon") & F.coalesce(i["symbol_id"].rlike("^(" + "|".join(s.replace(".", r"\.") for s in DECORATIVE_SYMBOLS) + ")"), F.lit(False))
    return F.filter(inlines, lambda i: ~F.coalesce(hidden(i), F.lit(False)))


def presentation_mode(pages: DataFrame, threshold: float = 0.15) -> DataFrame:
    """pages (coverage, override) with mode: the override, else facsimile where the text covers less than the threshold, else article."""
    low = F.coalesce(F.col("coverage") < threshold, F.lit(False))
    return pages.withColumn("mode", F.coalesce("override", F.when(low, "facsimile").otherwise("article")))


def figures(blocks: DataFrame, sources: DataFrame, base: str = "") -> DataFrame:
    """page_id, asset_id, src of figures: the asset's own source, else under the base path, else the asset's name."""
    rows = blocks.where("kind = 'figure'").select("page_id", "asset_id").distinct().join(sources.select("asset_id", "src"), "asset_id", "left")
    plain = F.concat(F.lit(f"{base}/"), "asset_id") if base else F.col("asset_id")
    return rows.select("page_id", "asset_id", F.coalesce("src", plain).alias("src"))


def inject_figures(figures_on_page: DataFrame, images: DataFrame, most: int = 20) -> DataFrame:
    """page_id, image_id, nth: images a page has besides its figures, in order, up to the budget that its figures leave."""
    used = figures_on_page.groupBy("page_id").agg(F.count("*").alias("used"))
    rest = images.join(figures_on_page.select("page_id", F.col("asset_id").alias("image_id")), ["page_id", "image_id"], "left_anti")
    rows = rest.withColumn("nth", F.row_number().over(Window.partitionBy("page_id").orderBy("pos", "image_id"))).join(used, "page_id", "left")
    return rows.where(F.col("nth") <= most - F.coalesce("used", F.lit(0))).select("page_id", "image_id", "nth")


def contents(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, offset of the sections that a table of contents names.

    entries: title, page in order of pos; pages: page_id, title, number. Titles are matched ignoring
    case, the last page of a title wins, and the first match's distance is the offset. Where no title
    matches, the first offset of 0 to 3 at which every entry falls on a titled page.
    """
    titled = pages.where(F.trim("title") != "")
    last = titled.groupBy(F.lower(F.trim("title")).alias("key")).agg(F.max_by(F.struct("page_id", "number"), "number").alias("p"))
    hits = entries.withColumn("key", F.lower("title")).join(last, "key").select("pos", "page", "p.page_id", "p.number")
    first = hits.agg(F.min_by(F.col("number") - F.col("page"), "pos").alias("offset"))
    by_title = hits.select("page_id").distinct().join(F.broadcast(first))  # one row
    tried = entries.select("page").distinct().withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("number", F.col("page") + F.col("offset"))
    found = tried.join(titled.select("number", "page_id"), "number", "left")
    whole = found.groupBy("offset").agg(F.count_if(F.col("page_id").isNull()).alias("lost")).where("lost = 0").agg(F.min("offset").alias("offset"))
    by_number = found.join(F.broadcast(whole), "offset").select("page_id", "offset").distinct()
    none = hits.limit(1).select(F.lit(1).alias("any"))
    return by_title.unionByName(by_number.join(none, F.lit(True), "left_anti"))


def reader_inlines(inlines: DataFrame) -> DataFrame:
    """page_id, block_id, child, kind, text, symbol_id, alt of what a reader shows: texts, line breaks as text, and icons with their name as alternative text; other inlines are left out."""
    alt = T.capitalized(F.regexp_replace("symbol_id", r"^sym\.", ""))
    icon = F.col("type") == "icon"
    rows = inlines.where(F.col("type").isin("text", "icon", "line_break"))
    text = F.when(F.col("type") == "line_break", "\n").when(F.col("type") == "text", F.col("text"))
    return rows.select("page_id", "block_id", "child", F.when(icon, "icon").otherwise("text").alias("kind"), text.alias("text"), F.when(icon, F.col("symbol_id")).alias("symbol_id"), F.when(icon, alt).alias("alt"))


def facsimiles(rasters: DataFrame, standard: int = 150, fine: int = 300) -> DataFrame:
    """page_id, src, src_fine, width, height of pages from their rasters (page_id, nth, dpi, width, height): the standard resolution, else the fine one, else the first."""
    rank = F.struct(F.when(F.col("dpi") == standard, 0).when(F.col("dpi") == fine, 1).otherwise(2), "nth")
    name = lambda dpi: F.format_string("rasters/%s__%ddpi.png", "page_id", dpi)
    rows = rasters.groupBy("page_id").agg(F.min_by(F.struct("dpi", "width", "height"), rank).alias("l"), F.bool_or(F.col("dpi") == fine).alias("has_fine"))
    return rows.select("page_id", name(F.col("l.dpi")).alias("src"), F.when(F.col("has_fine"), name(F.lit(fine))).otherwise("").alias("src_fine"), "l.width", "l.height")


def preferred_pages(pages: DataFrame, edition: str) -> DataFrame:
    """One row a page of pages (page_id, language, ...): the edition's language first, the other where that is missing."""
    wanted = "en" if edition == "en" else "ru"
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.when(F.col("language") == wanted, 0).otherwise(1), "language"))
    return pages.withColumn("rank", rank).where("rank = 1").drop("rank")


def companions(blocks: DataFrame, mentions: DataFrame, concepts: DataFrame, group: str, order: str, pages: DataFrame) -> dict[str, DataFrame]:
    """What goes with a document's render pages: glossary, search documents and navigation."""
    from folio.operators import publish, search

    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda b: b["text"]), " ")
    docs = blocks.groupBy("page_id").agg(text.alias("text"))
    return {"glossary": publish.glossary_export(concepts, search.page_references(mentions)), "search_docs": search.search_documents(docs), "nav": search.navigation(pages, group, order)}
