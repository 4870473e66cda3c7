"""Flat tables of nested page documents: words, spans and images of native pages, blocks and inlines of page IR.

All are maps over the page rows: a page's arrays are exploded where they are scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import text as T


def _flat(pages: DataFrame, array: str, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    rows = pages.select(*keep, F.posexplode(array).alias("pos", "item"))
    names = [f for f in rows.schema["item"].dataType.names if f != "bbox"]  # type: ignore[attr-defined]
    boxes = [F.col(f"item.bbox.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")] if "bbox" in rows.schema["item"].dataType.names else []  # type: ignore[attr-defined]
    return rows.select(*keep, "pos", *[F.col("item")[n].alias(n) for n in names], *boxes)


def words(native: DataFrame) -> DataFrame:
    return _flat(native, "words")


def spans(native: DataFrame) -> DataFrame:
    return _flat(native, "spans")


def images(native: DataFrame, least: float = 100.0, footer_y: float = 790.0, significant: bool = True) -> DataFrame:
    """Images of native pages; the significant ones are 100 points wide and high at least and above the footer."""
    rows = _flat(native, "image_blocks")
    return rows.where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least) & (F.col("y0") < footer_y)) if significant else rows


def text_coverage(native: DataFrame) -> DataFrame:
    """page_id, coverage: the words' area over the page's, 1 at most."""
    area = F.aggregate("words", F.lit(0.0), lambda s, w: s + F.greatest(F.lit(0.0), w["bbox"]["x1"] - w["bbox"]["x0"]) * F.greatest(F.lit(0.0), w["bbox"]["y1"] - w["bbox"]["y0"]))
    page = F.col("dimensions_pt.width") * F.col("dimensions_pt.height")
    return native.select("page_id", F.when(page > 0, F.least(F.lit(1.0), area / page)).otherwise(F.lit(0.0)).alias("coverage"))


def blocks(pages: DataFrame) -> DataFrame:
    """page_id, block_id, pos, kind, text (of text inlines), children, x0.. of page IR."""
    rows = _flat(pages, "blocks").withColumnRenamed("type", "kind")
    return rows.withColumn("text", inline_text(F.col("children")))


def inlines(pages: DataFrame) -> DataFrame:
    """page_id, block_id, kind, pos, child and an inline's own columns."""
    rows = blocks(pages).select("page_id", "block_id", "kind", "pos", F.posexplode("children").alias("child", "i"))
    return rows.select("page_id", "block_id", "kind", "pos", "child", "i.*")


def inline_text(children: Column) -> Column:
    """The text inlines of an array, joined."""
    return F.array_join(F.transform(F.filter(F.coalesce(children, F.array()), lambda i: i["type"] == "text"), lambda i: F.coalesce(i["text"], F.lit(""))), "")


def normalized_inlines(children: Column) -> Column:
    """The array with its text inlines normalised; others stay as they are."""
    return F.transform(children, lambda i: F.when(i["type"] == "text", i.withField("text", T.normalize(i["text"]))).otherwise(i))


def split_inlines(children: Column, at: Column) -> tuple[Column, Column]:
    """The inlines before and after a character offset of their joined text; the inline it falls into is cut in two.

    One pass adds up the lengths of their text, so time grows with the inlines and not with their square. Inlines without text go
    with what stands before them. Without an offset (null) nothing is on either side.
    """
    length = lambda i: F.when(i["type"] == "text", F.length(F.coalesce(i["text"], F.lit("")))).otherwise(F.lit(0))

    def step(s: Column, size: Column) -> Column:
        upto = s["upto"] + size
        return F.struct(upto.alias("upto"), F.when(upto <= at, s["n"] + 1).otherwise(s["n"]).alias("n"), F.when(upto <= at, upto).otherwise(s["a"]).alias("a"))

    def parts(s: Column) -> Column:
        # n inlines end at the offset or before it, where the text has a characters; the next one is cut if they are too few.
        n, a, none = s["n"], s["a"], F.slice(children, 1, 0)
        is_cut = (a < at) & (n < F.size(children))
        piece = lambda start, size: F.transform(F.slice(children, n + 1, 1), lambda i: i.withField("text", F.substring(i["text"], start, size)))
        left = F.when(is_cut, F.concat(F.slice(children, F.lit(1), n), piece(F.lit(1), at - a))).otherwise(F.slice(children, F.lit(1), n))
        right = F.when(is_cut, F.concat(piece(at - a + 1, F.lit(2**31 - 1)), F.slice(children, n + 2, F.size(children)))).otherwise(F.slice(children, n + 1, F.size(children)))
        return F.struct(left.alias("left"), F.when(at.isNotNull(), right).otherwise(none).alias("right"))

    start = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"), F.lit(0).alias("a"))
    both = F.aggregate(F.transform(children, length), start, step, parts)
    return both["left"], both["right"]


def source_words(pages: DataFrame) -> DataFrame:
    """page_id, entity_ref, word_id: the words that inlines refer to."""
    rows = inlines(pages).where(F.col("source_word_ids").isNotNull())
    return rows.select("page_id", F.col("block_id").alias("entity_ref"), F.explode("source_word_ids").alias("word_id"))


def symbols(pages: DataFrame) -> DataFrame:
    """page_id, symbol_id, instance_id, confidence, pos of icons, in their order on the page."""
    rows = inlines(pages).where("type = 'icon'")
    return rows.select("page_id", "symbol_id", "instance_id", "confidence", "kind", (F.col("pos").cast("long") * 100000 + F.col("child")).alias("pos"))


def page_signals(pages: DataFrame) -> DataFrame:
    """page_id, reading_order, symbol_confidence of page IR: the share of blocks that the reading order names, and the icons' mean confidence; 1 where there is nothing to measure."""
    names = F.array_distinct(F.transform("blocks", lambda b: b["block_id"]))
    ordered = F.size(F.array_intersect(names, F.coalesce("reading_order", F.array().cast("array<string>"))))
    icons = F.flatten(F.transform("blocks", lambda b: F.transform(F.filter(F.coalesce(b["children"], F.array()), lambda i: i["type"] == "icon"), lambda i: i["confidence"])))
    mean = F.try_divide(F.aggregate(icons, F.lit(0.0), lambda s, c: s + F.coalesce(c, F.lit(0.0))), F.size(icons))
    return pages.select("page_id", F.coalesce(F.try_divide(ordered, F.size(names)), F.lit(1.0)).alias("reading_order"), F.coalesce(mean, F.lit(1.0)).alias("symbol_confidence"))
