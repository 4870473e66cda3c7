"""Blocks from spans and words: lines, lists, headings, callouts, icons, long paragraphs.

Steps whose rule looks at neighbours only are windows; those whose state depends on what was kept or
merged before are folds, by page.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions import text as T
from folio.operators import runs


def lines_by_chain(spans: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """spans with line (from 1): a span starts a line if it is a tolerance or more below or above the span before it, in order of y0, x0."""
    w = Window.partitionBy("page_id").orderBy("y0", "x0", "span_id")
    new = F.coalesce((F.abs(F.col("y0") - F.lag("y0").over(w)) >= tolerance).cast("int"), F.lit(1))
    return spans.withColumn("new", new).withColumn("line", F.sum("new").over(w)).drop("new")


def line_boxes(lined: DataFrame) -> DataFrame:
    """page_id, line, x0.., n, text: the lines with their text from left to right. A line's spans are exchanged packed, and it is made of its arrays."""
    by = ["page_id", "line"]
    packed = runs.packed(lined.select(*by, "x0", "y0", "x1", "y1", "span_id", "text"), by)
    boxed = packed.select(*by, "x0", "span_id", "text", *[F.array(f(c)).alias(c) for f, c in ((F.array_min, "y0"), (F.array_max, "x1"), (F.array_max, "y1"))])
    rows = runs.merged(boxed, by)
    text = F.array_join(F.transform(F.sort_array(F.arrays_zip("x0", "span_id", "text")), lambda s: s["text"]), " ")
    box = [F.array_min("x0").alias("x0"), F.array_min("y0").alias("y0"), F.array_max("x1").alias("x1"), F.array_max("y1").alias("y1")]
    return rows.select("page_id", "line", *box, F.size("text").cast("long").alias("n"), text.alias("text"))


def lines_by_anchor(spans: DataFrame, tolerance: float = 6.0) -> DataFrame:
    """spans with line: a span joins the current line if its y0 is within the tolerance of the line's first span. The first span counts, so a fold."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y0", "x0", "span_id"])
        lines, anchor, line = [], None, 0
        for y in pdf["y0"]:
            if anchor is None or abs(y - anchor) >= tolerance:
                anchor, line = y, line + 1
            lines.append(line)
        return pdf.assign(line=lines)

    from pyspark.sql.types import IntegerType, StructField, StructType

    return spans.groupBy("page_id").applyInPandas(fold, StructType([*spans.schema.fields, StructField("line", IntegerType())]))


def span_role(spans: DataFrame, heading_fonts: list[str], decorative_fonts: list[str], bold_fonts: list[str], footer_y: float = 790.0, heading_size: float = 8.0, subheading_size: float = 10.0) -> DataFrame:
    """spans with role, by ordered rules on place, font and size."""
    font, size = F.col("font_name"), F.col("font_size")
    role = (
        F.when(F.col("y0") >= footer_y, "footer")
        .when(font.isin(decorative_fonts), "decorative")
        .when(font.isin(heading_fonts) & (size >= heading_size), "heading")
        .when(font.isin(bold_fonts) & (size >= subheading_size), "subheading")
        .when(font.isin(bold_fonts), "bold")
        .when(F.trim("text").rlike(T.STEP_NUMBER), "step_number")
        .otherwise("body")
    )
    return spans.withColumn("role", role)


def heading_levels(headings: DataFrame) -> DataFrame:
    """headings with level: by page, the largest size gives 1 (from 14), 2 (from 10) or 3, and each smaller distinct size one more, 6 at most."""
    w = Window.partitionBy("page_id")
    base = F.when(F.max("font_size").over(w) >= 14, 1).when(F.max("font_size").over(w) >= 10, 2).otherwise(3)
    rank = F.dense_rank().over(w.orderBy(F.desc("font_size")))
    return headings.withColumn("level", F.least(base + rank - 1, F.lit(6)))


def paragraphs(lines: DataFrame, factor: float = 1.5, least_gap: float = 12.0) -> DataFrame:
    """lines with paragraph (from 1): a gap above of over factor x font size (or the least gap, if larger) starts one."""
    w = Window.partitionBy("page_id").orderBy("y0", "line")
    gap = F.col("y0") - F.lag("y1").over(w)
    new = F.coalesce((gap > F.greatest(F.lit(least_gap), factor * F.col("font_size"))).cast("int"), F.lit(1))
    return lines.withColumn("new", new).withColumn("paragraph", F.sum("new").over(w)).drop("new")


def drop_heading_clusters(blocks: DataFrame, least: int = 3, most_chars: int = 5) -> DataFrame:
    """Without runs of three or more short headings (five characters at most)."""
    w = Window.partitionBy("page_id").orderBy("pos")
    short = (F.col("kind") == "heading") & (F.length(F.trim("text")) <= most_chars)
    rows = blocks.withColumn("short", short).withColumn("change", (F.col("short") != F.coalesce(F.lag("short").over(w), F.lit(False))).cast("int"))
    rows = rows.withColumn("island", F.sum("change").over(w)).withColumn("run", F.count("*").over(Window.partitionBy("page_id", "island")))
    return rows.where(~F.col("short") | (F.col("run") < least)).select(*blocks.columns)


def drop_repeated(blocks: DataFrame, chars: int = 80) -> DataFrame:
    """Without blocks whose first 80 characters equal those of the block before; since equality is transitive, the block before and the last one kept agree."""
    w = Window.partitionBy("page_id").orderBy("pos")
    key = F.substring("text", 1, chars)
    rows = blocks.withColumn("before", F.lag(key).over(w))
    return rows.where(F.col("before").isNull() | (key == "") | (key != F.col("before"))).select(*blocks.columns)


def drop_recent_repeats(blocks: DataFrame, within: int = 5, least_chars: int = 3, chars: int = 80) -> DataFrame:
    """Without blocks that repeat the kind and first 80 characters of one of the last five kept. Fold over a page's blocks in order."""
    items = F.sort_array(F.collect_list(F.struct("pos", "block_id", "kind", F.substring("text", 1, chars).alias("key"))))
    start = F.struct(F.array().cast("array<string>").alias("recent"), F.array().cast("array<string>").alias("kept"))

    def step(state, b):
        key = F.concat_ws("\u0001", b["kind"], b["key"])
        again = (F.length(b["key"]) >= least_chars) & F.array_contains(state["recent"], key)
        more = F.concat(state["recent"], F.array(key))
        recent = F.when(F.size(more) > within, F.slice(more, -within, within)).otherwise(more)
        return F.when(again, state).otherwise(F.struct(recent.alias("recent"), F.concat(state["kept"], F.array(b["block_id"])).alias("kept")))

    kept = blocks.groupBy("page_id").agg(F.aggregate(items, start, step)["kept"].alias("kept")).select("page_id", F.explode("kept").alias("block_id"))
    return blocks.join(kept, ["page_id", "block_id"], "left_semi")


def merge_list_continuations(blocks: DataFrame, gap_low: float = -5.0, gap_high: float = 20.0, short: int = 5, indent: float = 5.0) -> DataFrame:
    """A list item absorbs the paragraphs that follow it: those at most 20 points below its growing box, if the item is short or they are indented as far.

    The box grows with each paragraph, so each page is folded in order.
    """
    box = ("x0", "y0", "x1", "y1")

    def fold(page: list[dict]) -> list[dict]:
        out: list[dict] = []
        for b in sorted(page, key=lambda b: (b["pos"] is None, b["pos"] or 0)):
            item = out[-1] if out and out[-1]["kind"] == "list_item" else None
            if item is not None and b["kind"] == "paragraph" and not any(x[c] is None or x[c] != x[c] for x in (item, b) for c in box):
                gap = b["y0"] - item["y1"]
                if gap_low <= gap <= gap_high and (len(item["text"].strip()) <= short or b["x0"] >= item["x0"] - indent):
                    space = "" if not item["text"] or not b["text"] or item["text"][-1].isspace() else " "
                    item["text"] += space + b["text"]
                    item |= {"x0": min(item["x0"], b["x0"]), "y0": min(item["y0"], b["y0"]), "x1": max(item["x1"], b["x1"]), "y1": max(item["y1"], b["y1"])}
                    continue
            out.append(b)
        return out

    return runs.folded(blocks, ["page_id"], fold, blocks.schema)


def promote_callouts(blocks: DataFrame) -> DataFrame:
    """Consecutive blocks of one callout region become one callout: its first block's id and the joined text; other blocks stay."""
    w = Window.partitionBy("page_id").orderBy("pos")
    inside = F.when(F.col("region_kind") == "callout_area", F.col("region_id"))
    rows = blocks.withColumn("inside", inside).withColumn("new", F.coalesce((~F.col("inside").eqNullSafe(F.lag("inside").over(w)) | F.col("inside").isNull()).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("new").over(w))
    parts = F.sort_array(F.collect_list(F.struct("pos", "text")))
    return rows.groupBy("page_id", "island").agg(
        F.min_by("block_id", "pos").alias("block_id"),
        F.min("pos").alias("pos"),
        F.when(F.max("inside").isNotNull(), "callout").otherwise(F.min_by("kind", "pos")).alias("kind"),
        F.max("inside").alias("region_id"),
        F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"),
    ).drop("island")


def split_long(blocks: DataFrame, at: int = 600) -> DataFrame:
    """Paragraphs are cut, again and again, at the last sentence boundary within their first 600 characters; the parts' ids get .1, .2, ...

    The cutting is a fold over the text's sentences, which Spark's higher-order functions do: a
    sentence joins the current part unless the part would reach beyond the limit.
    """
    sentences = F.split("text", r"(?<=\. )(?=[A-ZА-ЯЁ])")
    start = F.array().cast("array<string>")

    def step(parts, s):
        last = F.try_element_at(parts, F.lit(-1))
        fits = F.length(F.concat(last, s)) - 1 <= at
        grown = F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(F.concat(last, s)))
        return F.when(F.size(parts) == 0, F.array(s)).when(fits, grown).otherwise(F.concat(parts, F.array(s)))

    parts = F.when((F.col("kind") == "paragraph") & (F.length("text") > at), F.aggregate(sentences, start, step)).otherwise(F.array("text"))
    rows = blocks.withColumn("n", F.size(parts)).select("*", F.posexplode(parts).alias("part", "piece"))
    name = F.when(F.col("n") > 1, F.concat("block_id", F.lit("."), F.col("part") + 1)).otherwise(F.col("block_id"))
    return rows.withColumn("block_id", name).withColumn("text", F.trim("piece")).drop("n", "piece")


def distinct_instances(placements: DataFrame) -> DataFrame:
    """One placement per page and instance: in a heading, paragraph or list item if there is one, else the first. Placements without an instance stay."""
    rank = Window.partitionBy("page_id", "instance_id").orderBy(F.when(F.col("kind").isin("heading", "paragraph", "list_item"), 0).otherwise(1), "pos")
    named = placements.where(F.coalesce("instance_id", F.lit("")) != "")
    first = named.withColumn("nth", F.row_number().over(rank)).where("nth = 1").drop("nth")
    return first.unionByName(placements.where(F.coalesce("instance_id", F.lit("")) == ""))


def place_icons(words: DataFrame, icons: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """page_id, block_id, icon_id, before: how many of the block's words stand before each icon.

    An icon belongs to a block if its centre is within the tolerance of the block's height; it goes
    before the first word whose end is at or beyond its x. Icons left of all words come first.
    """
    lines = words.groupBy("page_id", "block_id").agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"))
    hit = icons.select("page_id", "icon_id", "x0", "y0", "y1").withColumn("cy", G.centre_y()).join(lines, "page_id").where(F.col("cy").between(F.col("top") - tolerance, F.col("bottom") + tolerance))
    own = hit.groupBy("page_id", "icon_id").agg(F.min_by(F.struct("block_id", "x0"), F.struct(F.abs(F.col("cy") - (F.col("top") + F.col("bottom")) / 2), "block_id")).alias("b"))
    named = own.select("page_id", "icon_id", F.col("b.block_id").alias("block_id"), F.col("b.x0").alias("icon_x"))
    return named.join(words.select("page_id", "block_id", F.col("x1").alias("end")), ["page_id", "block_id"]).groupBy("page_id", "block_id", "icon_id").agg(F.count_if(F.col("end") < F.col("icon_x")).alias("before"))


def joined_spans(spans: DataFrame, gap: float = 1.5) -> DataFrame:
    """page_id, line, nth, marks, text: neighbours with the same marks on a line become one inline; a space where the gap between them is wider."""
    w = Window.partitionBy("page_id", "line").orderBy("x0", "span_id")
    rows = spans.withColumn("new", F.coalesce((F.col("marks") != F.lag("marks").over(w)).cast("int"), F.lit(1)))
    rows = rows.withColumn("space", F.when(F.col("x0") - F.lag("x1").over(w) > gap, " ").otherwise("")).withColumn("nth", F.sum("new").over(w))
    parts = F.sort_array(F.collect_list(F.struct("x0", "span_id", F.when(F.col("new") == 1, F.lit("")).otherwise(F.col("space")).alias("space"), "text")))
    return rows.groupBy("page_id", "line", "nth").agg(F.first("marks").alias("marks"), F.array_join(F.transform(parts, lambda p: F.concat(p["space"], p["text"])), "").alias("text"))


def build_page(blocks: DataFrame) -> DataFrame:
    """page_id, blocks (array in order), reading_order, n_blocks: one row a page."""
    items = F.sort_array(F.collect_list(F.struct("pos", "block_id", "kind", "text")))
    return blocks.groupBy("page_id").agg(items.alias("blocks")).withColumn("reading_order", F.transform("blocks", lambda b: b["block_id"])).withColumn("n_blocks", F.size("blocks"))


def average_char_width(spans: DataFrame) -> DataFrame:
    """page_id, char_width: the width of a page's spans over their characters; 10 where there is none."""
    n, width = F.sum(F.length("text")), F.sum(F.when(F.length("text") > 0, F.col("x1") - F.col("x0")))
    return spans.groupBy("page_id").agg(F.coalesce(F.try_divide(width.cast("double"), n), F.lit(10.0)).alias("char_width"))


def icon_locations(blocks: DataFrame) -> DataFrame:
    """page_id, instance_id, pos, child: where icons with an instance stand (blocks with children)."""
    rows = blocks.select("page_id", "pos", F.posexplode("children").alias("child", "i"))
    return rows.where((F.col("i.type") == "icon") & (F.coalesce("i.instance_id", F.lit("")) != "")).select("page_id", F.col("i.instance_id").alias("instance_id"), "pos", "child")


def postprocess(blocks: DataFrame) -> DataFrame:
    """Blocks as a reader gets them: long paragraphs cut, then recent repeats left out."""
    cut = split_long(blocks).withColumn("pos", F.col("pos") * 1000 + F.col("part"))
    return drop_recent_repeats(cut)
