"""Page layout: furniture, columns, bands, regions, reading order, captions and tables.

Boxes are columns x0, y0, x1, y1. Everything is keyed by page, so windows and joins shuffle by
page_id; furniture alone compares pages of a document.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from folio.functions import geometry as G
from folio.operators import runs


@dataclass(frozen=True)
class LayoutConfig:
    """Fixed values of the layout rules, in points and shares."""

    furniture_top: float = 60.0
    furniture_bottom: float = 750.0
    full_width: float = 0.85
    band_gap: float = 15.0
    gutter: float = 10.0
    margin_width: float = 0.20
    margin_edge: float = 40.0
    callout_width: float = 0.55
    sidebar_width: float = 0.35
    caption_gap: float = 25.0
    caption_length: int = 200
    table_confidence: float = 0.6


DEFAULT = LayoutConfig()


def furniture(lines: DataFrame, share_percent: int = 50, least_pages: int = 2) -> DataFrame:
    """zone, text, n_pages of running headers and footers: zone texts on at least a share of the pages.

    lines: page_id, zone, text. Texts are compared stripped and in lower case; numbers alone don't
    count. The aggregate has partial distinct counts, so a footer of all pages is no hot task.
    """
    norm = F.lower(F.trim("text"))
    rows = lines.select("page_id", "zone", norm.alias("text")).where((F.col("text") != "") & ~F.col("text").rlike("^[0-9]+$"))
    seen = rows.distinct().groupBy("zone", "text").agg(F.count("*").alias("n_pages"))
    total = lines.agg(F.count_distinct("page_id").alias("total"))
    return seen.join(F.broadcast(total), (100 * F.col("n_pages") >= share_percent * F.col("total")) & (F.col("total") >= least_pages)).select("zone", "text", "n_pages")  # one row


def strip_furniture(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Lines that are no furniture, keyed by zone and text."""
    return lines.withColumn("norm", F.lower(F.trim("text"))).join(found.select("zone", F.col("text").alias("norm")), ["zone", "norm"], "left_anti").drop("norm")


def columns_of_pages(items: DataFrame, width: float, bins: int = 10) -> DataFrame:
    """page_id, columns (1 or 2): two if a bin of the middle third of a page's histogram of x0 holds under 2 percent of its items, with 20 percent at least on either side."""
    bin_of = F.least(F.greatest((F.col("x0") * bins / width).cast("int"), F.lit(0)), F.lit(bins - 1))
    counts = items.groupBy("page_id", bin_of.alias("bin")).agg(F.count("*").alias("n"))
    page = counts.groupBy("page_id").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("h"))
    at = lambda b: F.coalesce(F.try_element_at("h", b), F.lit(0))
    upto = lambda lo, hi: F.aggregate(F.sequence(F.lit(0), F.lit(bins - 1)), F.lit(0).cast("long"), lambda s, b: s + F.when((b >= lo) & (b < hi), at(b)).otherwise(F.lit(0)))
    third = bins // 3
    gap = F.exists(F.sequence(F.lit(third), F.lit(bins - third - 1)), lambda b: (50 * at(b) < F.col("total")) & (5 * upto(F.lit(0), b) >= F.col("total")) & (5 * upto(b + 1, F.lit(bins)) >= F.col("total")))
    return page.select("page_id", F.when(gap, 2).otherwise(1).alias("columns"))


def split_furniture(items: DataFrame, cfg: LayoutConfig = DEFAULT) -> DataFrame:
    """items with place: header, footer, full_width (image, vector or table over most of the width) or content."""
    wide = F.col("category").isin("image", "vector", "table") & (F.col("width") > 0) & ((F.col("x1") - F.col("x0")) / F.col("width") >= cfg.full_width)
    place = F.when(F.col("y1") <= cfg.furniture_top, "header").when(F.col("y0") >= cfg.furniture_bottom, "footer").when(wide, "full_width").otherwise("content")
    return items.withColumn("place", place)


def band_boundaries(items: DataFrame, cfg: LayoutConfig = DEFAULT) -> DataFrame:
    """page_id, y: where bands begin and end: the furniture lines, the edges of full-width items, and gaps below the running bottom of what stands above."""
    content = items.where("place = 'content'")
    w = Window.partitionBy("page_id").orderBy("y0", "item_id").rowsBetween(Window.unboundedPreceding, -1)
    bottom = F.greatest(F.lit(cfg.furniture_top), F.coalesce(F.max("y1").over(w), F.lit(cfg.furniture_top)))
    gaps = content.withColumn("bottom", bottom).where(F.col("y0") - F.col("bottom") >= cfg.band_gap).select("page_id", F.explode(F.array("bottom", F.col("y0").cast("double"))).alias("y"))
    edges = items.where("place = 'full_width'").select("page_id", F.explode(F.array(F.col("y0").cast("double"), F.col("y1").cast("double"))).alias("y"))
    ends = items.where("place IN ('content', 'full_width')").select("page_id").distinct().select("page_id", F.explode(F.array(F.lit(cfg.furniture_top), F.lit(cfg.furniture_bottom))).alias("y"))
    return gaps.unionByName(edges).unionByName(ends).distinct()


def bands(items: DataFrame, cfg: LayoutConfig = DEFAULT) -> DataFrame:
    """Content items with band (from 1 down the page), by their vertical centre.

    A centre on a border belongs to both bands, so it is a row in each; what lies in no band forms a
    last one.
    """
    w = Window.partitionBy("page_id").orderBy("y")
    spans = band_boundaries(items, cfg).withColumn("to", F.lead("y").over(w)).where("to IS NOT NULL").select("page_id", F.col("y").alias("from"), "to", F.row_number().over(w).alias("nth"))
    content = items.where("place = 'content'").withColumn("cy", G.centre_y())
    inside = content.join(spans, "page_id").where(F.col("cy").between(F.col("from"), F.col("to")))
    rest = content.join(inside.select("page_id", "item_id"), ["page_id", "item_id"], "left_anti").withColumn("nth", F.lit(2**31 - 1))
    cols = [*items.columns, "nth"]
    order = Window.partitionBy("page_id").orderBy("nth")
    return inside.select(*cols).unionByName(rest.select(*cols)).withColumn("band", F.dense_rank().over(order)).drop("nth")


def columns_in_bands(banded: DataFrame, cfg: LayoutConfig = DEFAULT, bins: int = 20) -> DataFrame:
    """banded items with column (1 or 2): a band is cut at the first run of empty bins of the middle third that is a gutter wide and has 15 percent of the items on either side."""
    centre = G.centre_x()
    bin_of = F.least(F.greatest((centre * bins / F.col("width")).cast("int"), F.lit(0)), F.lit(bins - 1))
    rows = banded.withColumn("bin", bin_of)
    page_band = Window.partitionBy("page_id", "band")
    third = bins // 3
    used = F.collect_set("bin").over(page_band)
    middle = F.filter(F.sequence(F.lit(third), F.lit(bins - third - 1)), lambda b: ~F.array_contains(F.col("used"), b))
    # A run of empty bins starts where the bin before it is used or is the third's edge.
    starts = F.filter(middle, lambda b: (b == third) | F.array_contains(F.col("used"), b - 1))
    ends = lambda b: F.coalesce(F.array_min(F.filter(F.sequence(b, F.lit(bins - third)), lambda e: (e == bins - third) | F.array_contains(F.col("used"), e))), b)
    rows = rows.withColumn("used", used).withColumn("all_bins", F.collect_list("bin").over(page_band))
    left = lambda b: F.size(F.filter("all_bins", lambda x: x < b))
    right = lambda e: F.size(F.filter("all_bins", lambda x: x >= e))
    total = F.size("all_bins")
    good = F.filter(starts, lambda b: ((ends(b) - b) * F.col("width") / bins >= cfg.gutter) & (100 * left(b) >= 15 * total) & (100 * right(ends(b)) >= 15 * total))
    gutter = F.when((total >= 2) & (F.col("width") > 0), F.array_min(good) * F.col("width") / bins)
    return rows.withColumn("gutter", gutter).withColumn("column", F.when(F.col("gutter").isNull() | (centre < F.col("gutter")), 1).otherwise(2)).drop("bin", "used", "all_bins", "gutter")


def region_kind(cfg: LayoutConfig = DEFAULT) -> Column:
    """Kind of a column region from its counts (n_text, n_image, n_table, n_vector, n), its box and the page width."""
    share = F.when(F.col("width") > 0, (F.col("x1") - F.col("x0")) / F.col("width")).otherwise(F.lit(0.0))
    edge = (F.col("x0") <= cfg.margin_edge) | (F.col("width") - F.col("x1") <= cfg.margin_edge)
    text = F.col("n_text") >= 1
    return (
        F.when((F.col("n_table") > 0) & (2 * F.col("n_table") >= F.col("n")), "table_area")
        .when((F.col("n_image") > 0) & (2 * F.col("n_image") >= F.col("n")) & (F.col("n_text") < 3), "figure_area")
        .when((share < cfg.margin_width) & text & edge, "margin_note")
        .when((share < cfg.callout_width) & text & (F.col("n_image") + F.col("n_vector") >= 1), "callout_area")
        .when((share < cfg.sidebar_width) & text, "sidebar")
        .when(text, "body")
        .otherwise("unknown")
    )


def regions(items: DataFrame, cfg: LayoutConfig = DEFAULT) -> DataFrame:
    """page_id, ordinal, region_id, kind, x0.., n, confidence, item_ids of every page.

    items: page_id, item_id, category (text, image, vector, table), x0.., width. Furniture comes
    first, then full-width items, then the columns of bands down the page.
    """
    from folio.functions import ids

    placed = split_furniture(items, cfg)
    count = lambda c: F.count_if(F.col("category") == c).alias(f"n_{c}")
    gather = [*G.union_box(), F.count("*").alias("n"), F.max("width").alias("width"), *map(count, ("text", "image", "table", "vector")), F.sort_array(F.collect_list("item_id")).alias("item_ids")]
    edge = placed.where("place IN ('header', 'footer')").groupBy("page_id", F.col("place").alias("kind")).agg(*gather)
    edge = edge.withColumn("confidence", F.lit(0.9)).withColumn("sort", F.struct(F.when(F.col("kind") == "header", 1).otherwise(2).alias("a"), F.lit(0).alias("b"), F.lit(0.0).alias("c"), F.lit("").alias("d")))
    full = placed.where("place = 'full_width'").withColumn("kind", F.when(F.col("category") == "table", "table_area").when(F.col("category") == "image", "figure_area").otherwise("full_width"))
    full = full.groupBy("page_id", "kind", F.col("item_id").alias("own"), F.col("y0").alias("top")).agg(*gather).withColumn("confidence", F.lit(1.0))
    full = full.withColumn("sort", F.struct(F.lit(3).alias("a"), F.lit(0).alias("b"), F.col("top").cast("double").alias("c"), F.col("own").cast("string").alias("d"))).drop("own", "top")
    cols = columns_in_bands(bands(placed, cfg), cfg).groupBy("page_id", "band", "column").agg(*gather).withColumn("kind", region_kind(cfg))
    cols = cols.withColumn("confidence", F.when(F.col("n") >= 5, 0.9).when(F.col("n") >= 2, 0.8).otherwise(0.7))
    cols = cols.withColumn("sort", F.struct(F.lit(4).alias("a"), F.col("band").alias("b"), F.col("column").cast("double").alias("c"), F.lit("").alias("d"))).drop("band", "column")
    every = edge.unionByName(full).unionByName(cols)
    ordinal = F.row_number().over(Window.partitionBy("page_id").orderBy("sort"))
    return every.withColumn("ordinal", ordinal).withColumn("region_id", ids.region_id(F.col("ordinal"))).select("page_id", "ordinal", "region_id", "kind", "x0", "y0", "x1", "y1", "n", "confidence", "item_ids")


def assign_to_regions(blocks: DataFrame, areas: DataFrame) -> DataFrame:
    """blocks with region_id: the first region by ordinal that holds the block's centre; null if none does."""
    b, r = blocks.alias("b"), areas.select("page_id", "ordinal", "region_id", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    rows = b.withColumn("cx", G.centre_x()).withColumn("cy", G.centre_y())
    hit = rows.join(r, "page_id").where(F.col("cx").between(F.col("r_x0"), F.col("r_x1")) & F.col("cy").between(F.col("r_y0"), F.col("r_y1")))
    first = hit.groupBy("page_id", "block_id").agg(F.min_by("region_id", "ordinal").alias("region_id"))
    return blocks.join(first, ["page_id", "block_id"], "left")


def captions(blocks: DataFrame, cfg: LayoutConfig = DEFAULT) -> DataFrame:
    """page_id, caption_id, figure_id: short paragraphs right under a figure.

    Each paragraph looks for the figure whose bottom is nearest above it within the gap; of the
    paragraphs that found the same figure, the first by pos is its caption.
    """
    figures = blocks.where("kind = 'figure'").select("page_id", F.col("block_id").alias("figure_id"), F.col("pos").alias("f_pos"), F.col("y1").alias("bottom"), F.col("x0").alias("f_x0"), F.col("x1").alias("f_x1"))
    texts = blocks.where((F.col("kind") == "paragraph") & (F.length("text") <= cfg.caption_length))
    near = texts.join(figures, "page_id").where((F.col("y0") - F.col("bottom")).between(0, cfg.caption_gap) & (F.col("x0") <= F.col("f_x1")) & (F.col("f_x0") <= F.col("x1")))
    own = near.groupBy("page_id", "block_id", "pos").agg(F.min_by("figure_id", F.struct(F.col("y0") - F.col("bottom"), "f_pos")).alias("figure_id"))
    return own.groupBy("page_id", "figure_id").agg(F.min_by("block_id", "pos").alias("caption_id"))


def tables(blocks: DataFrame, candidates: DataFrame, cfg: LayoutConfig = DEFAULT) -> DataFrame:
    """page_id, block_id, evidence_id: blocks that lie to a half at least in a sure table candidate, the best one."""
    c = candidates.where(F.col("confidence") >= cfg.table_confidence).select("page_id", "evidence_id", *[F.col(k).alias(f"t_{k}") for k in ("x0", "y0", "x1", "y1")])
    rows = blocks.join(c, "page_id").withColumn("share", G.overlap_share("", "t_")).where("share >= 0.5")
    return rows.groupBy("page_id", "block_id").agg(F.max_by("evidence_id", F.struct("share", "evidence_id")).alias("evidence_id"))


def zone_overlap(zones: DataFrame) -> DataFrame:
    """page_id, pairs, overlapping: pairs of a page's zones (zone_id, x0..) and how many overlap."""
    left = zones.select("page_id", "zone_id", *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    right = zones.select("page_id", F.col("zone_id").alias("other"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    pairs = left.join(right, "page_id").where("zone_id < other")
    strict = (F.col("a_x0") < F.col("b_x1")) & (F.col("b_x0") < F.col("a_x1")) & (F.col("a_y0") < F.col("b_y1")) & (F.col("b_y0") < F.col("a_y1"))
    return pairs.groupBy("page_id").agg(F.count("*").alias("pairs"), F.count_if(strict).alias("overlapping"))


def difficulty(pages: DataFrame) -> DataFrame:
    """pages (coverage, columns, agreement) with hard and route: R3 if extractors disagree, R2 for little text or two columns, else R1."""
    r3 = F.col("agreement") < 0.90
    r2 = (F.col("coverage") < 0.30) | (F.col("columns") >= 2)
    return pages.withColumn("route", F.when(r3, "R3").when(r2, "R2").otherwise("R1")).withColumn("hard", r2 | r3)


def reading_order(areas: DataFrame) -> DataFrame:
    """page_id, region_id, role (main, aside or furniture), band, position: main regions top to bottom in bands and left to right in a band; asides after their nearest main region.

    Bands grow as regions join them (a region joins the first band that covers half its height), so
    each page is folded in order.
    """
    aside = F.col("kind").isin("sidebar", "margin_note", "callout_area")
    role = F.when(F.col("kind").isin("header", "footer"), "furniture").when(aside, "aside").otherwise("main")
    rows = areas.withColumn("role", role).select("page_id", "ordinal", "region_id", "role", "x0", "y0", "x1", "y1")
    schema = StructType([*(rows.schema[c] for c in ("page_id", "region_id", "role")), StructField("band", IntegerType()), StructField("position", IntegerType()), StructField("main_region", rows.schema["region_id"].dataType)])

    def order(page: list[dict]) -> list[dict]:
        found: list[list[float]] = []
        band_of = {}
        main = sorted((r for r in page if r["role"] == "main"), key=lambda r: (r["y0"], r["x0"], r["ordinal"]))
        for r in main:
            height = r["y1"] - r["y0"]
            k = next((i for i, b in enumerate(found) if height > 0 and (min(r["y1"], b[1]) - max(r["y0"], b[0])) / height >= 0.5), None)
            if k is None:
                found.append([r["y0"], r["y1"]])
                k = len(found) - 1
            else:
                found[k] = [min(found[k][0], r["y0"]), max(found[k][1], r["y1"])]
            band_of[r["region_id"]] = k
        rank = {k: n for n, k in enumerate(sorted(range(len(found)), key=lambda i: found[i][0]))}
        line = sorted(main, key=lambda r: (rank[band_of[r["region_id"]]], r["x0"], r["ordinal"]))
        row = lambda r, band=None, position=None, near=None: {"page_id": r["page_id"], "region_id": r["region_id"], "role": r["role"], "band": band, "position": position, "main_region": near}
        out = [row(r, rank[band_of[r["region_id"]]] + 1, n + 1) for n, r in enumerate(line)]
        far = lambda r, m: ((m["x0"] + m["x1"] - r["x0"] - r["x1"]) ** 2 + (m["y0"] + m["y1"] - r["y0"] - r["y1"]) ** 2, m["ordinal"])
        for r in page:
            if r["role"] != "main":
                near = min(line, key=lambda m: far(r, m), default=None) if r["role"] == "aside" else None
                out.append(row(r, near=near and near["region_id"]))
        return out

    return runs.folded(rows, ["page_id"], order, schema)


def order_confidence(order: DataFrame) -> DataFrame:
    """page_id, confidence of reading orders: from 1, 0.1 less for each band of several regions, 0.03 for each further band, 0.05 for asides; between 0.3 and 1."""
    bands = order.where("role = 'main'").groupBy("page_id", "band").agg(F.count("*").alias("n")).groupBy("page_id").agg(F.count_if(F.col("n") > 1).alias("wide"), F.count("*").alias("bands"))
    pages = order.groupBy("page_id").agg(F.bool_or(F.col("role") == "aside").alias("aside"))
    rows = pages.join(bands, "page_id", "left").na.fill(0, ["wide", "bands"])
    value = 1.0 - 0.1 * F.col("wide") - 0.03 * F.greatest(F.col("bands") - 1, F.lit(0)) - F.when(F.col("aside"), 0.05).otherwise(0.0)
    return rows.select("page_id", F.greatest(F.lit(0.3), F.least(F.lit(1.0), value)).alias("confidence"))


def vector_clusters(paths: DataFrame, margin: float = 2.0) -> DataFrame:
    """page_id, cluster (its smallest path), x0.., n, digest: groups of two or more paths whose boxes meet within a margin.

    Meeting boxes are found by a grid over the page (equal cells, so a join on page and cell), and
    groups by connected components over the whole table.
    """
    from folio.operators.graph import components

    cell = 64.0
    key = F.concat_ws("/", "page_id", "path_id")
    span = lambda lo, hi: F.sequence(F.floor((F.col(lo) - margin) / cell), F.floor((F.col(hi) + margin) / cell))
    rows = paths.withColumn("node", key)
    cells = rows.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))
    left = cells.select("page_id", "cx", "cy", F.col("node").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    right = cells.select("page_id", "cx", "cy", F.col("node").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    edges = left.join(right, ["page_id", "cx", "cy"]).where((F.col("a") < F.col("b")) & G.boxes_meet("a_", "b_", margin)).select("a", "b").distinct()
    found = rows.join(components(edges, "a", "b"), F.col("node") == F.col("id"))
    digest = F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("node")), " "), 256), 1, 12)
    return found.groupBy("page_id", F.col("component").alias("cluster")).agg(*G.union_box(), F.count("*").alias("n"), digest.alias("digest"))


def suppress_overlaps(boxes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Greedy suppression by page: the best score first, boxes whose overlap with a kept one exceeds the threshold go. A fold, so a grouped map."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "box_id"], ascending=[False, True])
        kept: list = []
        for r in pdf.itertuples():
            for k in kept:
                w, h = min(r.x1, k.x1) - max(r.x0, k.x0), min(r.y1, k.y1) - max(r.y0, k.y0)
                both = max(0.0, w) * max(0.0, h)
                whole = (r.x1 - r.x0) * (r.y1 - r.y0) + (k.x1 - k.x0) * (k.y1 - k.y0) - both
                if whole > 0 and both / whole > threshold:
                    break
            else:
                kept.append(r)
        return pdf.loc[[k.Index for k in kept]]

    return boxes.groupBy("page_id").applyInPandas(keep, boxes.schema)


def drop_in_figure_areas(assigned: DataFrame, areas: DataFrame) -> DataFrame:
    """Blocks (with region_id) without the paragraphs and headings that stand in a figure's area: labels and photographed text."""
    figure = areas.where("kind = 'figure_area'").select("page_id", "region_id").distinct().withColumn("in_figure", F.lit(True))
    rows = assigned.join(figure, ["page_id", "region_id"], "left")
    return rows.where(~(F.col("kind").isin("paragraph", "heading") & F.coalesce("in_figure", F.lit(False)))).select(*assigned.columns)


def spans_on_images(spans: DataFrame, images: DataFrame, most_chars: int = 5, tolerance: float = 2.0) -> DataFrame:
    """page_id, span_id of short spans (five characters at most) that lie within an image: numbers and labels of a drawing."""
    short = spans.where(F.length(F.trim("text")) <= most_chars)
    boxes = images.select("page_id", *[F.col(c).alias(f"i_{c}") for c in ("x0", "y0", "x1", "y1")])
    return short.join(boxes, "page_id").where(G.contains("i_", "", tolerance)).select("page_id", "span_id").distinct()


def images_over_text(images: DataFrame, spans: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """page_id, image_id of images whose box, widened by the tolerance, overlaps a span's."""
    boxes = spans.select("page_id", *[F.col(c).alias(f"s_{c}") for c in ("x0", "y0", "x1", "y1")])
    meets = (F.col("x0") < F.col("s_x1") + tolerance) & (F.col("x1") > F.col("s_x0") - tolerance) & (F.col("y0") < F.col("s_y1") + tolerance) & (F.col("y1") > F.col("s_y0") - tolerance)
    return images.join(boxes, "page_id").where(meets).select("page_id", "image_id").distinct()


def lines_in_tables(lined: DataFrame, areas: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """page_id, line, table: the first table area (by ordinal) that holds the centres of more than half of a line's spans."""
    size = lined.groupBy("page_id", "line").agg(F.count("*").alias("n"))
    boxes = areas.select("page_id", "ordinal", *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    cx, cy = G.centre_x(), G.centre_y()
    inside = lined.join(boxes, "page_id").where(cx.between(F.col("t_x0") - tolerance, F.col("t_x1") + tolerance) & cy.between(F.col("t_y0") - tolerance, F.col("t_y1") + tolerance))
    hits = inside.groupBy("page_id", "line", "ordinal").agg(F.count("*").alias("hit")).join(size, ["page_id", "line"]).where("2 * hit > n")
    return hits.groupBy("page_id", "line").agg(F.min("ordinal").alias("table"))


def region_edges(assigned: DataFrame) -> DataFrame:
    """page_id, edge_kind, source_id, target_id: an edge from each block to its region."""
    return assigned.where(F.coalesce("region_id", F.lit("")) != "").select("page_id", F.lit("block_to_region").alias("edge_kind"), F.col("block_id").alias("source_id"), F.col("region_id").alias("target_id"))


def in_region_order(assigned: DataFrame, areas: DataFrame, main_flow: DataFrame) -> DataFrame:
    """Blocks (with region_id) with nth, from 1: by their region's place in the main flow (page_id, region_id, position), then y0, then pos.

    Regions beside the flow take the place of the main region whose vertical centre is nearest (the first by ordinal on ties); blocks in no region come last.
    """
    centre = areas.select("page_id", "region_id", "ordinal", G.centre_y().alias("cy")).join(main_flow.select("page_id", "region_id", "position"), ["page_id", "region_id"], "left")
    main = centre.where("position IS NOT NULL").select("page_id", F.col("cy").alias("m_cy"), F.col("ordinal").alias("m_ordinal"), F.col("position").alias("m_position"))
    nearest = F.min_by("m_position", F.struct(F.abs(F.col("cy") - F.col("m_cy")), "m_ordinal"))
    aside = centre.where("position IS NULL").join(main, "page_id").groupBy("page_id", "region_id").agg(nearest.alias("position"))
    places = centre.where("position IS NOT NULL").select("page_id", "region_id", "position").unionByName(aside)
    rows = assigned.join(places, ["page_id", "region_id"], "left")
    order = Window.partitionBy("page_id").orderBy(F.coalesce("position", F.lit(2**31 - 1)), F.coalesce("y0", F.lit(0.0)), "pos")
    return rows.withColumn("nth", F.row_number().over(order)).select(*assigned.columns, "nth")


def resolve_semantics(blocks: DataFrame, areas: DataFrame, candidates: DataFrame, cfg: LayoutConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Blocks (page_id, block_id, pos, kind, region_id, text) as their regions make them, and the edges that this finds.

    In order: regions are assigned, paragraphs under figures become captions, text in figures' areas and clusters of short headings go, blocks of a
    callout's area are joined, blocks within sure tables become tables, and each block is tied to its region.
    """
    from folio.operators import structure

    rows = assign_to_regions(blocks, areas)
    found = captions(rows, cfg)
    rows = rows.join(found.select("page_id", F.col("caption_id").alias("block_id"), F.lit(True).alias("is_caption")), ["page_id", "block_id"], "left")
    rows = rows.withColumn("kind", F.when(F.col("is_caption"), "caption").otherwise(F.col("kind"))).drop("is_caption")
    rows = structure.drop_heading_clusters(drop_in_figure_areas(rows, areas))
    kinds = areas.select("page_id", "region_id", F.col("kind").alias("region_kind"))
    boxes = rows.select("page_id", "block_id", "x0", "y0", "x1", "y1")
    joined = structure.promote_callouts(rows.join(kinds, ["page_id", "region_id"], "left"))
    joined = joined.withColumnRenamed("region_id", "callout_id").join(rows.select("page_id", "block_id", "region_id"), ["page_id", "block_id"], "left")
    in_table = tables(boxes.join(joined.where("kind <> 'callout'").select("page_id", "block_id"), ["page_id", "block_id"]), candidates, cfg)
    joined = joined.join(in_table, ["page_id", "block_id"], "left")
    out = joined.select("page_id", "block_id", "pos", F.when(F.col("evidence_id").isNotNull(), "table").otherwise(F.col("kind")).alias("kind"), F.coalesce("callout_id", "region_id").alias("region_id"), "text")
    edge = lambda df, kind, source, target: df.select("page_id", F.lit(kind).alias("edge_kind"), F.col(source).alias("source_id"), F.col(target).alias("target_id"))
    edges = edge(found, "caption", "caption_id", "figure_id").unionByName(edge(in_table, "table", "block_id", "evidence_id")).unionByName(region_edges(out))
    return out, edges


def classification_confidence(blocks: DataFrame) -> DataFrame:
    """page_id, confidence: 0.7 and 0.3 times the share of blocks that are more than paragraphs."""
    share = F.avg((F.col("kind") != "paragraph").cast("double"))
    return blocks.groupBy("page_id").agg(F.greatest(F.lit(0.5), F.least(F.lit(1.0), F.lit(0.7) + share * 0.3)).alias("confidence"))
