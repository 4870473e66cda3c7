"""Assets: classes and occurrences from evidence, symbol matches, and placing symbols in lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions import ids
from folio.operators import asof


def occurrences(evidence: DataFrame, inline_area: float = 900.0) -> DataFrame:
    """occurrence_id, class_id, page_id, evidence_id, context: evidence (page_id, evidence_id, kind, content_hash, x0..) by the class of its content.

    Occurrences are numbered from 0 on their page; images under 900 square points are inline, others
    float; vector clusters are decoration.
    """
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("evidence_id")) - 1
    context = F.when(F.col("kind") == "vector_cluster", "decoration").when(G.area() < inline_area, "inline").otherwise("float")
    rows = evidence.where(F.col("kind").isin("image", "vector_cluster")).withColumn("occurrence_id", ids.occurrence_id(F.col("page_id"), nth))
    return rows.select("occurrence_id", ids.asset_class_id(F.col("kind"), F.col("content_hash")).alias("class_id"), "page_id", "evidence_id", context.alias("context"))


def classes(found: DataFrame) -> DataFrame:
    """class_id with its first occurrence's page and context, and how often it occurs. One aggregate with partial minima."""
    return found.groupBy("class_id").agg(F.min_by(F.struct("page_id", "context"), F.struct("page_id", "occurrence_id")).alias("f"), F.count("*").alias("n")).select("class_id", F.col("f.page_id").alias("first_page"), F.col("f.context").alias("context"), "n")


def accepted_matches(candidates: DataFrame, default_threshold: float = 0.93, secondary: float = 0.98, most: int = 50) -> DataFrame:
    """Symbol matches (page_id, symbol_id, score, threshold, x0, y0): those at their threshold, with 98 percent of the best score of the symbol on the page, 50 of a symbol at most."""
    w = Window.partitionBy("page_id", "symbol_id").orderBy(F.desc("score"), "y0", "x0")
    rows = candidates.where(F.col("score") >= F.coalesce("threshold", F.lit(default_threshold)))
    rows = rows.withColumn("nth", F.row_number().over(w)).withColumn("best", F.first("score").over(w))
    return rows.where((F.col("nth") <= most) & (F.col("score") >= secondary * F.col("best"))).drop("best")


def nearest_lines(symbols: DataFrame, lines: DataFrame, tolerance: float = 6.0, near_text: float = 15.0) -> DataFrame:
    """symbols with line and anchor: the line with the nearest vertical centre on the page.

    anchor: inline if that is within the tolerance, near_text within 15 points, else block; page if
    the page has no line. Of equally near lines the first counts.
    """
    rows = asof.nearest(symbols, lines, ["page_id"], G.centre_y(), G.centre_y(), ["line"])
    d = F.col("near.distance")
    anchor = F.when(d.isNull(), "page").when(d <= tolerance, "inline").when(d <= near_text, "near_text").otherwise("block")
    return rows.withColumn("line", F.col("near.line")).withColumn("anchor", anchor).drop("near")


def symbol_refs(placed: DataFrame) -> DataFrame:
    """page_id, symbol_id, instance_id, anchor_kind, evidence_id, confidence of placed symbols (nearest_lines): the line is the evidence of those in or near text."""
    near = F.col("anchor").isin("inline", "near_text")
    return placed.select("page_id", "symbol_id", "instance_id", F.col("anchor").alias("anchor_kind"), F.when(near, F.format_string("%s.l%03d", "page_id", "line")).alias("evidence_id"), F.col("score").alias("confidence"))


def icon_candidates(images: DataFrame, most: int = 80, least: int = 10) -> DataFrame:
    """hash, page_id, page_number, xref, width, height, x0..y1 of small pictures: each content once, where it stands first.

    images: page_number, xref, width, height (pixels), content, and the box it is placed in, or nulls. A picture counts if its longer side has
    ``most`` pixels at most and its shorter one ``least`` at least; one without content is left out. The hash is 16 hex digits.
    """
    small = images.where((F.greatest("width", "height") <= most) & (F.least("width", "height") >= least) & (F.octet_length("content") > 0))
    rows = small.withColumn("hash", F.substring(F.sha2("content", 256), 1, 16)).drop("content")
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1") if c in images.columns]
    first = rows.groupBy("hash").agg(F.min_by(F.struct("page_number", "xref", "width", "height", *box), F.struct("page_number", "xref")).alias("f"))
    return first.select("hash", ids.page_id(F.col("f.page_number")).alias("page_id"), "f.*")
