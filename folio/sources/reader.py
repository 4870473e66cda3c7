"""Reader-side queries over published pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import geometry as G


def flat_text(inlines) -> object:
    """A block's text from its inlines: text, or [symbol] for icons."""
    return F.array_join(F.transform(inlines, lambda i: F.when(i["type"] == "text", i["text"]).when(i["type"] == "icon", F.concat(F.lit("["), i["symbol_id"], F.lit("]"))).otherwise(F.lit(""))), "")


def reader_order(annotations: DataFrame, row: float = 0.02) -> DataFrame:
    """annotations with nth: rows of 0.02 of the page's height, each from left to right. Rows are equal slices, so the order is strict."""
    w = Window.partitionBy("page_id").orderBy(F.floor(G.centre_y() / row), "x0", "annotation_id")
    return annotations.withColumn("nth", F.row_number().over(w))


def icons_to_concepts(concepts: DataFrame) -> DataFrame:
    """icon_binding with the last concept (by concept_id) bound to it."""
    return concepts.where(F.col("icon_binding").isNotNull()).groupBy("icon_binding").agg(F.max("concept_id").alias("concept_id"))


def visible_icons(icons: DataFrame, hidden: DataFrame) -> DataFrame:
    return icons.join(hidden.select("symbol_id"), "symbol_id", "left_anti")


def editions(index: DataFrame) -> DataFrame:
    """document_id, edition from document_id and an array of editions."""
    return index.select("document_id", F.explode("editions").alias("edition"))


def with_fallback(wanted: DataFrame, edition_files: DataFrame, root_files: DataFrame) -> DataFrame:
    """wanted (document_id, edition, page_id) with path: the edition's file, else the document's root file."""
    own = edition_files.select("document_id", "edition", "page_id", F.col("path").alias("own"))
    root = root_files.select("document_id", "page_id", F.col("path").alias("root"))
    return wanted.join(own, ["document_id", "edition", "page_id"], "left").join(root, ["document_id", "page_id"], "left").withColumn("path", F.coalesce("own", "root")).drop("own", "root")
