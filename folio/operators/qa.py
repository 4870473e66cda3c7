"""Quality rules: each takes blocks and yields findings.

Blocks: document_id?, page_id, block_id, pos, kind, text. Findings: layer, severity, code, page_id,
entity_ref, detail. Rules are narrow maps except those that compare neighbours, which shuffle by page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T

SEVERITIES = ("info", "warning", "error", "critical")
BLOCKING = ("error", "critical")
FINDING = ("layer", "severity", "code", "page_id", "entity_ref", "detail")


def _finding(df: DataFrame, layer: str, severity: str, code: str, detail: Column) -> DataFrame:
    return df.select(F.lit(layer).alias("layer"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), "page_id", F.col("block_id").alias("entity_ref"), detail.cast("string").alias("detail"))


#: A rule on one block: the code of its finding, and a column with the finding's detail, null where the block is good.
RowRule = Callable[[DataFrame], Column]
_GRADES = {
    "PARAGRAPH_TOO_LONG": ("structure", "warning"),
    "UNTRANSLATED_TEXT": ("terminology", "error"),
    "DEAD_PAGE_REF": ("render", "warning"),
    "LEAKED_TECHNICAL_ID": ("render", "error"),
    "DECORATIVE_ICON_LEAKED": ("render", "warning"),
    "GLUED_TEXT": ("extraction", "warning"),
}


def _paragraph_length(blocks: DataFrame, most: int = 1000) -> Column:
    return F.when((F.col("kind") == "paragraph") & (F.length("text") > most), F.length("text"))


def _untranslated(blocks: DataFrame, least_chars: int = 20, tenths: int = 5) -> Column:
    latin = T.count_matches(F.col("text"), "[a-zA-Z]")
    open_to = ~F.col("kind").isin("divider", "unknown")
    if "translatable" in blocks.columns:
        open_to &= F.coalesce("translatable", F.lit(True))
    return F.when(open_to & (F.length("text") >= least_chars) & (10 * latin > tenths * F.length("text")), latin)


def _leaked_identifiers(blocks: DataFrame) -> Column:
    return F.when(F.col("kind") != "divider", T.leaked_identifier(F.col("text")))


def row_findings(blocks: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Findings of rules on single blocks, in one pass: each text is read once, whatever the number of rules."""
    one = lambda code, detail: F.when(detail.isNotNull(), F.struct(*[F.lit(x).alias(n) for x, n in zip((*_GRADES[code], code), ("layer", "severity", "code"), strict=True)], detail.cast("string").alias("detail")))
    rows = blocks.select("page_id", F.col("block_id").alias("entity_ref"), F.explode(F.array_compact(F.array(*[one(c, d) for c, d in rules.items()]))).alias("f"))
    return rows.select("f.layer", "f.severity", "f.code", "page_id", "entity_ref", "f.detail")


def paragraph_length(blocks: DataFrame, most: int = 1000) -> DataFrame:
    """Paragraphs with more than ``most`` characters."""
    return row_findings(blocks, {"PARAGRAPH_TOO_LONG": _paragraph_length(blocks, most)})


def untranslated(blocks: DataFrame, least_chars: int = 20, tenths: int = 5) -> DataFrame:
    """Blocks of 20 characters at least that are Latin letters for more than tenths/10; dividers, unknown blocks and those not to be translated (column translatable, if there is one) are left out."""
    return row_findings(blocks, {"UNTRANSLATED_TEXT": _untranslated(blocks, least_chars, tenths)})


def dead_page_refs(blocks: DataFrame) -> DataFrame:
    return row_findings(blocks, {"DEAD_PAGE_REF": T.page_reference(F.col("text"))})


def leaked_identifiers(blocks: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Blocks, but for dividers, and titles of pages (page_id, title) that hold a technical identifier."""
    found = row_findings(blocks, {"LEAKED_TECHNICAL_ID": _leaked_identifiers(blocks)})
    if titles is None:
        return found
    heads = titles.select("page_id", F.lit("page.title").alias("block_id"), F.col("title").alias("text"))
    return row_findings(heads, {"LEAKED_TECHNICAL_ID": T.leaked_identifier(F.col("text"))}).unionByName(found)


def decorative_icons(blocks: DataFrame) -> DataFrame:
    return row_findings(blocks, {"DECORATIVE_ICON_LEAKED": T.first_reason(F.col("text"), T.DECORATIVE)})


def glued_text(blocks: DataFrame, rules: tuple[tuple[str, str], ...] = T.GLUED) -> DataFrame:
    return row_findings(blocks, {"GLUED_TEXT": T.first_reason(F.col("text"), rules)})


def duplicate_content(blocks: DataFrame, tenths: int = 9) -> DataFrame:
    """Blocks whose word set is more than tenths/10 alike that of the block before on the page; dividers are skipped, empty texts never match.

    The shuffle carries the texts; word sets are made after it.
    """
    w = Window.partitionBy("page_id").orderBy("pos")
    rows = blocks.where(F.col("kind") != "divider")
    rows = rows.select("page_id", "block_id", "text", F.lag("text").over(w).alias("text_before"), F.lag("block_id").over(w).alias("block_before"))
    hit = rows.where((F.col("text_before") != "") & (F.col("text") != "") & T.jaccard_over(T.word_set(F.col("text_before")), T.word_set(F.col("text")), tenths))
    return _finding(hit, "structure", "warning", "DUPLICATE_CONTENT", F.col("block_before"))


def icon_count(source: DataFrame, target: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    """Pages whose number of icons (page_id, icon columns) differs between source and target, or target and render."""
    count = lambda df, name: df.groupBy("page_id").agg(F.count("icon").alias(name))
    rows = count(source, "src").join(count(target, "tgt"), "page_id", "full")
    rows = rows.join(count(rendered, "out"), "page_id", "full") if rendered is not None else rows.withColumn("out", F.col("tgt"))
    rows = rows.na.fill(0, ["src", "tgt", "out"]).withColumn("block_id", F.col("page_id"))
    show = lambda a, b: F.concat_ws(":", a, b)
    first = _finding(rows.where("src <> tgt"), "icon_symbol", "error", "ICON_COUNT_SRC_TGT_MISMATCH", show("src", "tgt"))
    second = _finding(rows.where("tgt <> out"), "icon_symbol", "error", "ICON_COUNT_TGT_RENDER_MISMATCH", show("tgt", "out"))
    return first.unionByName(second)


#: Rules on one table of blocks, in order.
RULES: tuple[Callable[[DataFrame], DataFrame], ...] = (paragraph_length, untranslated, dead_page_refs, leaked_identifiers, decorative_icons, glued_text, duplicate_content)


#: The rules on single blocks, as columns.
_ROW_RULES: dict[Callable[[DataFrame], DataFrame], tuple[str, RowRule]] = {
    paragraph_length: ("PARAGRAPH_TOO_LONG", _paragraph_length),
    untranslated: ("UNTRANSLATED_TEXT", _untranslated),
    dead_page_refs: ("DEAD_PAGE_REF", lambda _: T.page_reference(F.col("text"))),
    leaked_identifiers: ("LEAKED_TECHNICAL_ID", _leaked_identifiers),
    decorative_icons: ("DECORATIVE_ICON_LEAKED", lambda _: T.first_reason(F.col("text"), T.DECORATIVE)),
    glued_text: ("GLUED_TEXT", lambda _: T.first_reason(F.col("text"), T.GLUED)),
}


def run_rules(blocks: DataFrame, rules: tuple[Callable[[DataFrame], DataFrame], ...] = RULES) -> DataFrame:
    """All findings. Rules on single blocks are one pass over the texts; each rule on neighbours is a branch of its own."""
    single = dict(_ROW_RULES[r] for r in rules if r in _ROW_RULES)
    parts = [row_findings(blocks, {code: rule(blocks) for code, rule in single.items()})] if single else []
    parts += [r(blocks) for r in rules if r not in _ROW_RULES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def apply_waivers(findings: DataFrame, waivers: DataFrame) -> DataFrame:
    """findings with waived and waiver_id.

    waivers: ordinal, waiver_id, code, page_id (null: any page). The first that fits by ordinal wins.
    It is found as the smaller of two equi-joins' ordinals, each against the first waiver of its key,
    so a finding meets at most two rows and nothing multiplies.
    """
    first = lambda keys: waivers.groupBy(*keys).agg(F.min_by(F.struct("ordinal", "waiver_id"), "ordinal").alias("w"))
    exact = first(["code", "page_id"]).where(F.col("page_id").isNotNull()).withColumnRenamed("w", "by_page")
    wide = waivers.where(F.col("page_id").isNull()).groupBy("code").agg(F.min_by(F.struct("ordinal", "waiver_id"), "ordinal").alias("by_code"))
    rows = findings.join(exact, ["code", "page_id"], "left").join(wide, "code", "left")
    best = F.least(F.col("by_page"), F.col("by_code"))  # structs order by ordinal; nulls are skipped
    return rows.withColumn("waiver_id", best["waiver_id"]).withColumn("waived", F.col("waiver_id").isNotNull()).drop("by_page", "by_code")


def tally_by_severity(findings: DataFrame) -> DataFrame:
    """One row: the number of findings of each severity."""
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def tally_by_code(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code", "severity").agg(F.count("*").alias("n"))


def review_pack(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of findings with waivers applied (total, waived, blocking), and the blocking rows."""
    blocking = F.col("severity").isin(*BLOCKING) & ~F.col("waived")
    counts = findings.agg(F.count("*").alias("total"), F.count_if("waived").alias("waived"), F.count_if(blocking).alias("blocking"))
    return counts, findings.where(blocking)


def gate(findings: DataFrame) -> DataFrame:
    """One row: whether any finding blocks."""
    return findings.agg(F.coalesce(F.bool_or(F.col("severity").isin(*BLOCKING) & ~F.col("waived")), F.lit(False)).alias("blocked"))


def waiver_templates(findings: DataFrame) -> DataFrame:
    """A waiver for each blocking finding, to be filled in."""
    hit = findings.where(F.col("severity").isin(*BLOCKING))
    return hit.select(F.concat(F.lit("waiver."), F.lower("code"), F.lit("."), "entity_ref").alias("waiver_id"), "code", "page_id", F.lit("").alias("reason"), F.lit("").alias("approved_by"))
