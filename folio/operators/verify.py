"""Cross-stage references and invariants of resolved pages.

Each check is an anti join on keys that start with the page, or takes whole pages, whose rows are exchanged packed (folio.operators.runs).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from folio.operators import runs


def missing_references(references: DataFrame, targets: DataFrame, keys: list[str], code: str, severity: str = "error") -> DataFrame:
    """code, severity, page_id, entity_ref, target: references whose target doesn't exist.

    references: page_id, entity_ref and the keys; targets: the keys, repeated ones too. Repeated references are reported once.
    """
    named = dict.fromkeys(["page_id", "entity_ref", *keys])
    lost = references.select(*named).join(targets.select(*keys), keys, "left_anti").distinct()
    return lost.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "page_id", "entity_ref", F.col(keys[-1]).cast("string").alias("target"))


def native_words(word_refs: DataFrame, words: DataFrame) -> DataFrame:
    """Word ids that blocks refer to and the page lacks."""
    return missing_references(word_refs, words, ["page_id", "word_id"], "XREF_NATIVE_WORD")


def evidence(evidence_refs: DataFrame, entities: DataFrame, code: str = "XREF_EVIDENCE_TO_IR") -> DataFrame:
    return missing_references(evidence_refs, entities, ["page_id", "evidence_id"], code)


def symbols(matched: DataFrame, placed: DataFrame) -> DataFrame:
    """Symbols placed that no match has (error), and matched but not placed (warning); both have page_id, symbol_id. A null id is never the same as another.

    A page's symbols are exchanged as one array a side, each once, and compared there.
    """
    kind = matched.schema["symbol_id"].dataType
    none = F.array().cast(ArrayType(kind))
    own = lambda df, name: runs.packed(df.select("page_id", F.col("symbol_id").alias(name)), ["page_id"]).withColumn(name, F.array_distinct(name))
    both = own(matched, "m").withColumn("p", none).unionByName(own(placed, "p").withColumn("m", none))
    pages = runs.merged(both.select("page_id", "m", "p"), ["page_id"])
    unknown = F.col("page_id").isNull()
    # array_except takes null for equal to null, so nulls are kept apart.
    only = lambda a, b: F.when(unknown, F.array_distinct(a)).otherwise(F.array_except(a, F.array_compact(b)))
    finding = lambda code, severity, ids: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), ids.alias("ids"))
    found = pages.select("page_id", F.inline(F.array(finding("XREF_SYMBOL_TO_IR", "error", only("p", "m")), finding("XREF_SYMBOL_DROPPED", "warning", only("m", "p")))))
    found = found.select("code", "severity", "page_id", F.explode("ids").alias("entity_ref"))
    return found.withColumn("target", F.col("entity_ref").cast("string"))


def blocks_rendered(blocks: DataFrame, rendered: DataFrame) -> DataFrame:
    return missing_references(blocks.withColumn("entity_ref", F.col("block_id")), rendered, ["page_id", "block_id"], "XREF_IR_TO_RENDER")


def figure_assets(blocks: DataFrame, rendered: DataFrame) -> DataFrame:
    """Figures whose asset differs between a page and its render (page_id, block_id, asset_id)."""
    both = blocks.join(rendered.withColumnRenamed("asset_id", "target"), ["page_id", "block_id"]).where(~F.col("asset_id").eqNullSafe(F.col("target")))
    return both.select(F.lit("XREF_IR_FIGURE_REMAP").alias("code"), F.lit("error").alias("severity"), "page_id", F.col("block_id").alias("entity_ref"), "target")


def dangling_regions(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    refs = blocks.where(F.col("region_id").isNotNull() & (F.col("region_id") != "")).select("page_id", F.col("block_id").alias("entity_ref"), "region_id")
    return missing_references(refs, regions, ["page_id", "region_id"], "DANGLING_REGION_REF")


def dangling_flow(flow: DataFrame, blocks: DataFrame) -> DataFrame:
    """Entries of a page's main flow that are no block of it (flow: page_id, entry). Region ids are flagged too, as the rule is written."""
    refs = flow.select("page_id", F.col("entry").alias("entity_ref"), F.col("entry").alias("block_id"))
    return missing_references(refs, blocks, ["page_id", "block_id"], "DANGLING_FLOW_REF")


def dangling_anchors(edges: DataFrame, blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Ends of anchor edges that are neither block nor region. Evidence ids are flagged, as the rule is written."""
    ends = edges.select("page_id", F.col("source_id").alias("entity_ref"), F.explode(F.array("source_id", "target_id")).alias("node"))
    nodes = blocks.select("page_id", F.col("block_id").alias("node")).unionByName(regions.select("page_id", F.col("region_id").alias("node")))
    return missing_references(ends, nodes, ["page_id", "node"], "DANGLING_ANCHOR_REF")


def orphan_captions(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    refs = blocks.where("kind = 'caption'").select("page_id", F.col("block_id").alias("entity_ref"), "block_id")
    linked = edges.where("edge_kind = 'caption'").select("page_id", F.col("source_id").alias("block_id"))
    return missing_references(refs, linked, ["page_id", "block_id"], "ORPHAN_CAPTION", "warning")


def boxes_out_of_page(boxes: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Boxes (page_id, entity_ref, x0.., width, height) that leave their page by more than the tolerance."""
    out = boxes.where((F.col("x0") < -tolerance) | (F.col("y0") < -tolerance) | (F.col("x1") > F.col("width") + tolerance) | (F.col("y1") > F.col("height") + tolerance))
    return out.select(F.lit("BBOX_OUT_OF_PAGE").alias("code"), F.lit("error").alias("severity"), "page_id", "entity_ref", F.lit(None).cast("string").alias("target"))


def duplicate_instances(placements: DataFrame) -> DataFrame:
    """Second and later occurrences of a symbol instance on a page, in order of pos."""
    rows = placements.where(F.col("instance_id").isNotNull() & (F.col("instance_id") != "")).select("page_id", "instance_id", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            instance, page = runs.flat(batch, "instance_id", np.arange(batch.num_rows))
            code = instance.dictionary_encode().indices.to_numpy()
            order = np.lexsort([runs.ranks(batch.column("pos").flatten()), code, page])
            new = np.append(True, (np.diff(page[order]) != 0) | (np.diff(code[order]) != 0))[: len(order)]
            nth = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1] + 1 if len(order) else order
            again = np.flatnonzero(nth > 1)
            yield pa.RecordBatch.from_arrays([batch.column("page_id").take(pa.array(page[order[again]])), instance.take(pa.array(order[again])), pa.array(nth[again].astype(np.int64))], ["page_id", "instance_id", "nth"])

    again = runs.gathered(rows, ["page_id"]).mapInArrow(run, StructType([rows.schema["page_id"], rows.schema["instance_id"], StructField("nth", LongType())]))
    return again.select(F.lit("DUPLICATE_SYMBOL_INSTANCE").alias("code"), F.lit("error").alias("severity"), "page_id", F.col("instance_id").alias("entity_ref"), F.col("nth").cast("string").alias("target"))


def missing_fallback(blocks: DataFrame) -> DataFrame:
    hit = blocks.where(F.col("fallback").isNotNull() & (F.coalesce(F.col("fallback.strategy"), F.lit("")) == ""))
    return hit.select(F.lit("MISSING_FALLBACK_PROVENANCE").alias("code"), F.lit("warning").alias("severity"), "page_id", F.col("block_id").alias("entity_ref"), F.lit(None).cast("string").alias("target"))


def anchor_cycles(edges: DataFrame, kinds: tuple[str, ...] = ("caption", "aside")) -> DataFrame:
    """page_id of pages whose edges of these kinds (page_id, edge_kind, source_id, target_id) hold a cycle.

    Nodes that no edge points to are taken off, with their edges, until none is left; a page with nodes left has a cycle.
    Each edge is looked at once. A page is a group, as in all rules of this module.
    """
    rows = edges.where(F.col("edge_kind").isin(*kinds)).select("page_id", "source_id", "target_id")

    def cyclic(rows: list[dict]) -> list[dict]:
        own = {(r["source_id"], r["target_id"]) for r in rows}
        after = defaultdict(list)
        pointed = Counter(t for _, t in own)
        for s, t in own:
            after[s].append(t)
        free = [s for s in after if not pointed[s]]
        gone = 0
        while free:
            for t in after[free.pop()]:
                gone += 1
                pointed[t] -= 1
                if not pointed[t] and t in after:
                    free.append(t)
        return [{"page_id": rows[0]["page_id"]}] if gone < len(own) else []

    return runs.folded(rows, ["page_id"], cyclic, StructType([edges.schema["page_id"]]))


def render_assets(referenced: DataFrame, figures: DataFrame) -> DataFrame:
    """Assets (page_id, asset_id) that a page's figures or inlines show and its table of figures lacks."""
    refs = referenced.where(F.coalesce("asset_id", F.lit("")) != "").withColumn("entity_ref", F.col("asset_id"))
    return missing_references(refs, figures, ["page_id", "asset_id"], "XREF_RENDER_ASSET")


def published(pages: DataFrame, figures: DataFrame, files: DataFrame) -> DataFrame:
    """Pages (page_id) without a published file pages/{page_id}.json, and figures (page_id, asset_id, src) whose source isn't among the files (path)."""
    wanted = pages.select("page_id", F.col("page_id").alias("entity_ref"), F.concat(F.lit("pages/"), "page_id", F.lit(".json")).alias("path"))
    shown = figures.where(F.coalesce("src", F.lit("")) != "").select("page_id", F.col("asset_id").alias("entity_ref"), F.col("src").alias("path"))
    return missing_references(wanted.unionByName(shown), files, ["path"], "XREF_RENDER_TO_PUBLISH")


def _both(checks: DataFrame, *tables: DataFrame) -> DataFrame:
    """Findings of the pages that all of the tables have: a boundary is looked at only where both sides are there."""
    for table in tables:
        checks = checks.join(table.select("page_id").distinct(), "page_id", "left_semi")
    return checks


def cross_stage(tables: dict[str, DataFrame]) -> DataFrame:
    """All findings between stages, of whatever tables there are; a boundary needs both of its sides, table by table and page by page.

    words (page_id, word_id), evidence (page_id, evidence_id), matched (page_id, symbol_id); blocks (page_id, block_id, kind, asset_id, translatable)
    with word_refs (page_id, entity_ref, word_id), evidence_refs (page_id, entity_ref, evidence_id) and placed (page_id, symbol_id) of the page;
    rendered (page_id, block_id, kind, asset_id), referenced (page_id, asset_id), figures (page_id, asset_id, src); files (path).
    """
    t = tables
    columns = ("code", "severity", "page_id", "entity_ref", "target")
    found = []
    if {"words", "word_refs"} <= set(t):
        found.append(_both(native_words(t["word_refs"], t["words"]), t["words"]))
    if {"evidence", "evidence_refs"} <= set(t):
        found.append(_both(evidence(t["evidence_refs"], t["evidence"]), t["evidence"]))
    if {"matched", "placed"} <= set(t):
        found.append(symbols(t["matched"], t["placed"]))
    if {"blocks", "rendered"} <= set(t):
        wanted = t["blocks"].where(F.coalesce("translatable", F.lit(True)))
        found.append(_both(blocks_rendered(wanted, t["rendered"]).withColumn("severity", F.lit("warning")), t["rendered"]))
        figures = lambda df: df.where((F.col("kind") == "figure") & (F.coalesce("asset_id", F.lit("")) != "")).select("page_id", "block_id", "asset_id")
        found.append(figure_assets(figures(t["blocks"]), figures(t["rendered"])))
    if {"referenced", "figures"} <= set(t):
        found.append(render_assets(t["referenced"], t["figures"]))
    if {"rendered", "figures", "files"} <= set(t):
        found.append(published(t["rendered"].select("page_id").distinct(), t["figures"], t["files"]))
    if not found:
        raise ValueError("no boundary has both of its sides")
    out = found[0].select(*columns)
    for part in found[1:]:
        out = out.unionByName(part.select(*columns))
    return out


def invariants(blocks: DataFrame, regions: DataFrame, edges: DataFrame, flow: DataFrame, placements: DataFrame, evidence_refs: DataFrame | None = None, entities: DataFrame | None = None, boxes: DataFrame | None = None) -> DataFrame:
    """All findings within resolved pages; those about evidence where it is given.

    blocks: page_id, block_id, kind, region_id, fallback; see the single checks for the others.
    """
    cycles = anchor_cycles(edges).select(F.lit("ANCHOR_CYCLE").alias("code"), F.lit("error").alias("severity"), "page_id", F.col("page_id").alias("entity_ref"), F.lit(None).cast("string").alias("target"))
    parts = [dangling_regions(blocks, regions), dangling_flow(flow, blocks), dangling_anchors(edges, blocks, regions), duplicate_instances(placements), orphan_captions(blocks, edges), cycles, missing_fallback(blocks)]
    if evidence_refs is not None and entities is not None:
        parts.append(evidence(evidence_refs, entities, "DANGLING_EVIDENCE_REF"))
    if boxes is not None:
        parts.append(boxes_out_of_page(boxes))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def page_report(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """page_id, n_findings, n_blocking, passed of all pages, those without findings too."""
    blocking = F.col("severity").isin("error", "critical")
    counts = findings.groupBy("page_id").agg(F.count("*").alias("n_findings"), F.count_if(blocking).alias("n_blocking"))
    rows = pages.select("page_id").distinct().join(counts, "page_id", "left").na.fill(0, ["n_findings", "n_blocking"])
    return rows.withColumn("passed", F.col("n_blocking") == 0)


def report_totals(findings: DataFrame) -> DataFrame:
    """One row: findings by severity, dropped symbols, and whether nothing blocks."""
    count = lambda s: F.count_if(F.col("severity") == s).alias(s)
    totals = findings.agg(*map(count, ("info", "warning", "error", "critical")), F.count_if(F.col("code") == "XREF_SYMBOL_DROPPED").alias("symbol_drops"))
    return totals.withColumn("passed", (F.col("error") == 0) & (F.col("critical") == 0))
