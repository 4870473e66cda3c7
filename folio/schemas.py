"""Table schemas and their validation as rows of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
INLINE = "struct<type:string,text:string,marks:array<string>,lang:string,source_word_ids:array<string>,symbol_id:string,instance_id:string,confidence:double,asset_id:string,label:string,concept_id:string,surface_form:string,target_page_id:string>"
BLOCK = f"struct<type:string,block_id:string,bbox:{RECT},level:int,asset_id:string,variant:string,figure_block_id:string,translatable:boolean,children:array<{INLINE}>>"

TABLES = {
    "page_ir": f"document_id string, page_id string, page_number int, language string, dimensions_pt struct<width:double,height:double>, blocks array<{BLOCK}>, assets array<string>, reading_order array<string>",
    "native_page": f"document_id string, page_id string, page_number int, dimensions_pt struct<width:double,height:double>, words array<struct<word_id:string,text:string,bbox:{RECT},font_name:string,font_size:double,flags:int>>, spans array<struct<span_id:string,text:string,bbox:{RECT},font_name:string,font_size:double,flags:int,color:int>>, image_blocks array<struct<image_id:string,bbox:{RECT},width_px:int,height_px:int,colorspace:string,xref:int>>",
    "page_evidence": f"page_id string, kind string, evidence_id string, text string, bbox {RECT}, norm_bbox {RECT}, font_name string, font_size double, member_ids array<string>, content_hash string, row_count int, col_count int, confidence double, region_kind string",
    "qa_record": "qa_id string, layer string, severity string, code string, document_id string, page_id string, entity_ref string, message string, waived boolean, waiver_ref string",
    "waiver": "ordinal int, waiver_id string, code string, page_id string, reason string, approved_by string",
    "stage_events": "event_id long, run_id string, stage_name string, scope string, entity_id string, cache_key string, status string, started_at string, finished_at string, artifact_ref string, error_message string, duration_ms int",
    "concepts": "concept_id string, kind string, lemma string, aliases array<string>, patterns array<string>, target_lemma string, allowed array<string>, icon_binding string, forbidden array<string>",
    "artifacts": "document_id string, family string, scope string, entity_id string, content_hash string, body string, written_at timestamp",
}

BLOCK_TYPES = ("heading", "paragraph", "list", "list_item", "table", "callout", "figure", "caption", "divider", "unknown")
PATTERNS = {"page_id": r"^p\d{4,}$", "block_id": r"^p\d{4,}\.b\d{3,}(\.\d+)*$", "region_id": r"^r\d{3,}$"}


def validate(df: DataFrame, key: str, required: tuple[str, ...] = (), patterns: dict[str, str] | None = None, allowed: dict[str, tuple[str, ...]] | None = None, between: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """key, column, problem: one row for each value that breaks a rule. One pass over the rows."""
    checks = [F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("column"), F.lit("required").alias("problem"))) for c in required]
    checks += [F.when(~F.col(c).rlike(p), F.struct(F.lit(c).alias("column"), F.lit("pattern").alias("problem"))) for c, p in (patterns or {}).items()]
    checks += [F.when(~F.col(c).isin(*v), F.struct(F.lit(c).alias("column"), F.lit("allowed").alias("problem"))) for c, v in (allowed or {}).items()]
    checks += [F.when(~F.col(c).between(*v), F.struct(F.lit(c).alias("column"), F.lit("range").alias("problem"))) for c, v in (between or {}).items()]
    found = df.select(F.col(key).alias("key"), F.explode(F.array_compact(F.array(*checks))).alias("v"))
    return found.select("key", "v.column", "v.problem")
