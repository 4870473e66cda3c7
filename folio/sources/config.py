"""Configuration from TOML files, merged in layers on the driver."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def merge(base: dict, over: dict) -> dict:
    """base with the values of over; tables are merged, lists and values replaced."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def load_layers(*paths: Path) -> dict:
    """The files in order, later ones winning; the first must exist, others may be missing."""
    out: dict = {}
    for k, path in enumerate(paths):
        if k == 0 or path.exists():
            out = merge(out, tomllib.loads(path.read_text(encoding="utf-8")))
    return out


def concept_table(spark: SparkSession, config: dict) -> DataFrame:
    """concept_id, kind, lemma, aliases, target_lemma, allowed, forbidden from the concept list of a configuration (kind term by default)."""
    rows = [(c["concept_id"], c.get("kind", "term"), c["source"]["lemma"], c["source"].get("aliases", []), c["target"]["lemma"], c["target"].get("allowed_surface_forms", []), c.get("forbidden_targets", [])) for c in config.get("concepts", [])]
    return spark.createDataFrame(rows, "concept_id string, kind string, lemma string, aliases array<string>, target_lemma string, allowed array<string>, forbidden array<string>")


def threshold_table(spark: SparkSession, config: dict) -> DataFrame:
    """metric, least, blocking."""
    return spark.createDataFrame([(t["metric"], float(t["min_value"]), bool(t.get("blocking", True))) for t in config.get("thresholds", [])], "metric string, least double, blocking boolean")


def band_table(spark: SparkSession, config: dict) -> DataFrame:
    """name, low, high of confidence bands; they must follow one another without gaps."""
    bands = sorted(config.get("bands", []), key=lambda b: b["min_confidence"])
    for a, b in zip(bands, bands[1:], strict=False):
        if a["max_confidence"] != b["min_confidence"]:
            raise ValueError(f"bands {a['name']} and {b['name']} leave a gap or overlap")
    return spark.createDataFrame([(b["name"], float(b["min_confidence"]), float(b["max_confidence"])) for b in bands], "name string, low double, high double")


def golden_table(spark: SparkSession, config: dict) -> DataFrame:
    """document_id, page_id, expected, block_types, symbol_count, reading_order of a golden set."""
    rows = [(config.get("document_id", config["name"]), p["page_id"], p.get("block_count"), p.get("block_types", []), p.get("symbol_count"), p.get("reading_order", [])) for p in config.get("pages", [])]
    return spark.createDataFrame(rows, "document_id string, page_id string, expected long, block_types array<string>, symbol_count int, reading_order array<string>")


def ladder_table(spark: SparkSession, config: dict) -> DataFrame:
    """ladder, order, golden_set of a benchmark ladder's checkpoints."""
    rows = sorted((config["name"], int(c["order"]), c["golden_set"]) for c in config.get("checkpoints", []))
    return spark.createDataFrame(rows, "ladder string, order int, golden_set string")


def symbol_table(spark: SparkSession, config: dict) -> DataFrame:
    """symbol_id, label, template, threshold of a symbol catalog."""
    rows = [(s["symbol_id"], s.get("label", ""), s.get("template_asset", ""), float(s["match_threshold"]) if "match_threshold" in s else None) for s in config.get("symbols", [])]
    return spark.createDataFrame(rows, "symbol_id string, label string, template string, threshold double")


def waiver_table(spark: SparkSession, config: dict | list) -> DataFrame:
    """ordinal, waiver_id, code, page_id (null: any), reason, approved_by of a list of waivers, in its order."""
    items = config.get("waivers", []) if isinstance(config, dict) else config
    rows = [(k, w["waiver_id"], w["code"], w.get("page_id") or None, w.get("reason", ""), w.get("approved_by", "")) for k, w in enumerate(items)]
    return spark.createDataFrame(rows, "ordinal int, waiver_id string, code string, page_id string, reason string, approved_by string")


def fixture_table(spark: SparkSession, config: dict) -> DataFrame:
    """document_id, path, sha256 of a fixture manifest's files."""
    rows = [(f["document_id"], path, digest) for f in config.get("fixtures", []) for path, digest in sorted(f.get("checksums", {}).items())]
    return spark.createDataFrame(rows, "document_id string, path string, sha256 string")
