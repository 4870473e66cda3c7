"""Translation planning, adapters, and validation of results."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


class Translator(Protocol):
    """Translates texts, keeping their order."""

    name: str

    def translate(self, texts: list[str]) -> list[str]: ...


class MockTranslator:
    """Fixed replacements of words, for tests and dry runs."""

    name = "mock"

    def __init__(self, words: dict[str, str]):
        self.words = words

    def translate(self, texts: list[str]) -> list[str]:
        return [" ".join(self.words.get(w, w) for w in t.split(" ")) for t in texts]


class FallbackTranslator:
    """The first translator with retries, then the next; the name tells which one answered."""

    def __init__(self, translators: list[Translator], retries: int = 2, delay_s: float = 1.0, sleep: Callable[[float], None] = time.sleep):
        self.translators, self.retries, self.delay_s, self.sleep = translators, retries, delay_s, sleep
        self.name = "fallback"

    def translate(self, texts: list[str]) -> list[str]:
        error: Exception | None = None
        for translator in self.translators:
            for attempt in range(self.retries + 1):
                try:
                    out = translator.translate(texts)
                    self.name = translator.name
                    return out
                except Exception as e:  # noqa: BLE001  any failure of a provider
                    error = e
                    if attempt < self.retries:
                        self.sleep(self.delay_s)
        raise RuntimeError("no translator answered") from error


def plan_segments(blocks: DataFrame, concepts: DataFrame) -> DataFrame:
    """page_id, segment_id, pos, text, section, concept_ids: what is to be translated, with the heading it stands under and the concepts it mentions.

    A mention is the lemma anywhere in the text, ignoring case. Lemmas of up to MOST_CHARS characters in all are looked for by one
    automaton in one pass over the text. More of them are met by their first three characters (those of one or two by all of them)
    through a join, since both tables grow.
    """
    from folio.operators.search import section_of
    from folio.operators.terms import MOST_CHARS

    known = concepts.select("concept_id", F.lower("lemma").alias("lemma")).where("lemma <> '' AND concept_id IS NOT NULL").distinct()
    size = known.agg(F.sum(F.length("lemma") + F.length("concept_id"))).first()[0] or 0
    rows = section_of(blocks.where((F.trim("text") != "") & F.col("kind").isin("heading", "paragraph", "list_item", "callout", "caption", "table")), ["pos"])
    if size <= MOST_CHARS:
        return _mentioned(rows, tuple(sorted((r["lemma"], r["concept_id"]) for r in known.collect())))
    grams = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    low = F.lower("text")
    met = rows.select("page_id", "block_id", F.explode(F.array_distinct(F.concat(*[grams(low, n) for n in (1, 2, 3)]))).alias("gram"))  # keys and grams only, no texts
    lemmas = concepts.select("concept_id", F.lower("lemma").alias("lemma")).withColumn("gram", F.substring("lemma", 1, 3))
    likely = met.join(lemmas, "gram").groupBy("page_id", "block_id").agg(F.collect_set(F.struct("concept_id", "lemma")).alias("likely"))
    out = rows.join(likely, ["page_id", "block_id"], "left")
    named = F.transform(F.filter("likely", lambda c: F.contains(low, c["lemma"])), lambda c: c["concept_id"])
    out = out.withColumn("concept_ids", F.sort_array(F.array_distinct(named)))
    return out.select("page_id", F.col("block_id").alias("segment_id"), "pos", "text", "section", F.coalesce("concept_ids", F.array().cast("array<string>")).alias("concept_ids"))


def _mentioned(rows: DataFrame, lemmas: tuple[tuple[str, str], ...]) -> DataFrame:
    """What plan_segments gives, by one automaton over all lemmas (lemma, concept_id)."""
    from folio.operators.terms import _kept as kept

    names = ["page_id", "segment_id", "pos", "text", "section"]
    rows = rows.select("page_id", F.col("block_id").alias("segment_id"), "pos", "text", "section", F.lower("text").alias("low"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = kept(lemmas) if lemmas else None
        for batch in batches:
            own = []
            for text in batch.column("low").to_pylist():
                hits = {form: concepts for _, (form, concepts) in found.iter(text)} if found is not None else {}
                own.append(sorted({c for concepts in hits.values() for c in concepts}))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(own, pa.list_(pa.string()))], [*names, "concept_ids"])

    out = StructType([*(rows.schema[c] for c in names), StructField("concept_ids", ArrayType(StringType()))])
    return rows.mapInArrow(scan, out).withColumn("concept_ids", F.sort_array("concept_ids"))


def translate(segments: DataFrame, make: Callable[[], Translator], batch: int = 50) -> DataFrame:
    """segment_id, target, provider, error. Each task makes its own client; a failed batch yields rows with the error and no target."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                try:
                    yield pd.DataFrame({"segment_id": part["segment_id"], "target": client.translate(part["text"].tolist()), "provider": client.name, "error": None})
                except Exception as e:  # noqa: BLE001  reported by row
                    yield pd.DataFrame({"segment_id": part["segment_id"], "target": None, "provider": client.name, "error": str(e)})

    return segments.select("segment_id", "text").mapInPandas(run, "segment_id string, target string, provider string, error string")


def validate(segments: DataFrame, results: DataFrame, concepts: DataFrame) -> DataFrame:
    """segment_id, problem, detail: missing and extra segments, duplicates, empty targets, forbidden forms (as written), and concepts without an allowed form (ignoring case)."""
    problem = lambda df, name, detail: df.select("segment_id", F.lit(name).alias("problem"), detail.cast("string").alias("detail"))
    none = F.lit(None)
    missing = problem(segments.join(results, "segment_id", "left_anti"), "missing", none)
    extra = problem(results.join(segments, "segment_id", "left_anti"), "extra", none)
    twice = problem(results.groupBy("segment_id").count().where("count > 1"), "duplicate", F.col("count"))
    empty = problem(results.where(F.coalesce(F.trim("target"), F.lit("")) == ""), "empty", none)
    wanted = segments.select("segment_id", F.explode("concept_ids").alias("concept_id")).join(concepts, "concept_id").join(results.select("segment_id", "target"), "segment_id").where(F.trim("target") != "")
    forbidden = wanted.withColumn("bad", F.explode(F.coalesce("forbidden", F.array().cast("array<string>")))).where(F.contains("target", "bad"))
    allowed = F.transform(F.concat(F.array("target_lemma"), F.coalesce("allowed", F.array().cast("array<string>"))), F.lower)
    absent = wanted.where(~F.exists(allowed, lambda a: F.contains(F.lower("target"), a)))
    return missing.unionByName(extra).unionByName(twice).unionByName(empty).unionByName(problem(forbidden, "forbidden_form", F.col("bad"))).unionByName(problem(absent, "concept_not_realized", F.col("concept_id")))


def system_prompt(concepts: DataFrame, head: str) -> DataFrame:
    """One row: the head and a line for each concept, in order of id."""
    line = F.concat_ws(" = ", "lemma", "target_lemma")
    rows = F.sort_array(F.collect_list(F.struct("concept_id", line.alias("line"))))
    return concepts.agg(F.concat_ws("\n", F.lit(head), F.transform(rows, lambda r: r["line"])).alias("prompt"))


def batches(segments: DataFrame, size: int = 50) -> DataFrame:
    """segments with batch: by page, runs of ``size`` in order."""
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return segments.withColumn("batch", F.floor((nth - 1) / size).cast("int"))


def translated_blocks(blocks: DataFrame, results: DataFrame) -> DataFrame:
    """blocks with the text of their translation and translated; a block without one keeps its text."""
    found = results.where(F.col("target").isNotNull()).select(F.col("segment_id").alias("block_id"), "target")
    rows = blocks.join(found, "block_id", "left").withColumn("translated", F.col("target").isNotNull())
    return rows.withColumn("text", F.coalesce("target", "text")).drop("target")


def inline_checksum(inlines: Column) -> Column:
    """12 hex digits of the inlines' canonical JSON; their fields must be named in alphabetical order."""
    from folio.functions.ids import short_hash

    return short_hash(F.to_json(inlines))


def user_messages(batched: DataFrame, source: str = "en", target: str = "ru") -> DataFrame:
    """page_id, batch, message: the JSON that a model gets for each batch (segments with page_id, batch, pos, segment_id, kind, text, section, concept_ids)."""
    context = F.when(F.coalesce("section", F.lit("")) != "", F.struct(F.col("section").alias("prev_heading")))
    concepts = F.when(F.size("concept_ids") > 0, F.col("concept_ids"))
    segment = F.struct("segment_id", F.col("kind").alias("block_type"), F.col("text").alias("source"), concepts.alias("required_concepts"), context.alias("context"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", segment.alias("s")))), lambda x: x["s"])
    out = batched.groupBy("page_id", "batch").agg(rows.alias("segments"))
    name = F.format_string("%s.%d", "page_id", "batch")
    return out.select("page_id", "batch", F.to_json(F.struct(name.alias("batch_id"), F.lit(source).alias("source_lang"), F.lit(target).alias("target_lang"), "segments")).alias("message"))


def few_shot_examples(batched: DataFrame, pairs: DataFrame, most: int = 2) -> DataFrame:
    """page_id, batch, nth, segment_id, user, assistant: translated pairs that show a model the concepts of a batch, as the messages of an exchange.

    batched: page_id, batch, concept_ids (one row a segment). pairs: segment_id, kind, text, target, concept_ids, one row a pair. Of each concept the
    pair with the shortest text is its example (then the smallest segment_id), so a concept of all batches costs one row a batch; a
    batch gets the examples of most of its concepts first, ``most`` in all.
    """
    shown = pairs.where((F.trim("text") != "") & (F.trim("target") != ""))
    best = shown.select(F.explode("concept_ids").alias("concept_id"), "segment_id", F.length("text").alias("size"))
    best = best.groupBy("concept_id").agg(F.min_by("segment_id", F.struct("size", "segment_id")).alias("segment_id"))
    asked = batched.select("page_id", "batch", F.explode("concept_ids").alias("concept_id")).distinct().join(best, "concept_id")
    rank = F.row_number().over(Window.partitionBy("page_id", "batch").orderBy(F.desc("n"), "segment_id"))
    chosen = asked.groupBy("page_id", "batch", "segment_id").agg(F.count("*").alias("n")).withColumn("nth", rank).where(F.col("nth") <= most)
    name = F.concat(F.lit("example_"), F.col("nth").cast("string")).alias("batch_id")
    concepts = F.when(F.size("concept_ids") > 0, F.col("concept_ids")).alias("required_concepts")
    user = F.to_json(F.struct(name, F.array(F.struct("segment_id", F.col("kind").alias("block_type"), F.col("text").alias("source"), concepts)).alias("segments")))
    assistant = F.to_json(F.struct(name, F.array(F.struct("segment_id", "target")).alias("segments")))
    return chosen.join(shown, "segment_id").select("page_id", "batch", "nth", "segment_id", user.alias("user"), assistant.alias("assistant"))


def response_schema(segments: DataFrame) -> DataFrame:
    """page_id, schema: the JSON schema of an answer that names each segment of a page once."""
    one = F.to_json(F.struct(F.array_sort(F.collect_list("segment_id")).alias("enum"), F.lit("string").alias("type")))
    text = F.concat(F.lit('{"type":"object","required":["segments"],"properties":{"segments":{"type":"array","items":{"type":"object","required":["segment_id","target"],"properties":{"segment_id":'), one, F.lit(',"target":{"type":"string"}}}}}}'))
    return segments.groupBy("page_id").agg(text.alias("schema"))


def pending(segments: DataFrame, memory: DataFrame) -> DataFrame:
    """Segments (segment_id, checksum) that the memory (segment_id, checksum, target) has no translation of with the same checksum: what a run has to translate."""
    return segments.join(memory.where(F.col("target").isNotNull()).select("segment_id", "checksum").distinct(), ["segment_id", "checksum"], "left_anti")


def without_additional_properties(schema: dict) -> dict:
    """A JSON schema without additionalProperties, at any depth of its properties and items; for services that don't take it."""
    out = {k: v for k, v in schema.items() if k != "additionalProperties"}
    if isinstance(out.get("properties"), dict):
        out["properties"] = {k: without_additional_properties(v) if isinstance(v, dict) else v for k, v in out["properties"].items()}
    if isinstance(out.get("items"), dict):
        out["items"] = without_additional_properties(out["items"])
    return out
