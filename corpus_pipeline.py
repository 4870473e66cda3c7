"""A training corpus from raw documents, in stages that each apply one operator of ``folio.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import dac, langid, packing, quality, secrets, simhash
from folio.llm.queries import RANKS, TOKENIZER
from folio.llm.textarrays import small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text whose language is less certain than this is rejected.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those of no certain language; a null lang is filled in.

    A null or empty text has no letter. Repeated rows, and rows with one doc_id or none, are judged each; no rows give no rows.
    """
    small_batches(spark)
    net = langid.fit(docs, F.lit(True))
    found = langid.predict(docs.select(*COLUMNS), net)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by the base rules or the decision list, learned from the labels of what is left.

    Without labels of both kinds the base rules decide alone. Null and empty texts fail them; repeated rows are judged each.
    """
    small_batches(spark)
    rules = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs.select(*COLUMNS), rules).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more) stays, the one with the smallest doc_id, a null one last, and row hash."""
    small_batches(spark)
    keyed = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("row_key"))
    found = simhash.similar_texts(keyed, width=5, least=(4, 5))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key"))
    firsts = found.groupBy("component").agg(first.alias("first")).select("first.row_key")
    return keyed.join(firsts, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, repeated rows and null or empty texts too; secrets in their texts give way to a mark."""
    small_batches(spark)
    return secrets.redact(docs.select(*COLUMNS), RANKS).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, one row a piece; a null or empty text is its end token alone."""
    small_batches(spark)
    return packing.pack_documents(docs, TOKENIZER, end_id=0)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: The learned stages can't be expressed in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    folder = f"{dac.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
