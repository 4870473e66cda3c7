"""The registered queries of this subpackage and their oracle SQL.

Each query applies its operator with production parameters to its whole table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import ann, bpe, collocations, dac, html_extract, langid, lm, packing, prefix_trie, quality, secrets, simhash, urlfilter
from folio.llm.textarrays import small_batches

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return html_extract.main_text(pages, html_extract.fit(pages))


def op2_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"), every=20, k=20)


def op3_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_read(spark, sf_dir, "documents"))


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op5_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), RANKS)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"), RANKS)


def op7_addressable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.round_trip(_read(spark, sf_dir, "documents"), TOKENIZER, end_id=2)


def op8_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), TOKENIZER, end_id=0)


def op9_conv_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = lm.fold(F.col("doc_id")) == 0
    net = langid.fit(docs, ~held_out)
    return langid.predict(docs.select("doc_id", "text"), net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rules = quality.fit(docs, _read(spark, sf_dir, "labels"))
    judged = quality.judge(docs.select("doc_id", "text"), rules)
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "rule")


def op11_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(_read(spark, sf_dir, "conversations"))


def op13_tiled_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (op1_main_text, op2_one_bit_neighbours, op3_interpolated_lm, op4_simhash_groups, op5_prefix_bpe, op6_secret_scan, op7_addressable_tokens, op8_squares_packing, op9_conv_langid, op10_decision_list, op11_link_trust, op12_prefix_trie, op13_tiled_phrases)
    return {f.__name__: f for f in found}


ORACLES = {
    "op2_one_bit_neighbours": """
        WITH v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), s AS (
            SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score
            FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op11_link_trust": urlfilter.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_tiled_phrases": collocations.ORACLE,
}
