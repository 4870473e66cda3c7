"""Tables of which a third is one row."""

from collections import Counter

from pyspark.sql import functions as F

from folio.llm import dac, lm
from folio.llm.queries import TOKENIZER
from tests.llm.fixtures import documents


def rows():
    return [(i, f"some words {i % 7} here") for i in range(60)] + [(None, None)] * 30 + [(7, "the same row again and again")] * 25


def test_equal_rows_are_told_apart(spark):
    docs = documents(spark, rows())
    found = lm.told_apart(docs, many=10).collect()
    assert Counter((r["doc_id"], r["text"]) for r in found) == Counter(rows())
    hot = [(r["doc_id"], r["nth"]) for r in found if r["text"] is None or r["text"].startswith("the same")]
    assert sorted(hot, key=str) == sorted([*((None, k) for k in range(30)), *((7, k) for k in range(25))], key=str)
    assert {r["nth"] for r in lm.told_apart(docs, many=1000).collect()} == {0}


def test_scores_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    docs = documents(spark, rows())
    key = lambda df: sorted((str(r["doc_id"]), r["n_tokens"], r["train_tokens"], round(r["base_score"], 9), round(r["score"], 9)) for r in df.collect())
    whole = key(lm.score_documents(docs))
    monkeypatch.setattr(lm.told_apart, "__defaults__", (10,))
    assert key(lm.score_documents(docs, block_bytes=200)) == whole and len(whole) == len(rows())


def test_equal_rows_lie_in_several_shards(spark, tmp_path):
    docs = documents(spark, rows()).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dac.write(docs, str(tmp_path / "ids"), TOKENIZER, 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(str(tmp_path / "ids"))
    shards = files.select("shard", F.explode("doc_ids").alias("doc_id")).where("doc_id IS NULL").groupBy("shard").count().collect()
    assert len(shards) > 1
    found = dac.read(spark, str(tmp_path / "ids")).orderBy("start").collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in rows()) and [r["start"] for r in found] == [sum(x["n_tokens"] for x in found[:k]) for k in range(len(found))]
