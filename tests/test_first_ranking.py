"""Expansion and reranking of a ranking that is asked once: no index is made, and no text is exchanged."""

import random

import duckdb
import pytest

import folio.plans.index_queries  # noqa: F401  it registers queries and oracles
from folio.operators import feedback, search, topk
from folio.plans.queries import ORACLES, QUERIES

QUERY_NAMES = ("search_expansion", "search_reranked")


def corpus(n=150):
    rng = random.Random(9)
    rows = [(k, " ".join(f"w{min(int(rng.expovariate(0.05)), 120)}" for _ in range(rng.randrange(60)))) for k in range(n)]
    return [*rows, (n, None), (n + 1, "... !"), (n + 2, rows[3][1]), (n + 3, "Été, w1 W1 w2 w3 ?" * 40)]


@pytest.mark.parametrize("most", [500_000, 0])
def test_words_like_those_of_an_index(spark, tmp_path, monkeypatch, most):
    """With words and keys of too many rows, the same by exchanges."""
    monkeypatch.setattr(search, "MOST_WANTED", most)
    docs = spark.createDataFrame(corpus(), "id long, text string")
    topk.build(docs, "id", "text", str(tmp_path / "index"))
    queries = spark.createDataFrame([(q, f"w{w}") for q in range(12) for w in (q, q + 5, 40 + q)] + [(12, "nowhere"), (None, "w1")], "query_id long, term string")
    ranked = search.bm25(docs, "id", "text", queries).checkpoint()
    rows = lambda df: sorted(map(str, df.collect()))
    found = rows(feedback.expansion_of_texts(docs, "id", "text", ranked, queries, 3, 6))
    assert found == rows(feedback.expansion_terms(topk.load(spark, str(tmp_path / "index")), ranked, queries, 3, 6)) and len(found) > 60


@pytest.mark.parametrize("name", QUERY_NAMES)
def test_no_index_is_made(spark, tmp_path, monkeypatch, name):
    spark.createDataFrame(corpus(), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(q, f"W{q} w{q + 7}, w{q + 30} w1 w2 w3") for q in range(10)] + [(10, "none of it here"), (11, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    monkeypatch.setattr(topk, "build", lambda *a: pytest.fail("an index is made"))
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    found = QUERIES[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in found.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 50


def test_texts_are_not_exchanged(spark, tmp_path):
    """Only ranked documents' texts are split, where they are read: their keys are broadcast, though their number is not known beforehand."""
    spark.createDataFrame(corpus(), "id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    queries = spark.createDataFrame([(1, "w1"), (1, "w4")], "query_id long, term string")
    ranked = search.bm25(docs, "id", "text", queries).checkpoint()
    plan = feedback.rerank(docs, "id", "text", ranked, queries)._jdf.queryExecution().executedPlan().toString()
    assert [x for x in plan.splitlines() if "BroadcastHashJoin [id#" in x and "LeftSemi" in x]
    assert plan.count("regexp_extract_all") == 1 and plan.index("regexp_extract_all") < plan.index("LeftSemi")  # what stands above is done after


def test_texts_are_split_once_for_a_ranking(spark, monkeypatch):
    """No condition on the words splits the texts before they are split."""
    docs = spark.createDataFrame([(1, "a b b"), (2, " ."), (3, None)], "id long, text string")
    asked = spark.createDataFrame([(7, "a")], "query_id long, term string")
    plans, write = [], type(docs.write).parquet
    monkeypatch.setattr(type(docs.write), "parquet", lambda self, path: (plans.append(self._df._jdf.queryExecution().optimizedPlan().toString()), write(self, path))[1])
    search.bm25(docs, "id", "text", asked)
    assert len(plans) == 1 and plans[0].count("regexp_extract_all") == 1
