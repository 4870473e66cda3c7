"""Expansion, reranking and bridges by example and by brute force."""

import itertools
import math
import random

import pytest

from folio.operators import feedback, topk


@pytest.mark.parametrize("seed", range(5))
def test_smallest_window_like_all_stretches(seed):
    rng = random.Random(seed)
    places = sorted({rng.randrange(60): rng.choice("abcd") for _ in range(rng.randrange(1, 25))}.items())
    words = {w for _, w in places}
    best = min(places[j][0] - places[i][0] + 1 for i, j in itertools.combinations_with_replacement(range(len(places)), 2) if {w for _, w in places[i : j + 1]} == words)
    assert feedback.smallest_window(places) == (len(words), best)


def test_documents_with_close_words_come_first(spark):
    docs = spark.createDataFrame([(1, "red x x x x fox"), (2, "a red fox"), (3, "red"), (4, "fox fox red x fox"), (5, None)], "id long, text string")
    ranked = spark.createDataFrame([("q", i + 1, k) for i, k in enumerate([1, 2, 3, 4])], "query_id string, rank int, key long")
    queries = spark.createDataFrame([("q", "red"), ("q", "fox"), ("q", "none"), ("r", "x")], "query_id string, term string")
    found = feedback.rerank(docs, "id", "text", ranked, queries).orderBy("rank").collect()
    assert [tuple(r)[1:] for r in found] == [(1, 2, 2, 2), (2, 4, 2, 2), (3, 1, 2, 6), (4, 3, 1, 1)]


def test_words_of_the_best_documents(spark, tmp_path):
    rows = [(1, "red fox runs runs"), (2, "red fox runs home"), *((k, "blue the home") for k in range(3, 12))]
    topk.build(spark.createDataFrame(rows, "id long, text string"), "id", "text", str(tmp_path))
    index = topk.load(spark, str(tmp_path))
    ranked = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (7, 3, 3)], "query_id long, rank int, key long")
    queries = spark.createDataFrame([(7, "red")], "query_id long, term string")
    found = feedback.expansion_terms(index, ranked, queries, docs=2, terms=3).orderBy("nth").collect()
    total = 8 + 27
    weight = lambda tf, cf: round(tf / 8 * math.log2(tf / 8 / (cf / total)), 6)
    assert [tuple(r) for r in found] == [(7, 1, "runs", weight(3, 3)), (7, 2, "fox", weight(2, 2)), ][: len(found)] and len(found) == 2
    more = feedback.expanded_queries(queries, found and feedback.expansion_terms(index, ranked, queries, docs=2))
    assert {r["key"] for r in topk.search(index, more, 2).collect()} == {1, 2}


def test_paragraphs_over_a_page_end(spark):
    rows = [("p1", "a", 0, "paragraph", "Start."), ("p1", "b", 1, "paragraph", "this goes on to the fol-"), ("p1", "c", 2, "paragraph", " "), ("p2", "d", 0, "paragraph", "lowing page. And"), ("p3", "e", 0, "paragraph", "more text."), ("p4", "f", 0, "paragraph", "small but after a stop"), ("p5", "g", 0, "heading", "heading"), ("p6", "h", 0, "paragraph", "x"), ("p7", "i", 0, "paragraph", "Capital")]
    blocks = spark.createDataFrame(rows, "page_id string, block_id string, pos int, kind string, text string")
    pages = spark.createDataFrame([(f"p{k}", f"p{k + 1}" if k < 7 else None) for k in range(1, 8)], "page_id string, next_page string")
    found = feedback.bridges(blocks, pages).orderBy("page_id").collect()
    assert [tuple(r) for r in found] == [("p1", "p2", ["b", "d"], "this goes on to the following page. And"), ("p2", "p3", ["d", "e"], "lowing page. And more text.")]
