"""Ranked search by bounds against the plain sum over all hits; the positional index against SQLite's full-text search."""

import itertools
import random
import sqlite3
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folio.operators import positional, search, topk

COMMON = ["the", "of", "and"]


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    rare = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(COMMON) if rng.random() < 0.5 else rare[min(int(rng.expovariate(0.02)), 399)] for _ in range(rng.randrange(1, 60))) + " the") for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "... !"), (n + 3, rows[0][1]), (n + 4, rows[0][1]), (n + 5, "the " * 3000)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("topk"))
    topk.build(spark.createDataFrame(corpus(), "id long, text string"), "id", "text", path)
    return topk.load(spark, path)


QUERIES = [(1, "the of w3 w7"), (2, "the"), (3, "w1"), (4, "w399 the and of"), (5, "nowhere"), (6, "nowhere w2 the"), (7, "w5 w9 w12 w20 w33 w41"), (8, "the the and")]


@pytest.mark.parametrize("k", [1, 3, 10, 1000])
def test_same_rows_as_the_whole_sum(spark, index, k):
    docs = spark.createDataFrame(corpus(), "id long, text string")
    asked = spark.createDataFrame([(q, w) for q, text in QUERIES for w in text.split()], "query_id long, term string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(topk.search(index, asked, k)) == rows(search.bm25(docs, "id", "text", asked, k))


@pytest.mark.parametrize("most", [500_000, 0])
def test_texts_are_split_once_and_scored_where_their_words_are(spark, monkeypatch, most):
    """No text is split after the hits are written, and no row for each pair of query and document is exchanged; with words of too many rows, the same by exchanges."""
    monkeypatch.setattr(search, "MOST_WANTED", most)
    docs = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, "b"), (4, " ."), (5, None)], "id long, text string")
    asked = spark.createDataFrame([(7, "a"), (7, "b"), (7, "b"), (8, "c"), (8, ""), (None, "b"), (9, None)], "query_id long, term string")
    found = search.bm25(docs, "id", "text", asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and ("Exchange hashpartitioning(query_id#" in plan)
    assert most == 0 or not [x for x in plan.splitlines() if "Exchange hashpartitioning(query_id#" in x and ", key#" in x]
    assert sorted((str(r["query_id"]), r["rank"], r["key"]) for r in found.collect()) == [("7", 1, 1), ("7", 2, 3), ("7", 3, 2), ("8", 1, 2), ("None", 1, 3), ("None", 2, 1)]


def test_few_postings_are_opened(spark, index):
    """Queries of one rare word and words of nearly all documents: well under half of their postings are opened."""
    asked = spark.createDataFrame([(q, w) for q in range(20) for w in ("the", "of", "and", f"w{q}")], "query_id long, term string")
    wanted = topk.weighed(index, asked).checkpoint()
    known = topk.exact_scores(index, topk.seeds(index, wanted, 5), wanted)
    ranked = known.orderBy("query_id", F.desc("score"), "key").collect()
    scores = {}
    for r in ranked:
        scores.setdefault(r["query_id"], []).append(r["score"])
    thresholds = spark.createDataFrame([(q, s[4]) for q, s in scores.items() if len(s) > 4], "query_id long, threshold double")
    opened = topk.opened_blocks(index, wanted, thresholds).agg(F.sum("n")).first()[0]
    total = wanted.agg(F.sum("df")).first()[0]
    assert opened < 0.4 * total


def test_index_of_nothing(spark, tmp_path):
    topk.build(spark.createDataFrame([(1, None), (2, "!")], "id long, text string"), "id", "text", str(tmp_path))
    asked = spark.createDataFrame([(1, "the")], "query_id long, term string")
    assert topk.search(topk.load(spark, str(tmp_path)), asked).count() == 0


TEXTS = ["Été à la plage", "ete a LA plage", "naïve café, Ångström", "one two three four", "one two one two", "two one", "three x x x one", "one x x three two", "onerous twofold", "", None, "Straße 12", "a1 b2 a1", "one\ttwo\nthree"]


def fts5():
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("SQLite without FTS5")
    return con


def random_texts():
    rng = random.Random(5)
    return TEXTS + [" ".join(rng.choice(["one", "two", "three", "onset", "twin", "x", "Été"]) for _ in range(rng.randrange(1, 25))) for _ in range(80)]


PHRASES = [("one two", False), ("one tw", True), ("o", True), ("ete", False), ("three x x", False), ("on on", True), ("strasse", False), ("Straße 12", False), ("angstrom", False), ("zzz", True), ("two one two", False)]


def test_phrases_like_sqlite(spark, tmp_path):
    con, texts = fts5(), random_texts()
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(texts)))
    want = set()
    for q, (words, prefix) in enumerate(PHRASES):
        found = con.execute("SELECT rowid FROM t WHERE t MATCH ?", (f'"{words}"' + (" *" if prefix else ""),)).fetchall()
        want |= {(q, r[0]) for r in found}
    positional.build(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", str(tmp_path))
    asked = spark.createDataFrame([(q, w, p) for q, (w, p) in enumerate(PHRASES)], "query_id long, words string, p boolean")
    found = positional.search(positional.load(spark, str(tmp_path)), positional.phrase_rows(asked, "words", F.col("p")))
    assert {(r["query_id"], r["key"]) for r in found.collect()} == want and len(want) > 100


@pytest.mark.parametrize("distance", [0, 2, 10])
def test_near_like_sqlite(spark, tmp_path, monkeypatch, distance):
    monkeypatch.setattr(positional, "PART_WORDS", 40)
    con, texts = fts5(), random_texts()
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(texts)))
    pairs = [("one two", "three"), ("three", "one two"), ("x", "onset"), ("twin", "ete", "x"), ("one", "one"), ("zzz", "one")]
    want = set()
    for q, phrases in enumerate(pairs):
        near = "NEAR({}, {})".format(" ".join(f'"{p}"' for p in phrases), distance)
        want |= {(q, r[0]) for r in con.execute("SELECT rowid FROM t WHERE t MATCH ?", (near,)).fetchall()}
    positional.build(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", str(tmp_path))
    asked = spark.createDataFrame([(q, i, p) for q, phrases in enumerate(pairs) for i, p in enumerate(phrases)], "query_id long, i int, words string")
    found = positional.search(positional.load(spark, str(tmp_path)), positional.phrase_rows(asked, "words", phrase=F.col("i")), distance)
    assert {(r["query_id"], r["key"]) for r in found.collect()} == want and len(want) > 20


def test_places(spark, tmp_path):
    positional.build(spark.createDataFrame([(7, "a b a b c"), (9, "x b c")], "id long, text string"), "id", "text", str(tmp_path))
    asked = spark.createDataFrame([("q", "a b"), ("r", "b c")], "query_id string, words string")
    found = positional.search(positional.load(spark, str(tmp_path)), positional.phrase_rows(asked, "words"))
    assert sorted(map(tuple, found.collect())) == [("q", 7, 2, 0), ("r", 7, 1, 3), ("r", 9, 1, 1)]


@pytest.mark.parametrize("places", [1, 7, 1 << 16])
def test_blocks_of_a_part(spark, tmp_path, monkeypatch, places):
    """Every position once, in blocks by part and word; rows of one key are one document, rows without a key none."""
    monkeypatch.setattr(positional, "_BATCH_PLACES", places)
    rng = random.Random(places)
    texts = [(k, " ".join(rng.choice(["ab", "B", "été", "z9", "日本"]) for _ in range(rng.randrange(30)))) for k in [*range(20), 3, 3, None]]
    want = Counter((w, k, i) for k, t in texts if k is not None for i, w in enumerate(t.lower().replace("é", "e").split()))
    positional.build(spark.createDataFrame(texts, "id long, text string"), "id", "text", str(tmp_path / "index"))
    found, names = Counter(), []
    for r in positional.load(spark, str(tmp_path / "index")).collect():
        names.append((r["part"], r["term"]))
        assert r["n"] == sum(len(p["gaps"]) for p in r["postings"]) and [p["key"] for p in r["postings"]] == sorted({p["key"] for p in r["postings"]})
        for p in r["postings"]:
            found.update((r["term"], p["key"], at) for at in itertools.accumulate(p["gaps"]))
    assert found == want and len(set(names)) == len(names)


def test_a_prefix_is_one_entry_of_each_query(spark, tmp_path):
    """Rows of a prefix grow with the words that begin so, or with the queries that ask for it, and not with both."""
    positional.build(spark.createDataFrame([(1, " ".join(f"ab{i} x" for i in range(300))), (2, "x ab1")], "id long, text string"), "id", "text", str(tmp_path))
    index = positional.load(spark, str(tmp_path))
    slots = positional.phrase_rows(spark.range(50).select(F.col("id").alias("query_id"), F.lit("x ab").alias("words")), "words", F.lit(True))
    assert positional._starts(index, slots).count() == 300
    assert {(r["key"], r["n"], r["place"]) for r in positional.search(index, slots).collect()} == {(1, 299, 1), (2, 1, 0)}
