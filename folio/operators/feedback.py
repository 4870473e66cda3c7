"""Better rankings from a first one: words of its best documents, and how closely the query's words stand together."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.search import _terms, sent
from folio.operators.topk import Index


def expansion_terms(index: Index, ranked: DataFrame, queries: DataFrame, docs: int = 5, terms: int = 10) -> DataFrame:
    """query_id, nth, term, weight: words that a query's best documents (ranked: query_id, rank, key) hold more often than all documents do.

    weight is the word's part of the divergence between the two: p log2(p / c), with its share p of the ``docs`` best documents' words and its share c
    of all words, rounded to six digits; the query's own words (query_id, term) and weights of 0 or less are left out, ties go to the smaller
    word. Only the best documents' words are joined with the counts of all.
    """
    best = ranked.where(F.col("rank") <= docs).select("query_id", "key").distinct()
    words = index.forward.join(best.select("key").distinct(), "key", "left_semi").select("key", F.explode("words").alias("w")).select("key", "w.term", "w.tf")
    counts = index.forward.select(F.explode("words").alias("w")).groupBy("w.term").agg(F.sum("w.tf").alias("cf"))
    total = index.forward.agg(F.sum("length").alias("all_cf"))
    return _diverging(_held(best, words), counts, total, queries, terms)


def expansion_of_texts(texts: DataFrame, key: str, text: str, ranked: DataFrame, queries: DataFrame, docs: int = 5, terms: int = 10) -> DataFrame:
    """What ``expansion_terms`` gives with an index of texts (one row a key), for a ranking that is asked once: no index is made.

    ranked is read twice. Keys and words go to all tasks, if they are few: then a text is not exchanged, all texts are split once, and of their words only those that a best document
    holds are counted, in the task where they are. Of more words, all are counted so, and joined after.
    """
    best = ranked.where(F.col("rank") <= docs).select("query_id", "key").distinct()
    keys = best.select(F.col("key").alias(key)).distinct()
    words = _words(texts.join(sent(best)(keys), key, "left_semi"), key, text).groupBy("key", "term").agg(F.count("*").alias("tf"))
    held = _held(best, words).checkpoint()
    wanted = held.select("term").union(texts.sparkSession.createDataFrame([("",)], "term string")).distinct()
    # The empty word stands for a document: its number of words.
    split = _terms(texts, key, text).select("length", F.explode(F.array_append("terms", F.lit(""))).alias("term"))
    few = sent(wanted)
    counted = (split.join(few(wanted), "term", "left_semi") if few is F.broadcast else split).groupBy("term").agg(F.count("*").alias("cf"), F.sum("length").alias("all_cf"))
    if few is not F.broadcast:
        counted = counted.join(wanted, "term", "left_semi")
    counted = counted.checkpoint()
    return _diverging(held, counted.where("term <> ''").select("term", "cf"), counted.where("term = ''").select("all_cf"), queries, terms)


def _words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, place, term of documents' words. Outer, since a plain posexplode would have Spark look for a word in each text before it picks documents."""
    return _terms(docs, key, text).select("key", F.posexplode_outer("terms").alias("place", "term")).where("term IS NOT NULL")


def _held(best: DataFrame, words: DataFrame) -> DataFrame:
    """query_id, term, tf, all_tf: how often a query's best documents hold a word, and how many words they have."""
    held = best.join(words, "key").groupBy("query_id", "term").agg(F.sum("tf").alias("tf"))
    return held.join(held.groupBy("query_id").agg(F.sum("tf").alias("all_tf")), "query_id")


def _diverging(held: DataFrame, counts: DataFrame, total: DataFrame, queries: DataFrame, terms: int) -> DataFrame:
    rows = held.join(queries.select("query_id", "term").distinct(), ["query_id", "term"], "left_anti").join(counts, "term").join(F.broadcast(total))  # one row
    p, c = F.col("tf") / F.col("all_tf"), F.col("cf") / F.col("all_cf")
    rows = rows.withColumn("weight", F.round(p * F.log2(p / c), 6)).where("weight > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), "term")
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= terms).select("query_id", "nth", "term", "weight")


def expanded_queries(queries: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, term: the queries with the words of ``expansion_terms``, for a second search."""
    return queries.select("query_id", "term").unionByName(found.select("query_id", "term")).distinct()


def smallest_window(places: list[tuple[int, str]]) -> tuple[int, int]:
    """Of (place, word) in order: how many different words there are, and the number of places of the shortest stretch that holds all of them."""
    words = len({w for _, w in places})
    held: dict[str, int] = {}
    left, best = 0, 0
    for place, word in places:
        held[word] = held.get(word, 0) + 1
        while len(held) == words and held[places[left][1]] > 1:
            held[places[left][1]] -= 1
            left += 1
        if len(held) == words:
            size = place - places[left][0] + 1
            best = size if not best else min(best, size)
    return words, best


def rerank(docs: DataFrame, key: str, text: str, ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, rank, key, n_words, window: the ranked documents (query_id, rank, key) anew, by how many of the query's words they hold (most first), then by the shortest stretch that holds these, then as before.

    Only documents in the ranking are cut into words, and only the asked words' places leave them. The ranking is read twice; its keys go to all tasks, if they are few, so no
    text is exchanged.
    """
    rows = _words(docs.join(sent(ranked)(ranked.select(F.col("key").alias(key)).distinct()), key, "left_semi"), key, text)
    asked = ranked.join(queries.select("query_id", "term").distinct(), "query_id")
    places = rows.join(asked, ["key", "term"])
    lists = places.groupBy("query_id", "key", "rank").agg(F.sort_array(F.collect_list(F.struct("place", "term"))).alias("places"))
    kind, name = dict(ranked.dtypes)["query_id"], dict(ranked.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [smallest_window([(p["place"], p["term"]) for p in own]) for own in batch.column("places").to_pylist()]
            numbers = [pa.array([f[k] for f in found], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("key"), batch.column("rank"), *numbers], ["query_id", "key", "before", "n_words", "window"])

    scored = lists.select("query_id", "key", F.col("rank").cast("int").alias("rank"), "places").mapInArrow(run, f"query_id {kind}, key {name}, before int, n_words int, window int")
    order = Window.partitionBy("query_id").orderBy(F.desc("n_words"), "window", "before")
    return scored.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "key", "n_words", "window")


def bridges(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, next_page, block_ids, text: paragraphs that a page's end cuts in two, as one chunk.

    blocks: page_id, block_id, pos, kind, text. pages: page_id, next_page (``search.navigation``). A page's last block goes on in the next page's first one if
    both are paragraphs, the one doesn't end a sentence and the other begins with a small letter. A word cut by a hyphen is joined.
    """
    item = F.struct("block_id", "kind", F.trim("text").alias("text"))
    ends = blocks.where(F.trim("text") != "").groupBy("page_id").agg(F.max_by(item, "pos").alias("last"), F.min_by(item, "pos").alias("first"))
    rows = pages.where("next_page IS NOT NULL").select("page_id", "next_page").join(ends.select("page_id", "last"), "page_id").join(ends.select(F.col("page_id").alias("next_page"), "first"), "next_page")
    goes_on = ~F.col("last.text").rlike(r"[.!?:;…»”\"]$") & F.col("first.text").rlike(r"^\p{Ll}")
    rows = rows.where((F.col("last.kind") == "paragraph") & (F.col("first.kind") == "paragraph") & goes_on)
    text = F.when(F.col("last.text").rlike(r"\p{L}-$"), F.concat(F.regexp_replace("last.text", "-$", ""), "first.text")).otherwise(F.concat_ws(" ", "last.text", "first.text"))
    return rows.select("page_id", "next_page", F.array("last.block_id", "first.block_id").alias("block_ids"), text.alias("text"))
