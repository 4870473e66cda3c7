"""Exact ranked search over an index of impact-ordered posting blocks with upper bounds.

The index is three tables below a path that all executors reach: ``forward`` (a document's words with counts), ``blocks`` (a word's postings by
falling impact, with each block's largest one) and ``sizes``. A query first scores the documents of its rarest words; the k-th of these scores is a
threshold. Of all other words only the blocks are opened that could lift a document over it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from folio.operators import runs
from folio.operators.search import _terms

#: Postings of a block at most on average; a level of impact with more is cut by a hash of the key.
BLOCK = 1024
#: Steps of impact that a word's postings are sorted into; an impact is at most k1 + 1.
STEPS = 16
#: Documents whose words are counted together.
ROWS = 512
#: Scores are rounded to six digits, so what is this much below a threshold may still tie with it.
SLACK = 2e-6


@dataclass(frozen=True)
class Index:
    """sizes (n_docs, mean), forward (key, length, words: term and tf), blocks (term, step, part, n, top, postings: key and impact)."""

    sizes: DataFrame
    forward: DataFrame
    blocks: DataFrame
    k1: float
    b: float

    @property
    def terms(self) -> DataFrame:
        """term, df, top: in how many documents a word is, and its largest impact."""
        return self.blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("top"))


def _impact(tf: Column, length: Column, mean: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def _counted(rows: DataFrame) -> DataFrame:
    """key, length, words: each row's distinct terms with their number; rows have key, length and terms."""
    schema = StructType([rows.schema["key"], rows.schema["length"], StructField("words", ArrayType(StructType([StructField("term", StringType()), StructField("tf", LongType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            terms, row = runs.flat(batch, "terms", np.arange(batch.num_rows))
            found = terms.dictionary_encode()
            n = max(1, len(found.dictionary))
            cells, tf = np.unique(row * n + found.indices.to_numpy(), return_counts=True)
            offsets = np.searchsorted(cells // n, np.arange(batch.num_rows + 1)).astype(np.int32)
            words = pa.StructArray.from_arrays([found.dictionary.take(pa.array(cells % n)), pa.array(tf, pa.int64())], ["term", "tf"])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("length"), pa.ListArray.from_arrays(pa.array(offsets), words)], ["key", "length", "words"])

    return rows.mapInArrow(run, schema)


def build(docs: DataFrame, key: str, text: str, path: str, k1: float = 1.2, b: float = 0.75) -> None:
    """Writes the index of docs (one row a key) below ``path``. Documents without a word are not in it.

    Texts are shuffled by key once, as words, and counted by document where they arrive, many at once; no word is a row of an aggregate.
    """
    spark = docs.sparkSession
    rows = runs.merged(_terms(docs, key, text).where("length > 0"), ["key", "length"])
    _counted(rows).write.mode("overwrite").parquet(f"{path}/forward")
    forward = spark.read.parquet(f"{path}/forward")
    forward.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean")).write.mode("overwrite").parquet(f"{path}/sizes")
    sizes = spark.read.parquet(f"{path}/sizes")
    hits = forward.select("key", "length", F.explode("words").alias("w")).join(F.broadcast(sizes))  # sizes is one row
    hits = hits.select("key", F.col("w.term").alias("term"), _impact(F.col("w.tf"), F.col("length"), F.col("mean"), k1, b).alias("impact"))
    hits = hits.withColumn("step", F.floor(F.col("impact") * STEPS / (k1 + 1)).cast("int"))
    large = hits.groupBy("term", "step").agg(F.count("*").alias("total")).where(F.col("total") > BLOCK).withColumn("parts", F.ceil(F.col("total") / BLOCK)).drop("total")
    part = F.coalesce(F.pmod(F.xxhash64("key"), F.col("parts")), F.lit(0)).cast("int")
    blocks = hits.join(large, ["term", "step"], "left").withColumn("part", part).groupBy("term", "step", "part")
    out = blocks.agg(F.count("*").alias("n"), F.max("impact").alias("top"), F.collect_list(F.struct("key", "impact")).alias("postings"))
    # Readers join on the term, so blocks stay where they were made and need no exchange by ranges.
    out.sortWithinPartitions("term", F.desc("step")).write.mode("overwrite").parquet(f"{path}/blocks")


def load(spark: SparkSession, path: str, k1: float = 1.2, b: float = 0.75) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("sizes", "forward", "blocks")), k1, b)


def weighed(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, term, df, idf, most, rest: each distinct word of a query that a document has, with the most it can add, and what the query's words with less can add together."""
    found = queries.select("query_id", "term").distinct().join(index.terms, "term").join(F.broadcast(index.sizes))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    below = Window.partitionBy("query_id").orderBy(F.desc("most"), "term").rowsBetween(1, Window.unboundedFollowing)
    return found.select("query_id", "term", "df", idf.alias("idf"), (idf * F.col("top")).alias("most")).withColumn("rest", F.coalesce(F.sum("most").over(below), F.lit(0.0)))


def exact_scores(index: Index, pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, key, score of the given pairs (distinct), from the documents' own words; rounded to six digits."""
    asked = pairs.join(wanted.select("query_id", "term", "idf"), "query_id")
    docs = index.forward.join(pairs.select("key").distinct(), "key", "left_semi").select("key", "length", F.explode("words").alias("w"))
    docs = docs.select("key", "length", F.col("w.term").alias("term"), F.col("w.tf").alias("tf"))
    rows = asked.join(docs, ["key", "term"]).join(F.broadcast(index.sizes))  # one row
    part = F.col("idf") * _impact(F.col("tf"), F.col("length"), F.col("mean"), index.k1, index.b)
    return rows.groupBy("query_id", "key").agg(F.round(F.sum(part), 6).alias("score"))


def seeds(index: Index, wanted: DataFrame, k: int) -> DataFrame:
    """query_id, key of some documents that are likely to rank high: the best blocks of a query's rarest words, until some 4 k postings are there."""
    rare = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    first = wanted.withColumn("before", F.coalesce(F.sum("df").over(rare), F.lit(0))).where(F.col("before") < 4 * k).select("query_id", "term")
    best = Window.partitionBy("term").orderBy(F.desc("top"), "step", "part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = index.blocks.join(first.select("term").distinct(), "term", "left_semi")
    opened = blocks.select("term", "step", "part", "n", "top").withColumn("before", F.coalesce(F.sum("n").over(best), F.lit(0))).where(F.col("before") < 4 * k)
    read = index.blocks.join(opened.select("term", "step", "part"), ["term", "step", "part"]).select("term", F.explode("postings.key").alias("key"))
    return first.join(read, "term").select("query_id", "key").distinct()


def opened_blocks(index: Index, wanted: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Blocks (query_id, term, idf, rest, threshold, n, postings) that may hold a document which reaches its query's threshold.

    Take a document's words in a query by falling ``most``: with the first of them it has what that adds and at most ``rest``. So a
    document that reaches the threshold is in a block of one of its words with idf x top + rest at the threshold or above.
    """
    rows = wanted.join(thresholds, "query_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))
    rows = rows.where(F.col("most") + F.col("rest") >= F.col("threshold") - SLACK)
    return index.blocks.join(rows, "term").where(F.col("idf") * F.col("top") + F.col("rest") >= F.col("threshold") - SLACK)


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, key, score: each query's k best documents by Okapi BM25, the same rows as ``search.bm25`` (scores rounded to six digits, ties to the smaller key).

    queries: query_id, term (one row a word). Words that no document has add nothing; a query without any other gives no row.
    """
    wanted = weighed(index, queries).checkpoint()
    known = exact_scores(index, seeds(index, wanted, k), wanted).checkpoint()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    thresholds = known.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k).select("query_id", F.col("score").alias("threshold"))
    opened = opened_blocks(index, wanted, thresholds)
    # What a word can add to a document that its opened postings don't hold.
    cut = F.least(F.col("most"), F.greatest(F.lit(0.0), F.col("threshold") - F.col("rest")))
    unseen = wanted.join(thresholds, "query_id").withColumn("cut", cut).groupBy("query_id").agg(F.sum("cut").alias("unseen"))
    hits = opened.select("query_id", "idf", "rest", "threshold", cut.alias("cut"), F.explode("postings").alias("p"))
    hits = hits.select("query_id", "threshold", "cut", "rest", F.col("p.key").alias("key"), (F.col("idf") * F.col("p.impact")).alias("adds")).where(F.col("adds") + F.col("rest") >= F.col("threshold") - SLACK)
    pairs = hits.groupBy("query_id", "key").agg(F.first("threshold").alias("threshold"), F.sum(F.col("adds") - F.col("cut")).alias("seen"))
    pairs = pairs.join(unseen, "query_id", "left").where(F.col("seen") + F.coalesce("unseen", F.lit(0.0)) >= F.col("threshold") - SLACK)
    new = pairs.select("query_id", "key").join(known, ["query_id", "key"], "left_anti")
    scored = known.unionByName(exact_scores(index, new, wanted))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "key", "score")
