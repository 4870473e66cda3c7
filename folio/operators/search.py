"""Chunks, an inverted index with ranked search, glossary, navigation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import ids
from folio.functions import text as T
from folio.operators.graph import scratch

STANDALONE = ("callout", "table", "list", "list_item", "caption")
FLUSHING = ("divider", "unknown")

#: Rows of query and word that go to all tasks.
MOST_WANTED = 500_000


def chunks(blocks: DataFrame, most_paragraphs: int = 3) -> DataFrame:
    """page_id, anchor, block_ids, n_blocks, text: a heading with up to three paragraphs after it; standalone kinds and other paragraphs alone.

    Dividers end a group and are in none; a figure ends a group and is a chunk if it has text. Chunks
    without text are left out.
    """
    w = Window.partitionBy("page_id").orderBy("pos")
    kind = F.col("kind")
    closes = kind.isin(*STANDALONE, *FLUSHING, "figure", "heading")
    # A group of paragraphs is open from a heading on; what closes it also counts as its border.
    rows = blocks.withColumn("border", F.sum(closes.cast("int")).over(w))
    in_border = Window.partitionBy("page_id", "border").orderBy("pos")
    rows = rows.withColumn("nth", F.row_number().over(in_border) - F.when(F.first(closes).over(in_border), 1).otherwise(0))
    rows = rows.withColumn("opener", F.first("kind").over(in_border))
    joined = (F.col("opener") == "heading") & (F.col("nth") <= most_paragraphs)
    rows = rows.withColumn("group", F.when(joined, F.lit(0)).otherwise(F.col("nth") + F.lit(most_paragraphs)))
    rows = rows.where(~kind.isin(*FLUSHING) & ~((kind == "figure") & (F.trim("text") == "")))
    items = F.sort_array(F.collect_list(F.struct("pos", "block_id", "text")))
    out = rows.groupBy("page_id", "border", "group").agg(items.alias("b"))
    names = F.transform("b", lambda x: x["block_id"])
    text = F.array_join(F.filter(F.transform("b", lambda x: F.trim(x["text"])), lambda t: t != ""), " ")
    rows = out.select("page_id", names.alias("block_ids"), text.alias("text")).where(F.trim("text") != "")
    return rows.select("page_id", ids.chunk_anchor(F.col("page_id"), F.col("block_ids")).alias("anchor"), "block_ids", F.size("block_ids").alias("n_blocks"), "text")


def _terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, terms, length of documents."""
    terms = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return docs.select(F.col(key).alias("key"), terms.alias("terms")).withColumn("length", F.size("terms"))


def sent(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What marks a table of these rows, or of fewer, as one that goes to all tasks, if they are MOST_WANTED or fewer; they are counted for it."""
    return F.broadcast if rows.limit(MOST_WANTED + 1).count() <= MOST_WANTED else lambda df: df


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, length: the inverted index of lower-case words of letters and digits, with each document's length."""
    rows = _terms(docs, key, text)
    return rows.select("key", "length", F.explode("terms").alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def term_statistics(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, rank, key, score: each query's k best documents by Okapi BM25 (scores rounded to 6 digits, ties to the smaller key).

    docs: a row for each document, with its key and text; documents without a word don't count. queries: query_id, term (one row a term).
    Texts are split once: what is counted of the words that a query asks for, and each document's length (under the empty word), is written below the
    scratch folder. A document's words then meet in one task, so its scores are added up where its words are, and only a task's best rows of a query are
    exchanged. Words of queries go to all tasks, if they are MOST_WANTED rows or fewer; more are joined by exchanges.
    """
    folder = scratch(docs.sparkSession, "hits")
    wanted = queries.select("query_id", "term").distinct().where("term <> ''").checkpoint()
    few = sent(wanted)
    # A condition on the words' number would split the texts once more.
    asked = _terms(docs.where(F.lower(text).rlike(r"[\p{L}\p{N}]")), key, text).select("key", "length", F.explode(F.array_append("terms", F.lit(""))).alias("term"))
    kept = wanted.select("term").union(docs.sparkSession.createDataFrame([("",)], "term string")).distinct()
    counted = asked.join(few(kept), "term", "left_semi").groupBy("key", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"), F.sum("length").alias("total"))
    counted.write.parquet(folder)
    hits = docs.sparkSession.read.schema(counted.schema).parquet(folder)
    sizes = hits.where("term = ''").agg(F.sum("tf").alias("n_docs"), (F.sum("total") / F.sum("tf")).alias("mean"))
    df = hits.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    terms = wanted.join(df, "term")
    weighed = hits.where("term <> ''").drop("total").repartition("key").join(few(terms), "term").join(F.broadcast(sizes))  # sizes is one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = weighed.groupBy("query_id", "key").agg(F.round(F.sum(part), 6).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "key", "score")


def search_documents(pages: DataFrame) -> DataFrame:
    """page_id, text, terms: a page's text with its sorted distinct terms."""
    return pages.withColumn("terms", T.search_terms(F.col("text")))


def glossary_matches(entries: DataFrame, query: str) -> DataFrame:
    """Glossary entries (term, source_term, notes, aliases) that hold the query anywhere, ignoring case."""
    q = F.lower(F.lit(query))
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), q)
    return entries.where(has(F.col("term")) | has(F.col("source_term")) | has(F.col("notes")) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), has))


def page_references(mentions: DataFrame) -> DataFrame:
    """concept_id, page_id: a row for each page that mentions a concept, so a concept of all pages is no large group."""
    return mentions.select("concept_id", "page_id").distinct()


def navigation(pages: DataFrame, group: str, order: str, runs: int = 256) -> DataFrame:
    """pages with prev_page and next_page within their group, by a numeric order.

    A group is cut into runs of its order, at its percentiles, so a group of a third of all pages is many tasks. Neighbours are found within a run;
    a run's first and last page find theirs among the ends of the group's runs, of which there are ``runs`` at most.
    """
    cuts = pages.groupBy(group).agg(F.percentile_approx(F.col(order).cast("double"), [k / runs for k in range(1, runs)], 10_000).alias("cuts"))
    rows = pages.join(cuts, pages[group].eqNullSafe(cuts[group]), "left").drop(cuts[group])
    rows = rows.withColumn("run", F.size(F.filter(F.array_distinct("cuts"), lambda c: c < F.col(order).cast("double")))).drop("cuts")
    w = Window.partitionBy(group, "run").orderBy(order, "page_id")
    rows = rows.withColumn("prev_page", F.lag("page_id").over(w)).withColumn("next_page", F.lead("page_id").over(w))
    key = F.struct(order, "page_id")
    ends = rows.groupBy(F.col(group).alias("g"), F.col("run").alias("r")).agg(F.min_by("page_id", key).alias("first"), F.max_by("page_id", key).alias("last"))
    between = Window.partitionBy("g").orderBy("r")
    ends = ends.select("g", "r", F.lag("last").over(between).alias("before"), F.lead("first").over(between).alias("after"))
    out = rows.join(ends, rows[group].eqNullSafe(ends["g"]) & (rows["run"] == ends["r"]))
    return out.select(*[F.col(c) for c in pages.columns], F.coalesce("prev_page", "before").alias("prev_page"), F.coalesce("next_page", "after").alias("next_page"))


def section_of(blocks: DataFrame, order: list[str], heading: str = "heading", by: str = "page_id") -> DataFrame:
    """blocks with section: the text of the last heading at or before each block."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section", F.last(F.when(F.col("kind") == heading, F.col("text")), ignorenulls=True).over(w))


def match_toc(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """entries (title, page) with page_id of the page with that title, ignoring case; a title of several pages takes the last."""
    last = pages.groupBy(F.lower(F.trim("title")).alias("key")).agg(F.max("page_id").alias("page_id"))
    return entries.withColumn("key", F.lower(F.trim("title"))).join(last, "key", "left").drop("key")


def harvest(chunks: DataFrame, inlines: DataFrame) -> DataFrame:
    """chunks (anchor, block_ids) with concepts (array of concept_id, surface_form) and symbols: those of their blocks' inlines, each once, by its first place.

    inlines: block_id, type (term_mark or icon), concept_id, surface_form, symbol_id, at (a number in page order).
    """
    own = chunks.select("anchor", F.explode("block_ids").alias("block_id")).join(inlines.where("type IN ('term_mark', 'icon')"), "block_id")
    name = F.when(F.col("type") == "icon", F.col("symbol_id")).otherwise(F.col("concept_id"))
    first = own.withColumn("name", name).where("name IS NOT NULL").groupBy("anchor", "type", "name").agg(F.min("at").alias("at"), F.min_by("surface_form", "at").alias("surface_form"))
    lists = first.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("at", "type", "name", "surface_form"))).alias("l"))
    of = lambda kind: F.filter(F.coalesce("l", F.array().cast("array<struct<at:bigint,type:string,name:string,surface_form:string>>")), lambda x: x["type"] == kind)
    rows = chunks.join(lists, "anchor", "left")
    concepts = F.transform(of("term_mark"), lambda x: F.struct(x["name"].alias("concept_id"), x["surface_form"].alias("surface_form")))
    return rows.withColumn("concepts", concepts).withColumn("symbols", F.transform(of("icon"), lambda x: x["name"])).drop("l")


def chunk_boxes(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """anchor, block_id, x0..y1 in shares of the page (width, height), of the blocks that have a box and a page with a size."""
    own = chunks.select("anchor", "page_id", F.explode("block_ids").alias("block_id"))
    rows = own.join(blocks.where("x0 IS NOT NULL AND width > 0 AND height > 0"), ["page_id", "block_id"])
    from folio.functions import geometry as G

    return rows.select("anchor", "block_id", G.normalized("width", "height").alias("b")).select("anchor", "block_id", "b.*")


def searchable(chunks: DataFrame) -> DataFrame:
    """anchor, normalized_text, section_text, glossary_text, symbol_text: what the full-text index holds of a chunk; the sections' and symbols' JSON without quotes and brackets."""
    bare = lambda c: F.regexp_replace(F.to_json(c), r'["\[\]]', "")
    words = F.flatten(F.transform("concepts", lambda c: F.filter(F.array(c["concept_id"], c["surface_form"]), lambda x: F.coalesce(x, F.lit("")) != "")))
    return chunks.select("anchor", T.nfkd_lower(F.col("text")).alias("normalized_text"), bare(F.col("section_path")).alias("section_text"), F.array_join(words, " ").alias("glossary_text"), bare(F.col("symbols")).alias("symbol_text"))
