"""Document tables derived from the given tables.

The given tables hold text without layout, so boxes are made from positions by integer formulas that
any engine evaluates alike; queries over them say so. Defects that the given texts lack (page
references, leaked identifiers and the like) are appended by a rule on the block's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import ids

#: Appended to a block by (doc_id + pos) % len(SUFFIXES).
SUFFIXES = (
    " см. стр. 12",
    " see page 7",
    " AB1234 here",
    " core_rule_v1_2",
    " done.Next step",
    " exam- ple and self- made",
    " bell\u0007",
    " icon \ue001",
    " словоСЛОВО",
    "\nSetup..... 12 Play..... 34",
    " . ",
    "",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_id, block_id, pos, kind, text: the lines of documents that aren't blank, numbered from 0 as they stand.

    A document is a page. Its first block is a heading if it has 40 characters at most, others are
    paragraphs.
    """
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).where(F.trim("text") != "")
    page = ids.page_id(F.col("doc_id"))
    kind = F.when((F.col("pos") == 0) & (F.length("text") <= 40), "heading").otherwise("paragraph")
    return lines.select("doc_id", page.alias("page_id"), ids.block_id(page, F.col("pos") + 1).alias("block_id"), "pos", kind.alias("kind"), "text")


def defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """blocks with a defect appended to each text, of a kind that depends on the block's number."""
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.pmod(F.col("doc_id") + F.col("pos"), F.lit(len(SUFFIXES))) + 1).cast("int"))
    return blocks(spark, sf_dir).withColumn("text", F.concat("text", suffix))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of blocks with made-up boxes: 6 points a character, lines of 480 points, 14 points a block; all integers."""
    rows = blocks(spark, sf_dir).select("doc_id", "page_id", "block_id", "pos", F.posexplode(F.split("text", " ")).alias("wpos", "word"))
    x = 50 + F.pmod(F.col("wpos") * 37, F.lit(480))
    return rows.select(
        "doc_id",
        "page_id",
        "block_id",
        "pos",
        "wpos",
        F.format_string("%s.w%04d", "block_id", "wpos").alias("word_id"),
        "word",
        x.alias("x0"),
        (40 + 14 * F.col("pos")).alias("y0"),
        (x + 6 * F.length("word")).alias("x1"),
        (50 + 14 * F.col("pos")).alias("y1"),
    )


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a run registry: a user's events are a run's stages."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("stage_name"),
        F.when(F.col("event_id") % 7 == 0, "failed").when(F.col("event_id") % 5 == 0, "cached").otherwise("completed").alias("status"),
        F.col("ts").alias("finished_at"),
        F.concat(F.lit("k"), (F.col("event_id") % 50).cast("string")).alias("cache_key"),
        "value",
    )


_SQL_SUFFIXES = ", ".join("'" + s.replace("\n", "' || chr(10) || '").replace("\u0007", "' || chr(7) || '") + "'" for s in SUFFIXES)

#: The same views for DuckDB; a query's oracle names those it needs.
SQL = {
    "v_block": """v_block AS (
        SELECT doc_id, page_id, printf('%s.b%03d', page_id, pos + 1) AS block_id, pos,
               CASE WHEN pos = 0 AND length(text) <= 40 THEN 'heading' ELSE 'paragraph' END AS kind, text
        FROM (SELECT doc_id, printf('p%04d', doc_id) AS page_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS text
              FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(text) <> '')""",
    "v_defect": f"""v_defect AS (
        SELECT doc_id, page_id, block_id, pos, kind, text || ([{_SQL_SUFFIXES}])[(doc_id + pos) % {len(SUFFIXES)} + 1] AS text FROM v_block)""",
    "v_word": """v_word AS (
        SELECT doc_id, page_id, block_id, pos, wpos, printf('%s.w%04d', block_id, wpos) AS word_id, word,
               50 + (wpos * 37) % 480 AS x0, 40 + 14 * pos AS y0, 50 + (wpos * 37) % 480 + 6 * length(word) AS x1, 50 + 14 * pos AS y1
        FROM (SELECT doc_id, page_id, block_id, pos, CAST(unnest(range(len(l))) AS INTEGER) AS wpos, unnest(l) AS word
              FROM (SELECT *, string_split(text, ' ') AS l FROM v_block)))""",
    "v_event": """v_event AS (
        SELECT event_id, user_id AS run_id, event_type AS stage_name,
               CASE WHEN event_id % 7 = 0 THEN 'failed' WHEN event_id % 5 = 0 THEN 'cached' ELSE 'completed' END AS status,
               ts AS finished_at, 'k' || CAST(event_id % 50 AS VARCHAR) AS cache_key, value FROM events)""",
}


def with_views(*names: str) -> str:
    """A WITH clause of these views (and those they need), to be followed by a comma or a SELECT."""
    need = list(names)
    if {"v_defect", "v_word"} & set(need) and "v_block" not in need:
        need.insert(0, "v_block")
    need.sort(key=list(SQL).index)
    return "WITH " + ", ".join(SQL[n] for n in need)
