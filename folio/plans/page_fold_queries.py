"""Registered queries over folds and placements of a page, each with oracle SQL by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import asof, page_fold
from folio.plans.queries import query
from folio.sources import views
from folio.sources.views import with_views

_SPANS = """s AS (SELECT page_id, pos, text, CASE pos % 9 WHEN 5 THEN 'heading' WHEN 7 THEN 'decorative' WHEN 2 THEN 'table' ELSE 'body' END AS cls,
    10.0 + pos % 3 AS size, 14.0 * pos + 30 * (pos // 4) AS y0, 14.0 * pos + 30 * (pos // 4) + 10 AS y1 FROM v_block)"""


@query(f"""{with_views('v_block')}, {_SPANS}, n AS (SELECT *, lag(cls) OVER w AS before, lag(y1) OVER w AS above FROM s WHERE cls <> 'decorative' WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
    g AS (SELECT *, sum(CASE WHEN cls = 'body' AND before = 'body' AND abs(y0 - above) <= 1.5 * size THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS nth FROM n),
    b AS (SELECT page_id, nth, any_value(cls) AS cls, any_value(size) AS size, min(y0) AS y0, max(y1) AS y1, any_value(regexp_matches(trim(text), '^\\d{{1,3}}[.):]*$')) AS step, count(*) AS n FROM g GROUP BY 1, 2),
    k AS (SELECT *, CASE cls WHEN 'body' THEN 'paragraph' WHEN 'heading' THEN CASE WHEN step THEN 'list_item' ELSE 'heading' END ELSE cls END AS kind FROM b),
    l AS (SELECT page_id, nth, CAST(least(1 + dense_rank() OVER (PARTITION BY page_id ORDER BY size DESC), 6) AS INTEGER) AS level FROM k WHERE kind = 'heading')
    SELECT page_id, printf('%s.b%03d', page_id, CAST(nth AS BIGINT)) AS block_id, kind, level, CAST(y0 AS DOUBLE) AS y0, CAST(y1 AS DOUBLE) AS y1 FROM k LEFT JOIN l USING (page_id, nth)""")
def structure_page_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as spans: every ninth a heading, a table's or decoration, and a gap after every fourth."""
    nth = F.col("pos") % 9
    cls = F.when(nth == 5, "heading").when(nth == 7, "decorative").otherwise("body")
    y0 = 14.0 * F.col("pos") + 30 * F.expr("pos div 4")
    table = F.when(nth == 2, F.expr("pos div 9").cast("int"))
    spans = views.blocks(spark, sf_dir).select("page_id", "pos", "text", cls.alias("role"), table.alias("table_region"), (10.0 + F.col("pos") % 3).alias("font_size"), F.lit(50.0).alias("x0"), y0.alias("y0"), F.lit(500.0).alias("x1"), (y0 + 10).alias("y1"))
    return page_fold.fold_pages(spans, finish=False).select("page_id", "block_id", "kind", "level", "y0", "y1")


@query(f"""{with_views('v_word')}, w AS (SELECT page_id, block_id AS line, word_id, word, x0, x1, length(word) > 9 AS icon FROM v_word),
    i AS (SELECT page_id, line, word_id AS icon_id, (x0 + x1) / 2.0 AS x FROM w WHERE icon), t AS (SELECT * FROM w WHERE NOT icon AND word <> ''),
    c AS (SELECT page_id, line, word_id, x0, i AS "offset", x0 + 6.0 * i AS g FROM (SELECT *, unnest(range(length(word) + 1)) AS i FROM t)),
    b AS (SELECT i.page_id, i.line, icon_id, x, min((abs(x - g), CAST(x0 AS DOUBLE), word_id, "offset")) AS best FROM i JOIN c USING (page_id, line) GROUP BY ALL)
    SELECT page_id, line, icon_id, best[3] AS span_id, CAST(best[4] AS INTEGER) AS "offset" FROM b""")
def structure_icon_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long words as icons, short ones as spans; a block is a line."""
    words = views.words(spark, sf_dir).withColumn("line", F.col("block_id"))
    icon = F.length("word") > 9
    spans = words.where(~icon).select("page_id", "line", F.col("word_id").alias("span_id"), F.col("word").alias("text"), "x0", "x1")
    return asof.gaps(spans, words.where(icon).select("page_id", "line", F.col("word_id").alias("icon_id"), ((F.col("x0") + F.col("x1")) / 2).alias("x")))


@query(f"""{with_views('v_word')}, w AS (SELECT page_id, block_id AS line, word_id, word, x0, x1, length(word) > 9 AS icon FROM v_word),
    i AS (SELECT page_id, line, word_id AS icon_id, (x0 + x1) / 2.0 AS x FROM w WHERE icon), t AS (SELECT * FROM w WHERE NOT icon),
    c AS (SELECT page_id, line, word_id, x0, i AS o, x0 + 6.0 * i AS g FROM (SELECT *, unnest(range(length(word) + 1)) AS i FROM t WHERE word <> '')),
    b AS (SELECT page_id, line, icon_id, x, best[3] AS word_id, best[4] AS o FROM (SELECT i.page_id, i.line, icon_id, x, min((abs(x - g), CAST(x0 AS DOUBLE), word_id, o)) AS best FROM i JOIN c USING (page_id, line) GROUP BY ALL)),
    e AS (SELECT page_id, line, word_id, o, x, icon_id FROM b UNION ALL SELECT page_id, line, word_id, length(word), 1e9, NULL FROM t),
    p AS (SELECT e.page_id, e.line, e.word_id, e.o, x, icon_id, substring(word, CAST(coalesce(lag(e.o) OVER v, 0) + 1 AS BIGINT), CAST(e.o - coalesce(lag(e.o) OVER v, 0) AS BIGINT)) AS piece FROM e JOIN t USING (page_id, line, word_id) WINDOW v AS (PARTITION BY e.page_id, e.line, e.word_id ORDER BY e.o, x, icon_id)),
    r AS (SELECT page_id, line, word_id, o, x, icon_id, 0 AS k, 'text' AS type, piece AS text, NULL AS icon FROM p WHERE piece <> '' UNION ALL SELECT page_id, line, word_id, o, x, icon_id, 1, 'icon', NULL, icon_id FROM p WHERE icon_id IS NOT NULL)
    SELECT page_id, line, word_id AS span_id, CAST(row_number() OVER (PARTITION BY page_id, line, word_id ORDER BY o, x, icon_id, k) - 1 AS INTEGER) AS nth, type, text, icon AS icon_id FROM r""")
def structure_icons_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = views.words(spark, sf_dir).withColumn("line", F.col("block_id"))
    icon = F.length("word") > 9
    spans = words.where(~icon).select("page_id", "line", F.col("word_id").alias("span_id"), F.col("word").alias("text"), "x0", "x1")
    return asof.icons_in_text(spans, words.where(icon).select("page_id", "line", F.col("word_id").alias("icon_id"), ((F.col("x0") + F.col("x1")) / 2).alias("x")))
