"""Pages of over 999 lines, whose block ids have four digits, against the oracle SQL."""

import duckdb

import folio.plans.page_queries  # noqa: F401  it registers queries and oracles
from folio.plans.queries import ORACLES, QUERIES


def test_messages_of_a_page_of_over_999_lines(spark, tmp_path):
    texts = ["\n".join(f"line {i}" for i in range(1012)), "A heading\n\n \none\ntwo", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "line " * 5)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT page_id, batch, batch_id, n, first FROM ({ORACLES['translation_messages']})").fetchall()
    found = QUERIES["translation_messages"](spark, str(tmp_path)).select("page_id", "batch", "batch_id", "n", "first").collect()
    assert sorted(map(tuple, found)) == sorted(want) and len(want) == 204
    assert ("p0000", 199, "p0000.199", 5, "p0000.b1000") in want
