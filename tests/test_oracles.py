"""Every registered query with oracle SQL against DuckDB on the smallest tables."""

import math
import os
import re

import duckdb
import pandas as pd
import pytest

import folio.plans.fold_oracles
import folio.plans.page_queries  # noqa: F401  they register queries and oracles
from folio.functions import text as T
from folio.plans.queries import ORACLES, QUERIES
from folio.sources import views

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def comparable(df):
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        v = v.item() if hasattr(v, "item") else v
        if isinstance(v, float):
            return int(v) if v == int(v) else round(v, 9)
        return str(v) if isinstance(v, pd.Timestamp) else v

    df = df[sorted(df.columns)]
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_oracle(spark, duck, name):
    mine, theirs = QUERIES[name](spark, SF_DIR).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert comparable(mine) == comparable(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_glued_text_with_repeats_against_brute_force(spark):
    """DuckDB's patterns have no back references, so Python's are the oracle."""
    blocks = views.defects(spark, SF_DIR).select("page_id", "block_id", "text").collect()
    expected = set()
    for b in blocks:
        reason = next((name for name, pattern in T.GLUED if re.search(pattern, b["text"])), None)
        if reason:
            expected.add((b["page_id"], b["block_id"], reason))
    found = QUERIES["qa_glued_text_with_repeats"](spark, SF_DIR).collect()
    assert {(r["page_id"], r["entity_ref"], r["detail"]) for r in found} == expected and len(found) == len(expected)
    assert any(r == "repeat" for _, _, r in expected)
