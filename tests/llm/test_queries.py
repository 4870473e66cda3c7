"""Every registered query over small tables with awkward rows, and over empty tables."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folio.llm.queries import queries
from tests.llm.fixtures import clashing, documents, texts

COLUMNS = {
    "op1_main_text": ("page_id", "url", "text", "n_chars"),
    "op2_one_bit_neighbours": ("query_id", "rank", "vec_id", "score"),
    "op3_interpolated_lm": ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"),
    "op4_simhash_groups": ("doc_id", "fingerprint", "component_id"),
    "op5_prefix_bpe": ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"),
    "op6_secret_scan": ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"),
    "op7_addressable_tokens": ("doc_id", "start", "n_tokens", "ids_crc32"),
    "op8_squares_packing": ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"),
    "op9_conv_langid": ("doc_id", "held_out", "lang_pred", "score"),
    "op10_decision_list": ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"),
    "op11_link_trust": ("page_id", "host", "path", "rule", "verdict"),
    "op12_prefix_trie": ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"),
    "op13_tiled_phrases": ("lang", "rank", "phrase", "a", "l", "r", "n", "score"),
}
PAGES = [(1, "u", "<article><p>Some text</p></article><nav>x</nav>"), (2, None, None), (None, "u", "")]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for kind in ("full", "empty"):
        home = tmp_path_factory.mktemp(kind)
        keep = "true" if kind == "full" else "false"
        tables = {
            "documents": documents(spark),
            "pages": spark.createDataFrame(PAGES, "page_id long, url string, html string"),
            "embeddings": spark.createDataFrame([(i, [float(i % 7), 1.0, float(-i)], 0) for i in range(60)], "vec_id long, embedding array<float>, label int"),
            "conversations": spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, None, None), (2, None, "user", "hi"), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string"),
            "labels": spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 0, 1), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int"),
        }
        for name, df in tables.items():
            (clashing(df) if name != "labels" else df).where(F.expr(keep)).write.parquet(f"{home}/{name}.parquet")
        out[kind] = str(home)
    return out


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, folders, name):
    found = queries()[name](spark, folders["full"])
    assert set(COLUMNS[name]) <= set(found.columns)
    rows = found.collect()
    if "doc_id" in found.columns:
        assert sorted({str(r["doc_id"]) for r in rows}) == sorted({str(i) for i, _ in texts()})
        assert name == "op8_squares_packing" or len(rows) == len(texts())
    elif name in ("op1_main_text", "op11_link_trust"):
        assert len(rows) == len(PAGES)
    elif name == "op13_tiled_phrases":
        assert {r["lang"] for r in rows} == {"en"} and sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1))
    elif name == "op12_prefix_trie":
        assert sorted(r["depth"] for r in rows)[:1] == [0] and max(r["n_convs"] for r in rows) == 2
    else:
        assert len(rows) == 3 * 20
    if name in ("op3_interpolated_lm", "op9_conv_langid"):
        fold = 1 if name.startswith("op3") else 0
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == fold) for r in rows if r["doc_id"] is not None)
    empty = queries()[name](spark, folders["empty"])
    assert empty.count() == 0 and set(COLUMNS[name]) <= set(empty.columns)


def test_pipeline_over_empty_tables(spark, folders):
    assert corpus_pipeline.run(spark, folders["empty"]).count() == 0


def test_names():
    assert set(queries()) == set(COLUMNS)
