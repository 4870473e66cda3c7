"""Words of documents counted where their texts arrive, without an aggregate of single words."""

from folio.operators import topk


def test_counted_words(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 2)
    rows = [(1, 3, ["a", "b", "a"]), (2, 1, ["é"]), (3, 2, ["b", "b"]), (None, 1, ["a"]), (4, 0, [])]
    found = topk._counted(spark.createDataFrame(rows, "key long, length int, terms array<string>"))
    assert {r["key"]: sorted(map(tuple, r["words"])) for r in found.collect()} == {1: [("a", 2), ("b", 1)], 2: [("é", 1)], 3: [("b", 2)], None: [("a", 1)], 4: []}
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
