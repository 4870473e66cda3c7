"""Concepts whose lemma has one or two characters are mentioned like any other."""

from folio.operators.translate import plan_segments


def test_short_lemmas_are_mentioned(spark):
    texts = ["Power OF x", "a", "it", "office", "", "É-1"]
    blocks = spark.createDataFrame([("p", f"b{i}", i, "paragraph", t) for i, t in enumerate(texts)], "page_id string, block_id string, pos int, kind string, text string")
    lemmas = ["of", "A", "x", "é", "it", "off", "power of"]
    concepts = spark.createDataFrame([(f"c.{w}", w) for w in lemmas], "concept_id string, lemma string")
    found = {r["segment_id"]: r["concept_ids"] for r in plan_segments(blocks, concepts).collect()}
    assert found == {f"b{i}": sorted(f"c.{w}" for w in lemmas if w.lower() in t.lower()) for i, t in enumerate(texts) if t}
