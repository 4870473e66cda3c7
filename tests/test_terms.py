"""The dictionary automaton against a regular expression for each form; whole and in shards."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import terms


def plain(blocks, forms):
    out = []
    for page, block, text in blocks:
        low, taken = (text or "").lower(), set()
        for concept, form in sorted({(c, f.lower()) for c, f in forms if re.search(r"[^\W_]", f)}, key=lambda t: (-len(t[1]), t[1], t[0])):
            for m in re.finditer(rf"(?<!\w){re.escape(form)}(?!\w)", low):
                if not taken & set(range(*m.span())):
                    taken |= set(range(*m.span()))
                    out.append((page, block, *m.span(), concept))
    return sorted(out)


def case():
    rng = random.Random(2)
    words = ["fire", "ball", "fire ball", "ice", "été", "x-ray", "a_b", "ray", "b", "42"]
    blocks = [("p%d" % (i % 5), f"b{i}", "".join(rng.choice(words).title() + rng.choice([" ", ", ", "-", "_", ""]) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    blocks += [("q", "none", None), ("q", "empty", ""), ("q", "edge", "fire fire fire ball")]
    forms = [("c1", "Fire"), ("c2", "fire ball"), ("c3", "ball"), ("c4", "FIRE"), ("c5", "fire fire"), ("c6", "ÉTÉ"), ("c7", "x-ray"), ("c8", "a_b"), ("c9", "(b"), ("c10", "..."), ("c11", ""), ("c12", "ice, ice"), ("c1", "fire"), ("c13", "-ray")]
    return blocks, forms


@pytest.mark.parametrize("most_chars", [terms.MOST_CHARS, 12])
def test_same_rows_as_one_pattern_a_form(spark, most_chars):
    blocks, forms = case()
    df = spark.createDataFrame(blocks, "page_id string, block_id string, text string")
    found = terms.match_terms(df, spark.createDataFrame(forms, "concept_id string, form string"), most_chars)
    want = plain(blocks, forms)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 60


def test_no_forms(spark):
    df = spark.createDataFrame([("p", "b", "text")], "page_id string, block_id string, text string")
    assert terms.match_terms(df, spark.createDataFrame([], "concept_id string, form string")).count() == 0


def test_a_pass_takes_no_longer_with_more_forms():
    """Steps of the automaton, counted by its hits: forms that a text doesn't hold cost nothing."""
    text = " ".join(f"w{i}" for i in range(2000))
    few, many = terms.automaton([("w5", "a"), ("w6 w7", "b")]), terms.automaton([("w5", "a"), ("w6 w7", "b"), *((f"zz{i} y", str(i)) for i in range(5000))])
    assert terms.hits(few, text) == terms.hits(many, text) and len(terms.hits(few, text)) == 2


@pytest.mark.parametrize(("text", "want"), [("sym", "Sym"), ("ßSCHZuchen", "Ssschzuchen"), ("éTÉ", "Été"), ("ǆX", "ǅx"), ("ﬁRE", "Fire"), ("", ""), ("1A", "1a"), ("x", "X"), (None, None)])
def test_capitalized_like_python(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.capitalized(F.col("t"))).first()[0] == want == (text.capitalize() if text is not None else None)
