"""Near texts against all pairs."""

import random

import pytest

from folio.operators import memory


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, n):
    for _ in range(n):
        at = rng.randrange(len(text) + 1)
        text = rng.choice([text[:at] + rng.choice("abé") + text[at:], text[:at] + text[at + 1 :], text[:at] + rng.choice("abé") + text[at + 1 :]])
    return text


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_all_pairs_within_some_edits(spark, most):
    rng = random.Random(most)
    base = ["".join(rng.choice("ab c") for _ in range(rng.randrange(0, 30))) for _ in range(40)]
    known = [*base, "", None, "short", "aaaaaaaaaaaaaaaaaaaa"]
    asked = [edited(rng, rng.choice(base), rng.randrange(5)) for _ in range(150)] + ["", None, "short", "shart", "aaaaaaaaaaaaaaaaaaa", base[0]]
    table = lambda rows: spark.createDataFrame([(t,) for t in rows], "text string")
    found = memory.near_texts(table(asked), table(known), most)
    want = set()
    for a in {t for t in asked if t is not None}:
        for b in {t for t in known if t is not None}:
            d = distance(a, b)
            if a == b or (d <= most and min(len(a), len(b)) >= memory.LEAST_LENGTH):
                want.add((a, b, d))
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want) and len(want) > 10


def test_the_nearest_with_a_translation(spark):
    kept = [(1, "the same sentence", "one"), (2, "the same sentence", "two"), (3, "the same sentenca", ""), (4, "another sentence!", "four"), (5, "tiny", "five")]
    segments = [(10, "the same sentence"), (11, "the same sentenca"), (12, "nothing like these"), (13, "tiny"), (14, "tinx"), (15, None), (16, "another sentence?")]
    found = memory.recall(spark.createDataFrame(segments, "segment_id int, text string"), spark.createDataFrame(kept, "segment_id int, text string, target string"))
    assert sorted(map(tuple, found.collect())) == [(10, 1, 0, "one"), (11, 1, 1, "one"), (13, 5, 0, "five"), (16, 4, 1, "four")]
