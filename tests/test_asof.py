"""Nearest rows against all pairs; characters' gaps, with spans that overlap or are in no order."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.operators import asof, runs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nearest_like_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("abc"), rng.choice([None, *range(20)])) for i in range(120)]
    others = [(rng.choice("ab"), rng.choice([None, *range(0, 20, 3)]), k) for k in range(25)]
    left = spark.createDataFrame(rows, "id int, g string, x int")
    right = spark.createDataFrame(others, "g string, y int, k int")
    found = asof.nearest(left, right, ["g"], F.col("x"), F.col("y"), ["k"]).collect()
    want = {}
    for i, g, x in rows:
        near = [(abs(x - y), k) for h, y, k in others if h == g and y is not None and x is not None]
        want[i] = min(near) if near else None
    assert len(found) == len(rows) and {r["id"]: tuple(r["near"]) if r["near"] else None for r in found} == want


def lines(seed):
    rng = random.Random(seed)
    spans = [("p", rng.randrange(4), f"s{k}", "".join(rng.choice("abc é") for _ in range(rng.randrange(0, 12))), a := rng.randrange(0, 400), a + rng.randrange(0, 90)) for k in range(40)]
    icons = [("p", rng.randrange(5), f"i{k}", rng.randrange(-20, 500) / 2) for k in range(60)]
    return spans, icons


@pytest.mark.parametrize("width", [7.0, 64.0])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_gaps_like_all_characters(spark, seed, width):
    spans, icons = lines(seed)
    df = spark.createDataFrame(spans, "page_id string, line int, span_id string, text string, x0 int, x1 int"), spark.createDataFrame(icons, "page_id string, line int, icon_id string, x double")
    found = {r["icon_id"]: (r["span_id"], r["offset"]) for r in asof.gaps(*df, width).collect()}
    places = {}
    for _, line, icon, x in icons:
        every = [(abs(x - (a + i / len(t) * (b - a))), a, s, i) for _, own, s, t, a, b in spans if own == line and t for i in range(len(t) + 1)]
        if every:
            places[icon] = min(every)
    assert set(found) == set(places)
    for icon, (distance, _, span, offset) in places.items():
        text, a, b = next((t, a, b) for _, _, s, t, a, b in spans if s == found[icon][0])
        x = next(x for _, _, i, x in icons if i == icon)
        assert abs(x - (a + found[icon][1] / len(text) * (b - a))) == pytest.approx(distance, abs=1e-9)
        assert found[icon] == (span, offset) or distance > 0  # other gaps only where sums of floats part equally near ones


def test_pieces_and_icons_make_the_text_again(spark):
    spans, icons = lines(5)
    df = spark.createDataFrame(spans, "page_id string, line int, span_id string, text string, x0 int, x1 int"), spark.createDataFrame(icons, "page_id string, line int, icon_id string, x double")
    rows = asof.icons_in_text(*df).orderBy("span_id", "nth").collect()
    text, at = {}, {}
    for r in rows:
        if r["type"] == "text":
            text[r["span_id"]] = text.get(r["span_id"], "") + r["text"]
        else:
            at[r["icon_id"]] = (r["span_id"], len(text.get(r["span_id"], "")))
    assert text == {s: t for _, _, s, t, _, _ in spans if t}
    assert at == {r["icon_id"]: (r["span_id"], r["offset"]) for r in asof.gaps(*df).collect()}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_gaps_exchange_lines_once(spark):
    """Both sides meet in one exchange, packed by line; null keys and ids, and rows of one id, stay together."""
    spans = [(p, 1, s, "abcd", a, a + 24) for p in ("p", None) for s, a in (("s", 0), (None, 40), ("s", 80))]
    icons = [(p, 1, i, x) for p in ("p", None) for i, x in (("i", 3.0), ("i", 41.0), (None, 100.0), ("none", None))]
    df = spark.createDataFrame(spans, "page_id string, line int, span_id string, text string, x0 int, x1 int"), spark.createDataFrame(icons, "page_id string, line int, icon_id string, x double")
    found = asof.gaps(*df)
    assert exchanges(found) == 1
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(p, 1, *r) for p in ("p", None) for r in (("i", None, 0), (None, "s", 3))], key=str)


@pytest.mark.parametrize("size", [1, 2, 7, 100])
def test_groups_stay_whole_over_batches(size):
    keys = [k for k in "aabbbbbbbcdddeeeeeeeeeeef"] + [None] * 3
    table = pa.table({"k": pa.array(keys), "v": list(range(len(keys)))})
    cut = list(runs.whole_groups(iter(table.to_batches(max_chunksize=size)), ["k"]))
    assert [v for b in cut for v in b.column("v").to_pylist()] == list(range(len(keys)))
    assert all(not set(a.column("k").to_pylist()) & set(b.column("k").to_pylist()) for a, b in zip(cut, cut[1:], strict=False))


def test_icons_in_text_exchange_lines_once(spark):
    """Spans and icons meet in one exchange; several icons of a gap stand by x, then by id, and a span without icons is one piece."""
    spans = [("p", 1, "s", "añ😀d", 0, 40), ("p", 1, "t", "plain", 100, 150), ("p", 2, "e", "", 0, 9), ("p", 2, "n", None, 0, 9)]
    icons = [("p", 1, "i2", 20.0), ("p", 1, "i1", 20.0), ("p", 1, "i0", 21.0), ("p", 1, "end", 60.0), ("p", 2, "alone", 1.0)]
    df = spark.createDataFrame(spans, "page_id string, line int, span_id string, text string, x0 int, x1 int"), spark.createDataFrame(icons, "page_id string, line int, icon_id string, x double")
    found = asof.icons_in_text(*df)
    assert exchanges(found) == 1
    rows = sorted((r["span_id"], r["nth"], r["type"], r["text"] or r["icon_id"]) for r in found.collect())
    cut = [("text", "añ"), ("icon", "i1"), ("icon", "i2"), ("icon", "i0"), ("text", "😀d"), ("icon", "end")]
    assert rows == [*(("s", n, *c) for n, c in enumerate(cut)), ("t", 0, "text", "plain")]
