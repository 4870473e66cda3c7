"""A page's fold: rules by example, and its finishing steps against the separate operators."""

import random

import pytest
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import page_fold, structure
from folio.operators.page_fold import Fonts, Limits

FONTS = Fonts(heading=["H"], decorative=["D"], bold="B", italic="I", bold_italic="BI", dingbat="Z")
SPAN = "page_id string, pos int, text string, font_name string, font_size double, x0 double, y0 double, x1 double, y1 double, table_region int"


def fold(spark, spans, icons=(), figures=(), **more):
    """spans: text, font, size, x0, y0, x1, [table]; all of page p."""
    rows = [("p", k, s[0], s[1], float(s[2]), float(s[3]), float(s[4]), float(s[5]), float(s[4]) + 10, s[6] if len(s) > 6 else None) for k, s in enumerate(spans)]
    box = "page_id string, pos int, symbol_id string, instance_id string, x0 double, y0 double, x1 double, y1 double"
    df = page_fold.with_roles(spark.createDataFrame(rows, SPAN), FONTS)
    out = page_fold.fold_pages(df, spark.createDataFrame(list(icons), box) if icons else None, spark.createDataFrame(list(figures), box) if figures else None, **more)
    return [(r["block_id"], r["kind"], r["level"], [c["text"] if c["type"] == "text" else f"<{c['type']}:{c['symbol_id'] or ''}>" for c in r["children"]]) for r in out.orderBy("pos").collect()]


def test_lines_become_blocks(spark):
    spans = [
        ("Title", "H", 16, 50, 40, 90), ("Part", "H", 12, 50, 60, 90), ("Sub", "B", 11, 50, 80, 90),
        ("A first ", "x", 9, 50, 100, 90), ("bold", "B", 9, 91, 100, 120), ("exam-", "x", 9, 130, 100, 150), ("ple.Next", "x", 9, 50, 112, 90),
        ("far below", "x", 9, 50, 160, 90), ("***", "D", 9, 50, 180, 90), ("•", "Z", 9, 50, 200, 55), ("an item", "x", 9, 60, 200, 90),
        ("1.", "H", 16, 50, 230, 60), ("page 3", "x", 9, 50, 795, 90), ("label", "H", 5, 50, 300, 60),
    ]
    assert fold(spark, spans, finish=False) == [
        ("p.b001", "heading", 1, ["Title"]),
        ("p.b002", "heading", 2, ["Part"]),
        ("p.b003", "heading", 3, ["Sub"]),
        ("p.b004", "paragraph", None, ["A first ", "bold", " example. Next"]),
        ("p.b005", "paragraph", None, ["far below"]),
        ("p.b006", "list_item", None, ["an item"]),
        ("p.b007", "list_item", None, ["1."]),
    ]


def test_levels_start_at_the_largest_heading(spark):
    spans = [("a", "H", 11, 0, 10, 20), ("b", "H", 9, 0, 40, 20), ("c", "H", 9, 0, 80, 20), ("body", "x", 9, 0, 120, 20), ("d", "H", 8, 0, 160, 20)]
    assert [(b[1], b[2]) for b in fold(spark, spans)] == [("heading", 2), ("heading", 3), ("heading", 3), ("paragraph", None), ("heading", 4)]


def test_tables_icons_and_figures(spark):
    spans = [("a", "x", 9, 0, 10, 10, 0), ("b", "x", 9, 20, 10, 30, 0), ("c", "x", 9, 0, 25, 10, 0), ("d", "x", 9, 0, 40, 10, 1), ("one two", "x", 9, 0, 100, 70), ("bold", "B", 9, 72, 100, 112), ("more", "x", 9, 0, 112, 40)]
    icons = [("p", 0, "s.first", "i1", -5.0, 100.0, 0.0, 108.0), ("p", 1, "s.mid", "i2", 60.0, 100.0, 66.0, 108.0), ("p", 2, "s.end", "i3", 60.0, 112.0, 66.0, 120.0), ("p", 3, "s.off", "i4", 60.0, 300.0, 66.0, 310.0)]
    figures = [("p", 0, "img1", None, 0.0, 400.0, 200.0, 500.0)]
    assert fold(spark, spans, icons, figures) == [
        ("p.b001", "table", None, ["a b", "<line_break:>", "c"]),
        ("p.b002", "table", None, ["d"]),
        ("p.b003", "paragraph", None, ["<icon:s.first>", "one two", "<icon:s.mid>", " bold", " more", "<icon:s.end>"]),
        ("p.b004", "figure", None, ["<figure:img1>"]),
    ]


def test_no_rows_and_blank_spans(spark):
    assert fold(spark, [(" ", "x", 9, 0, 10, 10), (None, "x", 9, 0, 40, 10)]) == []
    empty = spark.createDataFrame([], SPAN)
    assert page_fold.fold_pages(page_fold.with_roles(empty, FONTS)).count() == 0


def test_an_icon_is_kept_where_readers_see_it(spark):
    child = lambda i: page_fold.Child("icon", None, None, "s", i)
    blocks = [page_fold.Block("table", 1, None, [child("i"), child("j")]), page_fold.Block("paragraph", 2, None, [child("i"), child("i"), child(None)])]
    left = page_fold.one_icon_each(blocks)
    assert [[c.instance_id for c in b.children] for b in left] == [["j"], ["i", None]]


@pytest.mark.parametrize("seed", [1, 2])
def test_finishing_like_the_separate_operators(spark, seed):
    """List items, cuts and repeats of random pages, as the operators by page make them of the unfinished blocks."""
    rng = random.Random(seed)
    spans, y = [], 0
    for _ in range(60):
        y += rng.choice([12, 12, 12, 30, 60])
        kind = rng.random()
        text = rng.choice(["Same words here", "Some text. And more of it follows", "A sentence that is rather long. Then another one comes. " * rng.randrange(1, 5)]).strip()
        if kind < 0.2:
            spans.append((rng.choice(["3.", "12"]), "H", 9, 50, y, 60))
        elif kind < 0.35:
            spans += [("•", "Z", 9, 40, y, 45), (text, "x", 9, 50, y, 300)]
        else:
            spans.append((text, "x", 9, rng.choice([30, 50, 60]), y, 300))
    limits = Limits(most_chars=150)
    rows = [("p", k, s[0], s[1], float(s[2]), float(s[3]), float(s[4]) % 700, float(s[5]), float(s[4]) % 700 + 10, None) for k, s in enumerate(spans)]
    df = page_fold.with_roles(spark.createDataFrame(rows, SPAN), FONTS)
    text = F.array_join(F.transform("children", lambda c: c["text"]), "").alias("text")
    columns = ["page_id", "block_id", "pos", "kind", "x0", "y0", "x1", "y1", text]
    raw = page_fold.fold_pages(df, limits=limits, finish=False).select(*columns)
    cut = structure.split_long(structure.merge_list_continuations(raw), 150).withColumn("pos", F.col("pos") * 1000 + F.col("part"))
    want = structure.drop_repeated(cut.select("page_id", "block_id", "pos", "kind", "text"))
    got = page_fold.fold_pages(df, limits=limits).select(*columns)
    key = lambda d: [(r["kind"], r["text"].strip()) for r in d.orderBy("pos").collect()]
    found = key(got)
    assert found == key(want) and len(found) > 10


@pytest.mark.parametrize("text", ["exam- ple", "self- made and Non- zero", "one.Two!Three", "bell\u0007 x", "unself- made"])
def test_tidy_like_the_column(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(T.normalize(F.col("t"))).first()[0] == page_fold.tidy(text)
