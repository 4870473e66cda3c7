"""Operators 1 and 2."""

import time

import numpy as np
import pytest

from folio.llm import ann, html_extract
from tests.llm.fixtures import clashing

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) { w("<p>x</p>") }</script><style>p{}</style></head><body>
<header class="site-header"><h1>Site</h1><nav><ul><li><a href=/>Home</a></li></ul></nav></header><!-- <p>gone</p> -->
<div class="cookie-notice">We use cookies</div><div id="content"><h1>The   big
title</h1><p>First para with <a href=x>a link</a> and&nbsp;more &lt;b&gt; text<br>that goes on and on.<p>Unclosed one &amp; two
<div class="ad-slot">Buy now</div><ul><li>item one<li>item two</ul><form><label>Mail</label><input></form></div>
<div class="sidebar"><p>Other story</p></div><section id="comments"><p>Great article, thanks so much for writing all of this.</p></section>
<footer>&copy; x</footer></body></html>"""
TEXT = "The big title\nFirst para with a link and more <b> text that goes on and on.\nUnclosed one & two\nitem one\nitem two"


def test_main_text(spark):
    marked = "<html><body><nav><a>menu</a></nav><article><h1>Head</h1><p>Body text here</p></article><footer>foot</footer></body></html>"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", marked), (4, "u", marked), (5, "u", "no tags at all"), (6, "u", "<<p <> &am &#x41; >"), (7, "u", "<p>" + "long text " * 20000)]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    found = html_extract.main_text(pages, html_extract.fit(pages)).collect()
    assert html_extract.extract('<p>before</p><svg width="1"/><iframe src="x" /><p>after <script>if (a > b) {}</script>it</p><select><option>no</select>', html_extract.fit(pages)) == "before\nafter it"
    by = {r["page_id"]: r["text"] for r in found}
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    assert by[1] == TEXT and by[2] == by[3] == "" and by[4] == "Head\nBody text here" and by[5] == "no tags at all"
    assert by[7] == ("long text " * 20000).strip()
    assert html_extract.main_text(pages.where("false"), html_extract.fit(pages.where("false"))).count() == 0


def brute_largest(scores):
    """The largest sum of any contiguous run."""
    return max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)), default=0.0)


def test_region_has_the_largest_sum():
    rng = np.random.default_rng(0)
    for n in range(60):
        scores = rng.normal(-0.2, 1.0, int(rng.integers(0, 40))).tolist()
        start, end = html_extract.largest_sum(scores)
        assert sum(scores[start:end]) == pytest.approx(brute_largest(scores), abs=1e-12)
        assert start < end or brute_largest(scores) == 0.0


def random_page(rng):
    kinds = ["<p>{}</p>", "<nav><ul><li><a>{}</a></li></ul></nav>", "<div>{}</div>", "<div class=ad>{}</div>", "<table><tr><td><a>{}</a></td></tr></table>", "<span> {} </span>", "<footer>{}</footer>"]
    return "".join(kinds[int(rng.integers(0, len(kinds)))].format(" ".join(f"w{rng.integers(0, 99)}" for _ in range(int(rng.integers(1, 9))))) for _ in range(12))


def test_the_scan_decides():
    """The text is that of the run with the largest sum, and differs from all words that score positive on many pages."""
    rng = np.random.default_rng(1)
    weights = html_extract.weights_from([])
    other = 0
    for _ in range(100):
        page = random_page(rng)
        items = list(html_extract.events(page, weights))
        scores = html_extract.scores_of(items, weights)
        start, end = html_extract.largest_sum(scores)
        assert sum(scores[start:end]) == pytest.approx(brute_largest(scores), abs=1e-9)
        words = lambda run: [w for e in run if e.tag is None and weights.word(e.place) > 0 for w in e.text.split()]
        assert html_extract.extract(page, weights).split() == words(items[start:end])
        other += words(items) != words(items[start:end])
    assert other > 20


def test_learned_weights_decide(spark):
    """Classes that no list has: the table's own pages teach what they hold."""
    page = lambda k: f"<html><body><div class=qx{k % 3}>" + " ".join(f"menu{i}" for i in range(9)) + f"</div><article><div class=zz>Body of page {k} with some more words</div></article><div class=vv>Other stories of the day</div></body></html>"
    rows = [(k, f"u{k}", page(k)) for k in range(40)]
    weights = html_extract.fit(spark.createDataFrame(rows, "page_id long, url string, html string"))
    unmarked = page(7).replace("<article>", "").replace("</article>", "")
    assert html_extract.extract(unmarked, weights) == "Body of page 7 with some more words"
    assert html_extract.extract(unmarked, html_extract.weights_from([])) != "Body of page 7 with some more words"


def test_malformed_and_long_pages():
    weights = html_extract.weights_from([])
    began = time.process_time()
    for page in ("</" * 500_000, "<div>" * 20_000, "<b><div>" * 5_000 + "</b>" * 5_000, '<a "' * 50_000, "<script>" * 100_000, "<p><b>" * 10_000):
        html_extract.extract(page, weights)
        html_extract.label_counts(page)
    assert time.process_time() - began < 15
    nested = "".join(f"<div class=c{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}>" for k in range(100)) + "<div class=ad><p>Buy now</p></div><p>Text of the page.</p>"
    assert html_extract.extract(nested, weights) == "Text of the page."
    assert html_extract.extract("<article><p>Let <math><mi>x</mi> <mo>=</mo> <mn>2</mn></math> be so.</p></article>", weights) == "Let x = 2 be so."


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(600, 48))
    v[100:160] = v[100]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    rows += [(1000, None), (1020, [0.0] * 48), (1040, [None] + [1.0] * 47), (1060, [float("nan")] + [1.0] * 47), (1080, [float("inf")] + [1.0] * 47), (1100, [1.0, 2.0]), (None, [1.0] * 48), (41, rows[41][1])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = ann.search(df, k=20).collect()
    ids = np.array([*range(600), 41])
    whole = np.concatenate([v, v[41:42]])
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 600, 20))
    hits = total = 0
    for q, rows_ in got.items():
        scores = whole @ v[q]
        order = [k for k in np.lexsort((ids, -np.round(scores, 9))) if ids[k] != q][:20]
        rows_.sort()
        assert [r[0] for r in rows_] == list(range(1, 21))
        assert all(abs(r[2] - v[r[1]] @ v[q]) < 1e-9 for r in rows_)
        hits += len({ids[k] for k in order} & {r[1] for r in rows_})
        total += len({ids[k] for k in order})
    assert hits / total > 0.97
    few = ann.search(df.where("vec_id < 5"), every=2)
    assert few.count() == 3 * 4
    assert ann.search(df.where("false")).count() == 0


def test_repeated_vectors(spark):
    """Equal rows are candidates and queries each; a query leaves out its own row only."""
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 2.0]), (7, [3.0, 1.0]), (7, [3.0, 1.0]), (5, [0.5, -0.0]), (40, [1.0, 1.0])]
    for kind in ("float", "double"):
        found = ann.search(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), k=4).collect()
        expected = []
        for n, (q, x) in enumerate(rows):
            if q % 20 == 0:
                others = sorted((-(x[0] * y[0] + x[1] * y[1]), i) for m, (i, y) in enumerate(rows) if m != n)[:4]
                expected += [(q, rank, i, -score + 0.0) for rank, (score, i) in enumerate(others, 1)]
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"] + 0.0) for r in found) == sorted(expected)


def test_error_bounds_hold():
    rng = np.random.default_rng(9)
    v, q = rng.normal(size=(500, 100)), rng.normal(size=(20, 100))
    codes = ann.OneBitCodes(100, v.mean(axis=0))
    estimate, error = codes.bounds(q, codes.prepared(*codes.encode(v)))
    assert (np.abs(estimate - q @ v.T) <= error).mean() > 0.999


def test_pages_of_other_shapes():
    weights = html_extract.weights_from([])
    text = lambda page: html_extract.extract(page, weights)
    lists = "<ul><li><a>menu1</a></li><li><a>menu2</a></li></ul><h1>Title</h1><p>The text body is here.</p><ul><li>point one</li><li>point two</li></ul><div class='alert alert-info'>We use cookies.</div>"
    assert text(lists) == "Title\nThe text body is here.\npoint one\npoint two"
    assert text('<form id="aspnetForm"><div class="content"><p>Content inside of a wrapping form.</p></div></form>') == "Content inside of a wrapping form."
    assert text("<header><h1>Site</h1></header><article><header><h1>Art title</h1></header><p>Content p.</p><aside><p>x</p></aside><p>More.</p></article>") == "Art title\nContent p.\nMore."
    assert text('<div role="navigation">nav</div><div role="main"><p>Main role text.</p></div><div role="complementary">side</div>') == "Main role text."
    assert text('<main><p>Body.</p></main><section class="comments"><article class="comment"><p>nice one, thanks a lot for it</p></article></section>') == "Body."
    assert text('<div class="post"><div class="post-header"><h1>Head</h1></div><div class="post-content"><p>Text a.</p></div><div class="share-buttons">Share</div></div>') == "Head\nText a."
