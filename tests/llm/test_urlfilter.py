"""URL rules, and trust and distrust over hosts, against plain Python and the oracle SQL."""

import re

import duckdb
import numpy as np
import pytest

from folio.llm import urlfilter
from tests.llm.fixtures import clashing

SCHEMA = "page_id long, url string, html string"


def link(*targets):
    return "".join(f'<p><a class="x" href="{t}">t</a>' for t in targets)


def web():
    rows = [
        ("http://a.org/fr/1", link("//good.example/1", "/own")),
        ("http://a.org/fr/2", link("https://good.example/2", "https://good.example/3")),
        ("HTTP://A.ORG/en/", link("http://Good.Example/2")),
        ("http://good.example/x", link("http://next.example")),
        ("http://next.example/", None),
        ("http://spam.net/a", link("http://farm.example/")),
        ("http://spam.net/b", ""),
        ("http://farm.example/1", link("http://spam.net/a", "http://spam.net/b")),
        ("http://farm.example/2", "<AREA shape=x HREF = '//SPAM.net'>"),
        ("http://shady.example/", link("http://farm.example/1")),
        ("http://plain.example/", "<a href=//plain.example/2>own</a>"),
        ("http://x.example.com/de/1", link("http://good.example")),
        ("http://x.example.com/en/1", ""),
        ("http://x.example.net/en/1", None),
        ("http://example.net?q", None),
        ("http://notexample.net/en/1", None),
        ("net/en/1", "x"),
        (None, "y"),
        ("a://net/#f", None),
        ("http://u.net:80/a/b?c=/d#/e", None),
        ("\nhttp://late.net/p\nq?x", None),
        ("", ""),
    ]
    return [(i, *r) for i, r in enumerate([*rows, rows[0], rows[-1]])] + [(None, "http://a.org/es/", None)]


def parts(url):
    found = re.match(r"^.*?://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = found.groups() if found else ("", "")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    fit = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name), default=None)


def plain(rows):
    """The same by dense matrices: dangling mass goes back to the seeds."""
    pages, good, bad, edges = {}, {}, {}, {}
    for _, url, html in rows:
        host, path = parts(url)
        if host:
            rule = ruled(host, path)
            pages[host] = pages.get(host, 0) + 1
            for seeds, verdict in ((good, "allow"), (bad, "block")):
                seeds[host] = seeds.get(host, 0) + (rule is not None and rule.verdict == verdict)
            for to in {t.lower() for t in re.findall(r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'<>\s]*)""", html or "")} - {host, ""}:
                edges[host, to] = edges.get((host, to), 0) + 1
    hosts = sorted({*pages, *(h for e in edges for h in e)})
    way = np.zeros((len(hosts), len(hosts)))
    for (a, b), n in edges.items():
        way[hosts.index(a), hosts.index(b)] = n
    scores = []
    for seeds, w in ((good, way), (bad, way.T)):
        s = np.array([seeds.get(h, 0) for h in hosts], float)
        out = w.sum(axis=1)
        share, x = np.divide(w, out[:, None], where=out[:, None] > 0, out=np.zeros_like(w)), s
        for _ in range(400):
            x = 0.15 * s + 0.85 * (share.T @ x) + 0.85 * x[out == 0].sum() * s / s.sum()
        scores.append(dict(zip(hosts, x, strict=True)))
    verdict = {h: "block" if scores[1][h] - scores[0][h] > 0.5 * n else "allow" for h, n in pages.items()}
    return scores, verdict


def test_against_dense_matrices_and_sql(spark):
    rows = web()
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    (trust, distrust), verdict = plain(rows)
    found = {r["host"]: r for r in urlfilter.host_scores(df).collect()}
    assert set(found) == set(verdict)
    for host, r in found.items():
        assert r["trust"] == pytest.approx(trust[host], abs=2e-3) and r["distrust"] == pytest.approx(distrust[host], abs=2e-3)
    assert verdict["farm.example"] == "block" and verdict["good.example"] == verdict["plain.example"] == "allow" and "shady.example" in verdict
    judged = sorted((tuple(r) for r in urlfilter.judge(df).collect()), key=str)
    want = []
    for i, url, _ in rows:
        host, path = parts(url)
        rule = ruled(host, path)
        want.append((i, host, path, rule and rule.name, rule.verdict if rule else verdict.get(host, "allow")))
    assert judged == sorted(want, key=str)
    with duckdb.connect() as c:
        c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
        c.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
        assert sorted(c.execute(urlfilter.ORACLE).fetchall(), key=str) == judged


def test_of_equally_long_rules_one_that_blocks(spark):
    rules = (urlfilter.Rule("allow", "b.c", "/x"), urlfilter.Rule("block", "c", "/x/y"), urlfilter.Rule("block", "b.c", "/x"))
    df = spark.createDataFrame([(1, "h://a.b.c/x/y", None), (2, "h://b.c/x", None)], SCHEMA)
    assert [r["rule"] for r in urlfilter.judge(df, rules).orderBy("page_id").collect()] == ["c/x/y", "b.c/x"]


def test_no_seeds(spark):
    df = spark.createDataFrame([(1, "h://a/x", link("//b")), (2, "h://b", link("//a"))], SCHEMA)
    assert {r["verdict"] for r in urlfilter.judge(df).collect()} == {"allow"}
