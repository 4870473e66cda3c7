"""URL filters: rules by host and path, and for the other pages trust and distrust over the graph of hosts (operator 11).

Pages that a rule decides are the seeds. A host's trust is personalised PageRank from its allowed pages along links; its distrust is
the same from its blocked pages against the direction of links, so a host that links to blocked ones receives it. Both are counted in pages:
without links a host keeps exactly its own decided pages.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.dac import shared_folder

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Absolute and scheme-less targets of anchors; relative ones stay on their host and make no edge.
ANCHOR = r"""(?i)<(?:a|area)\s(?:[^>]*?\s)?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'<>\s]*)"""


#: Bytes of blocked hosts' names up to which they are broadcast to the pages.
MOST_BROADCAST = 8 << 20


class Rule(NamedTuple):
    """A verdict (allow or block) for a host with its subdomains and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host between the first ``://`` and the next ``/``, ``?``, ``#`` or end, and the path up to ``?``, ``#`` or end; both empty for a null url or one without ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, URL, k), F.lit(""))
    return lowered(part(1)), part(2)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (of equally long ones a blocking one), else nulls. An empty path starts with no rule's path."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block", r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: how many pages of one host link to another host."""
    host, _ = host_and_path(F.col("url"))
    found = F.when(F.contains("html", F.lit("//")), F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)))
    rows = pages.select(host.alias("src"), F.explode(F.array_distinct(F.transform(found, lowered))).alias("dst"))
    return rows.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def _flows(edges: DataFrame) -> DataFrame:
    """kind, giver, taker, share: trust goes along edges, distrust against them, each node's mass in proportion to the weights."""
    way = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("giver"), F.col(b).alias("taker"))
    ways = edges.select("weight", F.explode(F.array(way("trust", "src", "dst"), way("distrust", "dst", "src"))).alias("way")).select("way.*", "weight")
    total = ways.groupBy("kind", "giver").agg(F.sum("weight").alias("total"))
    return ways.join(total, ["kind", "giver"]).select("kind", "giver", "taker", (F.col("weight") / F.col("total")).alias("share"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, most_rounds: int = 200) -> DataFrame:
    """host, trust, distrust: personalised PageRank from seeds (host, trusted, blocked: numbers of pages), along the edges (src, dst, weight) and against them.

    Each of the two adds up to its seeds. What reaches a host without further links starts anew at the seeds: the sum of all walks is
    found without that, round by round, and scaled once. Rounds end when one adds less than ``tolerance`` of the mass; each is a
    join by giver and a sum by taker, and checkpointed. No seeds: no mass. A hub's edges are rows of their own, so a skewed join
    can be dealt anew, and sums are taken before they are sent.
    """
    shared_folder(edges.sparkSession)
    start = seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trusted").cast("double"), F.lit("distrust"), F.col("blocked").cast("double"))).alias("kind", "mass")).where("mass > 0")
    flows = _flows(edges).checkpoint()
    found = start
    if not flows.isEmpty():
        first = start.withColumn("mass", F.col("mass") * (1 - damping)).checkpoint()
        found, before = first, 0.0
        for _ in range(most_rounds):
            moved = flows.join(found.withColumnRenamed("host", "giver"), ["kind", "giver"]).select(F.col("taker").alias("host"), "kind", (F.col("share") * F.col("mass") * damping).alias("mass"))
            found = moved.unionByName(first).groupBy("host", "kind").agg(F.sum("mass").alias("mass")).checkpoint()
            now = found.agg(F.sum("mass")).first()[0] or 0.0
            if now - before <= tolerance * now:
                break
            before = now
        else:
            raise RuntimeError(f"trust did not settle in {most_rounds} rounds")
        scale = found.groupBy("kind").agg(F.sum("mass").alias("all")).join(start.groupBy("kind").agg(F.sum("mass").alias("seeded")), "kind")
        found = found.join(F.broadcast(scale), "kind").select("host", "kind", (F.col("mass") * F.col("seeded") / F.col("all")).alias("mass"))  # two rows
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0)).alias(kind)
    return found.groupBy("host").agg(of("trust"), of("distrust"))


def host_scores(pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = 0.85) -> DataFrame:
    """host, pages, trust, distrust (in pages) of every host with a page; hosts are never empty."""
    host, path = host_and_path(F.col("url"))
    _, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select(host.alias("host"), path.alias("path")).where("host <> ''").select("host", verdict.alias("verdict"))
    seeds = judged.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("verdict") == "allow").alias("trusted"), F.count_if(F.col("verdict") == "block").alias("blocked")).checkpoint()
    mass = propagate(host_edges(pages), seeds, damping)
    return seeds.join(mass, "host", "left").select("host", "pages", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")])


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = 0.85, margin: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict of every page (page_id, url, html): the longest rule's verdict, else the host's.

    A host is blocked if its distrust exceeds its trust by more than ``margin`` of its own pages. Pages without a host are
    allowed. Repeated rows are judged each, and count each; a null or empty html has no links; no rows give no rows.
    """
    shared_folder(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scores = host_scores(pages.select("url", "html"), rules, damping)
    bad = scores.where(F.col("distrust") - F.col("trust") > margin * F.col("pages")).select(F.col("host").alias("bad")).checkpoint()
    if (bad.agg(F.sum(F.octet_length("bad") + 16)).first()[0] or 0) <= MOST_BROADCAST:
        bad = F.broadcast(bad)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.select("*", name.alias("rule"), verdict.alias("verdict")).join(bad, F.col("host") == F.col("bad"), "left")
    own = F.when(F.col("bad").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"))


ORACLE = rf"""
    WITH RECURSIVE p AS (
        SELECT page_id, html, translate(u.host, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, u.path AS path
        FROM (SELECT page_id, html, regexp_extract(coalesce(url, ''), '{URL}', ['host', 'path']) AS u FROM pages)
    ), r(verdict, name, host, path) AS (
        VALUES {", ".join(f"('{r.verdict}', '{r.name}', '{r.host}', '{r.path}')" for r in RULES)}
    ), j AS (
        SELECT *, (SELECT max_by({{'name': name, 'verdict': verdict}}, length(name)) FROM r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS rule FROM p
    ), seeds AS (
        SELECT host, count(*) AS pages, count(*) FILTER (rule.verdict = 'allow') AS trust, count(*) FILTER (rule.verdict = 'block') AS distrust FROM j WHERE host <> '' GROUP BY host
    ), masses AS (
        SELECT host, 'trust' AS kind, CAST(trust AS DOUBLE) AS mass FROM seeds WHERE trust > 0 UNION ALL SELECT host, 'distrust', distrust FROM seeds WHERE distrust > 0
    ), e AS (
        SELECT host AS src, dst, count(*) AS weight FROM (
            SELECT host, unnest(list_distinct(list_transform(regexp_extract_all(html, '{ANCHOR.replace("'", "''")}', 1), lambda x: translate(x, '{string.ascii_uppercase}', '{string.ascii_lowercase}')))) AS dst FROM p)
        WHERE host <> '' AND dst <> '' AND host <> dst GROUP BY ALL
    ), f AS (
        SELECT 'trust' AS kind, src AS giver, dst AS taker, weight / sum(weight) OVER (PARTITION BY src) AS share FROM e
        UNION ALL SELECT 'distrust', dst, src, weight / sum(weight) OVER (PARTITION BY dst) FROM e
    ), t AS (
        SELECT 0 AS round, kind, host, 0.15 * mass AS mass FROM masses
        UNION ALL SELECT round + 1, kind, taker, sum(0.85 * share * mass) FROM (SELECT t.round, t.kind, f.taker, f.share, t.mass FROM t JOIN f ON t.kind = f.kind AND t.host = f.giver WHERE round < 150) GROUP BY round, kind, taker
    ), x AS (
        SELECT host, kind, sum(mass) * (SELECT sum(mass) FROM masses m WHERE m.kind = t.kind) / (SELECT sum(mass) FROM t AS a WHERE a.kind = t.kind) AS mass FROM t GROUP BY host, kind
    ), bad AS (
        SELECT host FROM seeds WHERE coalesce((SELECT sum(CASE kind WHEN 'trust' THEN -mass ELSE mass END) FROM x WHERE x.host = seeds.host), 0) > 0.5 * pages
    )
    SELECT page_id, host, path, rule.name AS rule, coalesce(rule.verdict, CASE WHEN host IN (FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""
