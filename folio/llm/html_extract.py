"""Main text of web pages by the maximum-scoring subsequence (operator 1).

A page is a sequence of words and tags. Each has a score, a logarithm of how much likelier it is in content
than outside: a word scores positive and a tag negative, with weights counted on labelled pages, and a
word adds the log odds of the elements it stands in, so that words of a menu or an advert score
negative too. One linear scan finds the contiguous region with the largest sum; that is the main text.
Elements that score negative inside of the region (an advert between two paragraphs) are left out of it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EVENT = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|svg|iframe|textarea|title|select)\b(?:[^>\"'</]++|/(?!>)|\"[^\"]*\"|'[^']*')*+(?:/>|>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"'<]++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|([^<]+|<)",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_PART = re.compile(r"[a-z]+(?=[A-Z])|[A-Z]?[a-z]+|[A-Z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br button input script style noscript template svg math iframe object textarea select canvas audio video mrow mi mn mo msup msub mfrac mtext msqrt semantics annotation".split())
#: Inline elements to click on or fill in.
_ACTIVE = frozenset("a button input label select textarea".split())
_SECTIONS = frozenset("article main nav header footer aside form button label fieldset menu dialog head comments>article".split())
_PLAIN = frozenset("html body div span section table tbody thead tr td th center ul ol li dl dt dd".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote dd figcaption".split())
#: Elements that an opening tag of these names ends, if they are open.
_ENDS = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
_BODY = frozenset("body p div article main nav header footer aside section h1 h2 h3 h4 h5 h6 ul ol table form".split())
_DISCUSSION = (".comment", ".repl", ".respon", ".discuss")
#: Classes of a header that is the article's own.
_OWN_HEADER = frozenset((".article", ".post", ".entry", ".story"))

#: What marks content and what doesn't, as labelled pages: an element with some words of text, content or not.
LABELLED = {
    True: "<article> <main> <div class=article> <div class=content> <div id=main> <div class=post-body> <div class=entry-content> <div class=story> <section class=body-text> <div itemprop=articleBody> <div role=main> "
    "<p> <h1> <h2> <h3> <blockquote> <pre> <figure> <figcaption> <em> <strong> <b> <i> <code> <dl> <div><p> <div><div><p> <section><p> <article><header> <article><ul><li> <article><table> <main><ol><li> <article><p><a> <p><a>",
    False: "<nav> <header> <footer> <aside> <form> <button> <label> <fieldset> <menu> <dialog> <head> <nav><ul><li><a> <header><h1> <footer><p> <aside><p> <aside><h2> <form><p> <ul><li><a> <div><a> <td><a> <div class=ad><p> "
    "<div class=ads> <div class=advert> <div class=advertisement> <div class=adsbygoogle> <div class=sponsored> <div class=sponsor> <div class=promo> <div class=banner> <div class=menu> <div class=navbar> <div class=nav> <div class=navigation> <div class=breadcrumb> <div class=breadcrumbs> "
    "<div class=header> <div class=masthead> <div class=topbar> <div class=footer> <div class=bottom> <div class=copyright> <div class=legal> <div class=sidebar> <div class=rail> <div class=widget> <div class=related> <div class=recommended> <div class=trending> <div class=popular> "
    "<div class=cookie> <div class=consent> <div class=gdpr> <div class=notice> <div class=alert> <div class=disclaimer> <div class=popup> <div class=modal> <div class=overlay> <div class=paywall> <div class=newsletter> <div class=subscribe> <div class=signup> <div class=login> <div class=search> "
    "<div class=share> <div class=sharing> <div class=social> <div class=follow> <div class=comment><p> <div class=comments><p> <div class=commentlist> <div class=disqus> <div class=respond> <div class=reply> <div class=replies> <div class=discussion> <div class=responses> <div class=reviews> <div class=tags> <div class=pagination> <div class=pager> <div class=skip> "
    "<div class=notification> <div class=toolbar> <div class=form> <div class=tracking> <div class=outbrain> <div class=taboola> <div role=navigation> <div role=banner> <div role=contentinfo> <div role=complementary> <div role=search> <div role=dialog> <div role=alert> <section class=comments><p> <ol class=comments><li><p> <article><footer> <article><aside><p> <article><nav> <article><form>",
}


class Place(NamedTuple):
    """What the open elements say of a word, in constant size, outermost to innermost."""

    state: int = 0  # -1 in an element that is no content, 1 in one that is, 0 undecided
    by_tag: bool = False  # the state is negative by a tag only
    held: bool = False  # an element that is content holds it
    decided: float = 0.0  # log odds of the element that decided the state
    mild: float = 0.0  # sum of the log odds of the tags that decide nothing
    articles: bool = False  # in an article or main element
    discussion: bool = False  # among comments


NOWHERE = Place()


class Weights:
    """Log odds from counts of labelled pages: of words by feature of the elements they stand in, and of tags by name.

    ``words``: words inside and outside of content by feature; ``tags``: tags by name; ``totals``: all words and all tags.
    """

    #: Log odds, from this on, of a class or section that decide by themselves.
    STRONG = 1.5
    #: Bounds of a word's score. Words in one element that is no content cost no more than two words each.
    LEAST_WORD, MOST_WORD = -2.0, 1.0

    def __init__(self, words: dict[str, tuple[float, float]], tags: dict[str, tuple[float, float]] | None = None, totals: tuple[float, float, float, float] = (30.0, 1.0, 1.0, 2.0)):
        self.weight = {f: math.log((a + 1) / (b + 1)) for f, (a, b) in words.items()}
        words_in, tags_in, words_out, tags_out = totals
        n_in, n_out = words_in + tags_in, words_out + tags_out
        #: A word by itself is likelier in content, where there are many of them to a tag.
        self.base = min(1.0, max(0.05, math.log((words_in + 1) / (n_in + 1)) - math.log((words_out + 1) / (n_out + 1))))
        self.any_tag = min(-0.05, math.log((tags_in + 1) / (n_in + 1)) - math.log((tags_out + 1) / (n_out + 1)))
        rate = lambda x, n: (x + 0.5) / (n + 1)
        self.tag_weight = {t: min(-0.05, max(-3.0, math.log(rate(a, n_in) / rate(b, n_out)))) for t, (a, b) in (tags or {}).items()}

    def enter(self, place: Place, own: tuple[str, ...]) -> Place:
        """The place inside of an element with these features.

        Going inwards, an element with strong negative log odds turns what it holds negative. An
        article or main element turns it positive again; so does a strong positive class within an
        element that is negative by its tag only. Tags that decide nothing add their log odds.
        """
        strong = {f: w for f in own if abs(w := self.weight.get(f, 0.0)) >= self.STRONG and (f[0] == "." or f in _SECTIONS)}
        up = {f for f, w in strong.items() if w > 0}
        down = {f for f, w in strong.items() if w < 0}
        state, by_tag, held, decided, mild, articles, discussion = place
        if down == {".header"} and up & _OWN_HEADER:
            down = up = set()
        if down:
            state, by_tag, decided = -1, not any(f[0] == "." for f in down), min(strong[f] for f in down)
        elif up and (state >= 0 or by_tag or up & {"article", "main"}):
            state, held, decided = 1, True, max(strong[f] for f in up)
        mild += sum(max(-1.0, min(1.0, self.weight.get(f, 0.0))) for f in own if f[0] != "." and f not in _SECTIONS)
        return Place(state, by_tag, held, decided, max(-4.0, min(4.0, mild)), articles or not {"article", "main"}.isdisjoint(own), discussion or any(f.startswith(_DISCUSSION) for f in own))

    def word(self, place: Place) -> float:
        """What one word adds. Where an element of content holds one that is none, that one's words are left out but don't cut the text around them: they cost next to nothing."""
        odds = place.decided if place.state else place.mild
        if place.state < 0 and place.held:
            return -0.01
        score = self.base + odds
        return max(self.LEAST_WORD, min(-0.05, score)) if place.state < 0 else max(-1.0, min(self.MOST_WORD, score))

    def tag(self, name: str, place: Place) -> float:
        """Always negative: what is written with many tags to a word is seldom content. Next to nothing inside of an element of content, and for what isn't shown or only marks words."""
        if place.held or (name in _INLINE and name not in _ACTIVE):
            return -0.01
        if name not in self.tag_weight:
            return -0.05 if self.weight.get(name, 0.0) > 0 else self.any_tag / (10 if name in _PLAIN else 1)
        return self.tag_weight[name] / (10 if place.state == 0 and name in _PLAIN else 1)


def _features(name: str, attributes: str, place: Place, nearest: str | None) -> tuple[str, ...]:
    """A header in an article, an article among comments, a link in a list, and a link outside prose are features of their own."""
    if name == "header" and place.articles:
        name = "article>header"
    elif name == "article" and place.discussion:
        name = "comments>article"
    elif name == "a":
        name = "li>a" if nearest == "li" else "a" if nearest else "bare>a"
    out = [] if name in _PLAIN else [name]
    if "=" in attributes and name not in ("html", "body"):
        for m in _NAMED.finditer(attributes):
            out += [f".{x.lower()}" for x in _PART.findall(m[2])]
    if name == "form":  # its name says no more
        out = [f for f in out if f != ".form"]
    return tuple(dict.fromkeys(out))


class Event(NamedTuple):
    tag: str | None  # lower-case name; None for text
    place: Place
    text: str
    opened: tuple[str, ...]  # features of an element that opens here
    depth: int  # elements open after it


def events(page: str, weights: Weights) -> Iterator[Event]:
    """The tags of a page, and its pieces of text with decoded references, in linear time (but for overlapping inline elements)."""
    stack: list[tuple[str, Place, str | None]] = []  # name, place inside, nearest list item or element of prose
    open_names: Counter[str] = Counter()

    def cut(to: int) -> None:
        while len(stack) > to:
            open_names[stack.pop()[0]] -= 1

    for m in _EVENT.finditer(page):
        name = m[3]
        opened: tuple[str, ...] = ()
        if name:
            name = name.lower()
            if m[2]:
                if open_names[name]:
                    at = len(stack) - 1
                    blocked = False
                    while stack[at][0] != name and not blocked:
                        blocked = name in _INLINE and stack[at][0] not in _INLINE
                        at -= 1
                    if not blocked:
                        cut(at)
            else:
                if name in _BODY and open_names["head"]:
                    cut(next(k for k, x in enumerate(stack) if x[0] == "head"))
                if name not in _INLINE and stack:
                    ends = _ENDS.get(name, ("p",))
                    inner = len(stack)
                    while inner and (stack[inner - 1][0] in _INLINE or stack[inner - 1][0] in ends):
                        inner -= 1
                        if stack[inner][0] in ends:
                            cut(inner)
                if name not in _VOID and not m[4].endswith("/"):
                    _, place, nearest = stack[-1] if stack else ("", NOWHERE, None)
                    opened = _features(name, m[4], place, nearest)
                    stack.append((name, weights.enter(place, opened) if opened else place, name if name == "li" or name in _PROSE else nearest))
                    open_names[name] += 1
            yield Event(name, stack[-1][1] if stack else NOWHERE, "", opened, len(stack))
        elif m[5]:
            yield Event(None, stack[-1][1] if stack else NOWHERE, html.unescape(m[5]), opened, len(stack))
        elif m[1]:
            yield Event(m[1].lower(), stack[-1][1] if stack else NOWHERE, "", opened, len(stack))


NO_WEIGHTS = Weights({})


class Counts(NamedTuple):
    """Words by feature, tags by name, and all words, inside and outside of content."""

    words: tuple[Counter[str], Counter[str]]
    tags: tuple[Counter[str], Counter[str]]
    seen: tuple[int, int]


def label_counts(page: str) -> Counts | None:
    """Counts of what the page itself marks as its article; None if it marks nothing.

    A feature counts the words between an element's start and end, once where elements with it are nested: in constant time an element.
    """
    words, tags = (Counter(), Counter()), (Counter(), Counter())
    seen = [0, 0]
    open_elements: list[tuple[tuple[str, ...], tuple[int, int]]] = []
    held: Counter[str] = Counter()

    def close(to: int) -> None:
        while len(open_elements) > to:
            own, before = open_elements.pop()
            for f in own:
                held[f] -= 1
                if not held[f]:
                    for k in (0, 1):
                        words[k][f] += seen[k] - before[k]

    for tag, place, text, opened, depth in events(page, NO_WEIGHTS):
        outside = not place.articles
        if tag is None:
            n = len(text.split())
            seen[outside] += n
        else:
            tags[outside][tag] += 1
            close(depth if not opened else depth - 1)
            while len(open_elements) < depth:
                own = opened if len(open_elements) == depth - 1 else ()
                open_elements.append((own, (seen[0], seen[1])))
                held.update(own)
    close(0)
    return Counts(words, tags, (seen[0], seen[1])) if seen[0] and seen[1] else None


def _labelled_counts() -> tuple[Counter[str], Counter[str]]:
    """Words by feature of the labelled elements, inside and outside."""
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for label, pages in LABELLED.items():
        for page in re.findall(r"(?:<[^>]+>)+", pages):
            features = {f for e in events(page, NO_WEIGHTS) for f in e.opened}
            (inside if label else outside).update(features if label else features - {"article", "main"} - _PROSE)  # what is no content says nothing of articles around it and of paragraphs in it
    return inside, outside


#: Words that an element of the labelled list stands for, and at most a feature of the table's pages.
LABEL_WORDS, TABLE_WORDS = 20.0, 200.0


def weights_from(counts: Iterable[tuple[str, str, int, int]]) -> Weights:
    """Weights of the labelled list and of (kind, name, inside, outside) counts of labelled pages: kind ``word`` or ``tag``.

    A feature's words on the table's pages weigh up to ten times an entry of the list, so where the two differ, the table decides.
    """
    inside, outside = _labelled_counts()
    words = {f: (inside[f] * LABEL_WORDS, outside[f] * LABEL_WORDS) for f in inside | outside}
    tags: dict[str, tuple[float, float]] = {}
    totals = [30.0, 1.0, 1.0, 2.0]  # words and tags inside and outside, where no page is labelled
    for kind, name, a, b in counts:
        if kind == "total":
            totals = [x + y for x, y in zip(totals, (a, b, 0, 0) if name == "inside" else (0, 0, a, b), strict=True)]
        elif kind == "tag":
            tags[name] = (a, b)
        elif name not in ("article", "main"):
            scale = min(1.0, TABLE_WORDS / max(a + b, 1))
            x, y = words.get(name, (0.0, 0.0))
            words[name] = (x + a * scale, y + b * scale)
    return Weights(words, tags, tuple(totals))


def fit(pages: DataFrame, most_pages: int = 2000, most_features: int = 5000) -> Weights:
    """Weights from the labelled elements above and from about ``most_pages`` pages of the table that mark their own article.

    The pages are chosen by a hash of page_id and url over the whole table (repeated rows all or none of them); of
    their features the ``most_features`` with the most words are used. An empty table, and null or empty html, teach nothing.
    """
    unit = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) / float(1 << 30)
    sample = pages.where(unit < min(1.0, most_pages / max(pages.count(), 1))).select("html")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words, tags = (Counter(), Counter()), (Counter(), Counter())
            sums = [0, 0, 0, 0]
            for page in pdf["html"]:
                if page and (found := label_counts(page)):
                    for k in (0, 1):
                        words[k].update(found.words[k])
                        tags[k].update(found.tags[k])
                        sums[2 * k] += found.seen[k]
                        sums[2 * k + 1] += sum(found.tags[k].values())
            rows = [("word", f, words[0][f], words[1][f]) for f in words[0] | words[1]] + [("tag", t, tags[0][t], tags[1][t]) for t in tags[0] | tags[1]]
            rows += [("total", "inside", sums[0], sums[1]), ("total", "outside", sums[2], sums[3])]
            yield pd.DataFrame(rows, columns=["kind", "name", "inside", "outside"])

    rows = sample.mapInPandas(count, "kind string, name string, inside long, outside long").groupBy("kind", "name").agg(F.sum("inside").alias("a"), F.sum("outside").alias("b"))
    return weights_from(tuple(r) for r in rows.orderBy(F.col("kind") != "total", F.desc(F.col("a") + F.col("b")), "kind", "name").limit(most_features).collect())


def largest_sum(scores: Iterable[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest sum, in one scan; empty if no score is positive."""
    best = total = 0.0
    start, region = 0, (0, 0)
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, region = total, (start, i + 1)
    return region


def scores_of(items: list[Event], weights: Weights) -> list[float]:
    """The score of each tag, and of each piece of text: its words times a word's."""
    return [weights.tag(e.tag, e.place) if e.tag is not None else len(e.text.split()) * weights.word(e.place) for e in items]


def extract(page: str | None, weights: Weights) -> str:
    """The main text of a page: blocks in order, each on a line; empty if no word scores positive."""
    if not page:
        return ""
    items = list(events(page, weights))
    start, end = largest_sum(scores_of(items, weights))
    blocks: list[list[str]] = [[]]
    for tag, place, text, _, _ in items[start:end]:
        if tag is None:
            if weights.word(place) > 0:
                blocks[-1].append(text)
        elif tag in ("br", "img", "input", "wbr"):
            blocks[-1].append(" " if tag == "br" else "")
        elif tag not in _INLINE and blocks[-1]:
            blocks.append([])
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def main_text(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars of every page. A map over the rows.

    Null or empty html gives an empty text; malformed and very long pages are read in one pass. Repeated rows and null ids are
    pages of their own, other columns are not read, and no rows give no rows.
    """
    schema = f"page_id {dict(pages.dtypes)['page_id']}, url {dict(pages.dtypes)['url']}, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x.as_py(), weights) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
