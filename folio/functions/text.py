"""Text functions on columns, kept in Spark's generated code unless Unicode tables are needed."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# Patterns and word lists whose results must match the published behaviour.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
COMPOUND_PREFIXES = ("co", "all", "half", "non", "re", "self", "well")
SENTENCE_BOUNDARY = r"\. (?=[A-ZА-ЯЁ])"
AUTO_FIX_BOUNDARY = r"(?<=[.!?])\s+(?=[A-ZА-ЯЁ])"
TOC_ENTRY = r"(.+?)\.{3,}\s*(\d+)"
#: Found by ``repeated``, not by the engine's backtracking, whose time grows with the square of a line.
REPEAT = r"(.{4,})\1"
GLUED = (
    ("case", r"[а-яё][А-ЯЁ]{2,}"),
    ("repeat", REPEAT),
    ("sentence_ru", r"[.!?][А-ЯЁ]"),
    ("digit", r"[а-яёА-ЯЁ]\d|\d[а-яёА-ЯЁ]"),
    ("sentence_en", r"[a-z][.!?][A-Z]"),
)
DECORATIVE = (
    ("asset_token", r"\b[A-Z]{2}\d{4}\b"),
    ("stage_code", r"\bT\d{2}T\d{2}\b"),
    ("private_use", "[\ue000-\uf8ff]"),
    ("placeholder", "(?:^|\\s)[.\u03b1](?:\\s|$)"),
)
PAGE_REFS = (r"стр\.?\s*\d+", r"(?i)\bp\.\s*\d+", r"(?i)\bpage\s+\d+")
VERSIONED_ID = r"[a-z][a-z0-9]*(?:_[a-z0-9]+)*_v\d+(?:_\d+)?"
SNAKE_ID = r"[a-z][a-z0-9]*(?:_[a-z0-9]+){2,}"
CYRILLIC = "[\u0400-\u04ff]"
GARBAGE_TITLE = r"^\d+[.):]?\s*$"
STEP_NUMBER = r"^\d{1,3}[.):]*$"


def strip_controls(text: Column) -> Column:
    """Without C0 controls (tab, line feed and carriage return stay) and DEL."""
    return F.regexp_replace(text, CONTROL, "")


def dehyphenate(text: Column) -> Column:
    """Joins a word cut at a line's end (``exam- ple``); after a compound prefix, in any case, the hyphen stays (``self- made``). The next letter must be a small one."""
    kept = F.regexp_replace(text, rf"(?<![a-zA-Z])(?<![a-zA-Z]- )((?i:{'|'.join(COMPOUND_PREFIXES)}))- ([a-z])", "$1-$2\u0001")
    return F.regexp_replace(F.regexp_replace(kept, "([a-zA-Z])- ([a-z])", "$1$2"), "\u0001", "")


def unglue(text: Column) -> Column:
    """A space between a sentence's end and the next one's capital."""
    return F.regexp_replace(text, "([a-z])([.!?])([A-Z])", "$1$2 $3")


def normalize(text: Column) -> Column:
    return unglue(dehyphenate(strip_controls(text)))


#: Shifts and starts of a text that are looked at together, and the length of lines for which they are kept.
_PAIRS, _KEPT = 1 << 20, 4096
_LINE_END = re.compile("[\n\r\u0085\u2028\u2029]")


def _anchors(n: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shifts p from ``least`` to n / 2 with the multiples j of each for which j + p < n, some at a time."""
    p = least
    while p <= n // 2:
        to = min(n // 2 + 1, p + max(1, _PAIRS * p // n))
        shifts = np.arange(p, to)
        counts = (n - 1) // shifts
        first = np.repeat(np.cumsum(counts) - counts, counts)
        by = np.repeat(shifts, counts)
        yield by, (np.arange(len(by)) - first) * by
        p = to


@cache
def _kept_anchors(least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of all lines up to _KEPT by j + p, so that a shorter line's are the first ones; and how many a line has by its length."""
    by, at = (np.concatenate(x) for x in zip(*_anchors(_KEPT, least), strict=True))
    order = np.argsort(by + at, kind="stable")
    by, at = by[order], at[order]
    return by, at, np.searchsorted(by + at, np.arange(_KEPT + 1))


def has_repeat(line: str, least: int = 4) -> bool:
    """Whether some ``least`` or more characters stand twice in a row.

    A repeat of length p is a run of p places that equal those p later, and such a run holds one multiple of p. So only the n / p multiples of each
    length are looked at, n log n places in all; those with ``least`` equal places around them are compared as far as they go.
    """
    n = len(line)
    if n < 2 * least:
        return False
    text = np.full(n + 2 * least, -1, np.int64)
    text[least : least + n] = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    text[:least] = -2 - np.arange(least)
    text[least + n :] = -2 - least - np.arange(least)
    if n <= _KEPT:
        by, at, upto = _kept_anchors(least)
        found = [(by[: upto[n]], at[: upto[n]])]
    else:
        found = _anchors(n, least)
    for shifts, starts in found:
        hit = np.flatnonzero(text[least + starts] == text[least + starts + shifts])
        p, j = shifts[hit], starts[hit]
        run, best = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        for d in range(1 - least, least):
            there = np.minimum(least + j + p + d, len(text) - 1)
            run = np.where(text[least + j + d] == text[there], run + 1, 0)
            best = np.maximum(best, run)
        for k in np.flatnonzero(best >= least):
            a, b = least + int(j[k]), least + int(j[k] + p[k])
            m = int(p[k])
            after = text[a : min(a + m, n + least - m)] != text[b : min(b + m, n + least)]
            ahead = int(after.argmax()) if after.any() else len(after)
            back = min(a - least, m)
            before = (text[a - back : a] != text[b - back : b])[::-1]
            behind = int(before.argmax()) if before.any() else back
            if ahead + behind >= m:
                return True
    return False


@F.pandas_udf(BooleanType())
def repeated(texts: pd.Series) -> pd.Series:
    """Whether a line of the text holds four or more characters twice in a row, as the pattern REPEAT would find; null for null."""
    return texts.map(lambda t: None if t is None else any(has_repeat(line) for line in _LINE_END.split(t)))


def first_reason(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Name of the first pattern that occurs in the text; null if none does."""
    return F.coalesce(*[F.when(repeated(text) if p == REPEAT else text.rlike(p), F.lit(name)) for name, p in rules])


def page_reference(text: Column) -> Column:
    """The first reference to a page, by the patterns' order; null if there is none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in PAGE_REFS])


def leaked_identifier(text: Column) -> Column:
    """A versioned id, UNKNOWN, or a snake-case id of three parts beside Cyrillic text; null if there is none."""
    snake = F.when(text.rlike(CYRILLIC), F.nullif(F.regexp_extract(text, SNAKE_ID, 0), F.lit("")))
    return F.coalesce(F.nullif(F.regexp_extract(text, VERSIONED_ID, 0), F.lit("")), F.nullif(F.regexp_extract(text, r"\bUNKNOWN\b", 0), F.lit("")), snake)


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def is_garbage_title(text: Column) -> Column:
    """Empty, a lone marker, or fewer than two letters."""
    t = F.trim(text)
    return (t == "") | t.rlike(GARBAGE_TITLE) | (count_matches(t, r"\p{L}") < 2)


def is_garbled(text: Column, least: float = 0.3) -> Column:
    """Letters and digits are under a share of the characters (spaces, but no other white space, left out; two at least)."""
    dense = F.replace(text, F.lit(" "), F.lit(""))
    return (F.length(dense) >= 2) & (F.length(F.regexp_replace(dense, r"[^\p{L}\p{N}]", "")) < least * F.length(dense))


def word_set(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def jaccard_over(a: Column, b: Column, tenths: int) -> Column:
    """Whether the Jaccard similarity of two sets exceeds tenths/10, in integers. Two empty sets are alike, one empty set is not."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(True)).otherwise(10 * both > tenths * either)


def toc_entries(text: Column) -> Column:
    """array<struct<title, page>> of dot-leader entries; empty if there are fewer than two.

    Only lines with a dot leader and a number are searched, since the pattern takes quadratic time
    where it finds nothing.
    """
    joined = F.regexp_replace(text, r"(\.{3,})\s+(?=\d)", "$1 ")
    lines = F.filter(F.split(joined, "\n"), lambda x: x.rlike(r"\.{3,}\s*\d"))
    part = lambda k: F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(TOC_ENTRY), F.lit(k))))
    pairs = F.arrays_zip(F.transform(part(1), lambda t: F.trim(t)).alias("title"), F.transform(part(2), lambda p: p.cast("int")).alias("page"))
    return F.when(F.size(pairs) >= 2, pairs).otherwise(F.slice(pairs, 1, 0))


def search_terms(text: Column) -> Column:
    """Sorted distinct terms: lower-case words longer than one character, then without .,;:!? at their ends (so a term can be empty)."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 1)
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.regexp_replace(w, r"^[.,;:!?]+|[.,;:!?]+$", ""))))


def strip_decorative(text: Column) -> Column:
    """Without decorative tokens; white space collapsed."""
    for name, pattern in DECORATIVE:
        text = F.regexp_replace(text, pattern, " " if name == "placeholder" else "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sentence_boundary_near_middle(text: Column) -> Column:
    """0-based offset after the white space of the sentence boundary nearest the middle; null if there is none."""
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i - 1, F.lit(3)).rlike(r"^[.!?]\s[A-ZА-ЯЁ]$"))
    middle = F.length(text) / 2
    best = F.array_min(F.transform(ends, lambda i: F.struct(F.abs(i - middle).alias("d"), i.alias("i"))))
    return best["i"]


#: Digraphs whose title case is a letter of its own.
DIGRAPHS = ("ǄǇǊǱ", "ǅǈǋǲ")


def capitalized(text: Column) -> Column:
    """The first character in title case, all others in lower case. What a capital letter makes of one character is a capital and small ones (``ß`` gives ``Ss``)."""
    up = F.upper(F.substring(text, 1, 1))
    title = F.translate(F.concat(F.substring(up, 1, 1), F.lower(F.substring(up, 2, 3))), *DIGRAPHS)
    return F.concat(title, F.lower(F.substring(text, 2, 1 << 30)))


@F.pandas_udf(StringType())
def nfkd_lower(text: pd.Series) -> pd.Series:
    """Lower case, NFKD, white space collapsed: Spark has no Unicode normalisation."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKD", t.lower()).split()))


@F.pandas_udf(StringType())
def comparable(text: pd.Series) -> pd.Series:
    """NFC, white space collapsed, case folded."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).split()).casefold())


def identical_translation(source: Column, target: Column) -> Column:
    """The target says the same as the source; an empty target is not identical."""
    return (F.trim(target) != "") & (comparable(source) == comparable(target))


def extract_json(text: Column) -> Column:
    """The JSON object in a model's answer: from a fenced block, else from the first brace to the last; null if it doesn't parse."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.try_parse_json(F.coalesce(fenced, braces))


def writing_direction(dx: Column) -> Column:
    """rtl where a line's direction points to the left, else ltr."""
    return F.when(dx < 0, "rtl").otherwise("ltr")
