"""Terms of a dictionary in texts: an automaton over all forms, one pass over a text.

A dictionary of proven size is one automaton that every worker builds once. A larger one is cut into shards by the first letters of its
forms: a text goes to the shards that hold a form which begins with one of its words, and what they find meets again by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
#: Characters of forms that one automaton holds at most; their automaton takes some hundred bytes each.
MOST_CHARS = 1 << 20

#: start, end, form and concept of an occurrence.
Hit = tuple[int, int, str, str]


def automaton(forms: list[tuple[str, str]]) -> ahocorasick.Automaton:
    """Of (form, concept) pairs; a form's concepts are taken together, in order."""
    concepts: dict[str, list[str]] = {}
    for form, concept in sorted(set(forms)):
        concepts.setdefault(form, []).append(concept)
    out = ahocorasick.Automaton()
    for form, own in concepts.items():
        out.add_word(form, (form, own))
    out.make_automaton()
    return out


@lru_cache(maxsize=2)
def _kept(forms: tuple[tuple[str, str], ...]) -> ahocorasick.Automaton:
    return automaton(list(forms))


def _inside(c: str) -> bool:
    return c.isalnum() or c == "_"


def hits(found: ahocorasick.Automaton, text: str) -> list[Hit]:
    """All whole-word occurrences of forms in a text, those of one form without overlaps, from the left."""
    out: list[Hit] = []
    upto: dict[str, int] = {}
    for last, (form, concepts) in found.iter(text):
        start, end = last + 1 - len(form), last + 1
        if start < upto.get(form, 0) or (start and _inside(text[start - 1])) or (end < len(text) and _inside(text[end])):
            continue
        upto[form] = end
        out += [(start, end, form, c) for c in concepts]
    return out


def longest(found: list[Hit], size: int) -> list[tuple[int, int, str]]:
    """start, end, concept of the hits that stay where hits overlap: the longest forms, then by form, concept and place."""
    taken, out = bytearray(size), []
    for start, end, _, concept in sorted(found, key=lambda h: (h[0] - h[1], h[2], h[3], h[0])):
        if not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            out.append((start, end, concept))
    return out


_FOUND = "page_id string, block_id string, start int, end int, concept_id string"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["page_id", "block_id", "start", "end", "concept_id"])


def match_terms(blocks: DataFrame, terms: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """page_id, block_id, start, end, concept_id: whole-word matches of terms (concept_id, form) in blocks (page_id, block_id, text), ignoring case; the longest form wins where matches overlap.

    Forms without a letter or digit are left out. Time is that of one pass over the texts, whatever the number of forms. The
    dictionary's size is looked at first: up to ``most_chars`` characters it goes to all workers, beyond that it stays a table.
    """
    forms = terms.select("concept_id", F.lower("form").alias("form")).where(F.col("form").rlike(TOKEN)).distinct()
    low = blocks.select("page_id", "block_id", F.lower("text").alias("low")).where("low IS NOT NULL")
    size = forms.agg(F.sum(F.length("form") + F.length("concept_id"))).first()[0] or 0
    if size > most_chars:
        return _by_shards(low, forms, -(-size // most_chars))
    dictionary = tuple(sorted((r["form"], r["concept_id"]) for r in forms.collect()))
    if not dictionary:
        return low.where("false").select("page_id", "block_id", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("concept_id"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _kept(dictionary)
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("page_id", "block_id", "low"))
            yield _rows([(page, block, *m) for page, block, text in zip(*columns, strict=True) for m in longest(hits(found, text), len(text))])

    return low.mapInArrow(scan, _FOUND)


def _by_shards(low: DataFrame, forms: DataFrame, shards: int) -> DataFrame:
    shard = lambda head: F.pmod(F.xxhash64(F.substring(head, 1, 3)), F.lit(2 * shards))
    head = F.regexp_extract("form", TOKEN, 0)
    told = forms.withColumn("shard", shard(head)).groupBy("shard").agg(F.collect_list(F.struct("form", "concept_id")).alias("forms"))
    # Only texts that hold the first word of a form of the shard go to it.
    words = F.array_distinct(F.regexp_extract_all("low", F.lit(f"({TOKEN})"), F.lit(1)))
    heads = low.select("page_id", "block_id", F.explode(words).alias("head")).join(forms.select(head.alias("head")).distinct(), "head", "left_semi")
    asked = low.join(heads.select("page_id", "block_id", shard(F.col("head")).alias("shard")).distinct(), ["page_id", "block_id"])
    both = told.withColumn("side", F.lit(0)).unionByName(asked.withColumn("side", F.lit(1)), allowMissingColumns=True)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, None
        for batch in batches:
            out = []
            for shard, side, own, page, block, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "side", "forms", "page_id", "block_id", "low")), strict=True):
                if side == 0:
                    now, found = shard, automaton([(f["form"], f["concept_id"]) for f in own])
                elif shard == now:
                    out += [(page, block, *h) for h in hits(found, text)]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["page_id", "block_id", "start", "end", "form", "concept_id"])

    found = both.repartition("shard").sortWithinPartitions("shard", "side").mapInArrow(scan, "page_id string, block_id string, start int, end int, form string, concept_id string")
    together = found.groupBy("page_id", "block_id").agg(F.collect_list(F.struct("start", "end", "form", "concept_id")).alias("hits"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, block, own in zip(*(batch.column(c).to_pylist() for c in ("page_id", "block_id", "hits")), strict=True):
                found = [(h["start"], h["end"], h["form"], h["concept_id"]) for h in own]
                out += [(page, block, *m) for m in longest(found, max(h[1] for h in found))]
            yield _rows(out)

    return together.mapInArrow(choose, _FOUND)
