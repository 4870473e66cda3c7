"""Quality rules as a learned decision list (operator 10).

Sequential covering finds one rule after another for the rarer class (bad documents): a rule is a
conjunction of thresholds on a document's statistics. It is grown on one part of the labelled rows by
the condition with the largest information gain, and its last conditions are pruned on the other part
while that doesn't lower its precision there. Rows a rule covers are set aside; the list ends when a
new rule isn't precise enough. The list is emitted as one ordered Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.textarrays import TextBatch, _is_sep, mix, slices

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_marks", "n_bars", "n_letters", "n_distinct_words")
_symbol = np.zeros(256, bool)
_symbol[[ord(c) for c in "#*$%&|<>"]] = True
_upper = np.zeros(256, bool)
_upper[65:91] = True
_letter = _upper.copy()
_letter[97:123] = True
_letter[0xC3:] = True  # lead bytes of characters from U+00C0 on
_mark = np.zeros(256, bool)
_mark[[ord(c) for c in "!?"]] = True


def text_counts(batch: TextBatch) -> dict[str, np.ndarray]:
    """The counts of COUNTS and EXTRA for every document of a batch, without a Python object per word."""
    data, n = batch.data, len(batch)
    starts, ends = batch.words()
    words = batch.per_doc(starts)
    inside = ~_is_sep[data]
    count = lambda flags: batch.per_doc(np.flatnonzero(flags))
    out = {"n_words": words, "word_chars": count(inside & ((data & 0xC0) != 0x80)), "n_symbols": count(_symbol[data])}

    first = np.zeros(len(data) + 1, bool)
    first[batch.offsets] = True
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([batch.offsets[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_start = line_start[np.searchsorted(starts, np.append(line_start[1:], len(data))) > np.searchsorted(starts, line_start)]  # with a word
    if len(line_start):
        upto = np.searchsorted(breaks, line_start)
        next_break = np.append(breaks, len(data))[upto]
        doc = batch.doc_of(line_start)
        line_end = np.minimum(next_break, batch.offsets[doc + 1])
        lines = batch.per_doc(line_start)
        keys = mix(batch.hashes(line_start, line_end) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        distinct = np.bincount(doc[~pd.Series(keys).duplicated().to_numpy()], minlength=n)
    else:
        lines = distinct = np.zeros(n, np.int64)
    out["n_dup_lines"] = lines - distinct
    out["n_lines"] = lines

    repeat = np.zeros(n, np.int64)
    kinds = np.zeros(n, np.int64)
    if len(starts):
        doc = batch.doc_of(starts)
        h = batch.hashes(starts, ends)
        salt = doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        kinds = np.bincount(doc[~pd.Series(mix(h + salt)).duplicated().to_numpy()], minlength=n)
        if len(starts) >= 3:
            tri = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:]) + salt[:-2]
            whole = np.flatnonzero(doc[:-2] == doc[2:])
            again = whole[pd.Series(mix(tri[whole])).duplicated(keep=False).to_numpy()]
            covered = np.zeros(len(starts), bool)
            for k in range(3):
                covered[again + k] = True
            repeat = np.bincount(doc[covered], minlength=n)
    out["n_repeat_words"] = repeat
    out["n_distinct_words"] = kinds
    out |= {"n_upper": count(_upper[data]), "n_marks": count(_mark[data]), "n_bars": count(data == ord("|")), "n_letters": count(_letter[data])}
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """The rows of docs with the counts of COUNTS and EXTRA of their whole text, as long columns.

    A null text counts as empty: all counts are 0. Columns of docs with such a name are replaced.
    A map over the rows: no shuffle.
    """
    names = [*COUNTS, *EXTRA]
    kept = [c for c in docs.columns if c not in names]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                counts = text_counts(TextBatch.of(batch.column("text")))
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(counts[c], pa.int64()) for c in names)], [*kept, *names])

    from pyspark.sql.types import LongType, StructField, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *(StructField(c, LongType()) for c in names)]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: Statistics that rules may use: shares of counts, each written once for Spark and once for numpy.
SHARES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "marks_per_word": ("n_marks", "n_words"),
    "bars_per_word": ("n_bars", "n_words"),
    "distinct_word_share": ("n_distinct_words", "n_words"),
    "words": ("n_words", None),
}


def share(name: str) -> Column:
    over, under = SHARES[name]
    if under is None:
        return F.col(over).cast("double")
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    value: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.name] > self.value if self.above else table[self.name] <= self.value

    def column(self) -> Column:
        return share(self.name) > F.lit(self.value) if self.above else share(self.name) <= F.lit(self.value)


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first whose conditions all hold rejects, and what no rule rejects is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def rule_number(self) -> Column:
        """Number (from 1) of the rule that rejects a row; null if none does."""
        out = F.lit(None).cast("int")
        for k in range(len(self.rules), 0, -1):
            hit = F.lit(True)
            for c in self.rules[k - 1]:
                hit = hit & c.column()
            out = F.when(hit, F.lit(k)).otherwise(out)
        return out

    def rejects(self, table: dict[str, np.ndarray]) -> np.ndarray:
        out = np.zeros(len(next(iter(table.values()))), bool)
        for rule in self.rules:
            out |= np.logical_and.reduce([c.holds(table) for c in rule])
        return out


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    """FOIL's information gain of a condition that keeps p of p0 bad and n of n0 good rows."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _best(table: dict[str, np.ndarray], bad: np.ndarray, among: np.ndarray) -> tuple[float, Condition | None]:
    best, found = 1e-9, None
    p0, n0 = float(bad[among].sum()), float((~bad[among]).sum())
    for name in SHARES:
        x = table[name][among]
        order = np.argsort(x, kind="stable")
        x, y = x[order], bad[among][order]
        cut = np.flatnonzero(x[1:] > x[:-1])
        if not len(cut):
            continue
        p, n = np.cumsum(y)[cut], np.cumsum(~y)[cut]
        for above, gains in ((False, _gain(p, n, p0, n0)), (True, _gain(p0 - p, n0 - n, p0, n0))):
            k = int(np.argmax(gains))
            if gains[k] > best:
                best, found = float(gains[k]), Condition(name, above, float((x[cut[k]] + x[cut[k] + 1]) / 2))
    return best, found


def learn(table: dict[str, np.ndarray], bad: np.ndarray, least_precision: float = 0.8, most_rules: int = 12, seed: int = 7) -> DecisionList:
    """Sequential covering. Rows without labels of both kinds give an empty list, which keeps all."""
    rng = np.random.default_rng(seed)
    left = np.ones(len(bad), bool)
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < most_rules and bad[left].any() and not bad[left].all():
        grow = left & (rng.random(len(bad)) < 2 / 3)
        prune = left & ~grow
        rule: list[Condition] = []
        among = grow.copy()
        while bad[among].any() and not bad[among].all() and len(rule) < 5:
            _, condition = _best(table, bad, among)
            if condition is None:
                break
            rule.append(condition)
            among &= condition.holds(table)
        if not rule:
            break

        def worth(k: int, rule: list[Condition] = rule, prune: np.ndarray = prune) -> float:
            hit = prune & np.logical_and.reduce([c.holds(table) for c in rule[:k]])
            p, n = bad[hit].sum(), (~bad[hit]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        keep = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
        hit = left & np.logical_and.reduce([c.holds(table) for c in rule[:keep]])
        if bad[hit].sum() < max(3, least_precision * hit.sum()):
            break
        rules.append(tuple(rule[:keep]))
        left &= ~hit
    return DecisionList(tuple(rules))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> DecisionList:
    """A list from the labelled documents (quality 0 is bad), from ``most_rows`` of them at most.

    Which rows those are is decided by a hash of doc_id, so they are spread over the whole input; of documents with
    a repeated doc_id (each takes the label) the first by a hash of the text come, ``most_rows`` in all. Labels that are null or
    of no doc_id, and documents that fail the base rules, teach nothing. The labels are small
    against the texts: the sample is drawn from them before the texts are read.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by most_rows
    stats = statistics(rows).where(~base_failed())
    drawn = stats.select("doc_id", F.xxhash64("text").alias("drawn"), "quality", *[share(s).alias(s) for s in SHARES])
    pdf = drawn.orderBy(F.xxhash64("doc_id"), "doc_id", "drawn").limit(most_rows).toPandas().sort_values(["doc_id", "drawn"], kind="stable")
    table = {s: pdf[s].to_numpy(float) for s in SHARES}
    return learn(table, pdf["quality"].to_numpy() == 0)


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """docs with COUNTS, EXTRA, base_failed, rule (of the list, or null) and kept.

    No word: base_failed. Every row is judged alone, so ties, repeated rows and extra columns change nothing.
    """
    out = statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", rules.rule_number())
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
