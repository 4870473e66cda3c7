"""Language-model scores by deleted interpolation (operator 3).

A bigram model mixes maximum-likelihood estimates of the bigram, the unigram and the uniform
distribution. The mixture weights depend on how often the context was seen (buckets by powers of two)
and are learned by expectation-maximisation on a part of the training texts that is deleted from the
counts for that purpose; the final counts include it again.

Documents are dealt into blocks. A block sends the distinct 64-bit keys of its tokens and bigrams,
with its own counts, to key ranges (one packed row a block and range, so a frequent word is one entry
of a block); a range adds up and sends the totals back in the block's order; a block then scores its
texts. No task sees more than a block's text or a range's keys, and nothing of the model is broadcast.
"""

from __future__ import annotations

import math
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.dac import shared_folder
from folio.llm.textarrays import TextBatch, mix, slices

#: Bytes of text in a block, and bytes of text for each key range; the same at every size of the input.
BLOCK_BYTES, RANGE_BYTES = 4 << 20, 8 << 20
FOLDS = 5
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)  # keys beside the words' hashes
_GOLD = np.uint64(0x9E3779B97F4A7C15)
HALF_OCTAVES = 100  # cells of a probability in the held-out counts; 0 is probability 0


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS)).cast("int")


def tokens_of(batch: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all tokens (a text's words, then one end), each one's context (the token before, or the start), and each text's offset."""
    low = batch.lowered()
    starts, ends = low.words()
    words = low.per_doc(starts)
    at = np.concatenate([[0], np.cumsum(words + 1)])
    key = np.insert(low.hashes(starts, ends), np.cumsum(words), END)
    context = np.empty_like(key)
    context[1:] = key[:-1]
    context[at[:-1]] = START
    return key, context, at


def _block_tokens(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """tokens_of for a whole block, some megabytes at a time."""
    table = pa.RecordBatch.from_arrays([texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts], ["text"])
    parts = [tokens_of(TextBatch.of(b.column(0))) for b in slices(table, "text")]
    key, context = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    return key, context, np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and each key's place among them."""
    code, found = pd.factorize(keys)
    order = np.argsort(found)
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    return found[order], place[code]


def _bigrams(key: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix(mix(context * _GOLD) + key)


@lru_cache(maxsize=2)
def _edges(ranges: int) -> np.ndarray:
    """Where each key range but the first begins."""
    return np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64)


def _share(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each key range begins among sorted keys (and the end)."""
    return np.concatenate([[0], np.searchsorted(keys, _edges(ranges)), [len(keys)]])


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


_SENT = pa.schema([("range", pa.int64()), ("block", pa.int64()), *((f"{k}_{c}", pa.binary()) for k in "ub" for c in ("keys", "train", "kept"))])
_BACK = pa.schema([("block", pa.int64()), ("range", pa.int64()), *((f"{k}_{c}", pa.binary()) for k in "ub" for c in ("train", "kept")), *((c, pa.int64()) for c in ("n_train", "v_train", "n_kept", "v_kept"))])
_DDL = {pa.int64(): "long", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {_DDL[f.type]}" for f in schema)


def told_apart(docs: DataFrame, many: int = 1000) -> DataFrame:
    """doc_id, text, nth: all rows, with a number (0 elsewhere) for rows that ``many`` others equal, so that they can be dealt out.

    Equal rows are counted by a hash first. Only those of counts beyond ``many`` are put together, on the map side, and taken apart again
    by runs of ``many`` numbers, so the numbers are the same whenever they are made.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    hot = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > many).select("key").checkpoint()
    if hot.isEmpty():
        return rows.select("doc_id", "text", F.lit(0).cast("long").alias("nth"))
    equal = rows.join(hot, "key", "left_semi").groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    runs = equal.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / many)))).repartition("doc_id", F.xxhash64("text"), "run")
    last = F.least((F.col("run") + 1) * many, F.col("n")) - 1
    apart = runs.select("doc_id", "text", F.explode(F.sequence(F.col("run") * many, last)).alias("nth"))
    return rows.join(hot, "key", "left_anti").select("doc_id", "text", F.lit(0).cast("long").alias("nth")).unionByName(apart)


def blocks(docs: DataFrame, tuned_on: int, block_bytes: int, range_bytes: int) -> tuple[DataFrame, int, int]:
    """doc_id, text, fold, block; the number of key ranges; and the number of blocks of the tuning part, which come first.

    A block holds documents of the tuning part only or none of it, about ``block_bytes`` of text. A key range gets what about
    ``range_bytes`` of text send.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    some = max(1, math.ceil(size / FOLDS / block_bytes))
    rest = max(1, math.ceil(size * (FOLDS - 1) / FOLDS / block_bytes))
    key = F.xxhash64("doc_id", "text", "nth")
    block = F.when(F.col("fold") == tuned_on, F.pmod(key, F.lit(some))).otherwise(some + F.pmod(key, F.lit(rest)))
    dealt = told_apart(docs).withColumn("fold", fold(F.col("doc_id"))).withColumn("block", block).select("doc_id", "text", "fold", "block")
    return dealt, max(1, math.ceil(size / range_bytes)), some


def count_keys(dealt: DataFrame, ranges: int, held_out: int, tuned_on: int) -> DataFrame:
    """block, range and the corpus totals of the block's keys in that range, in their order, packed; with sums of tokens and of distinct tokens."""

    def send(table: pa.Table) -> pa.Table:
        key, context, at = _block_tokens(table.column("text"))
        part = np.repeat(table.column("fold").to_numpy(), np.diff(at))
        trains, block, n_docs = part != held_out, table.column("block")[0].as_py(), table.column("fold").to_numpy()
        out = []
        sides = []
        for name, keys in (("u", key), ("b", _bigrams(key, context))):
            found, place = _distinct(np.append(keys, START) if name == "u" else keys)
            place = place[: len(keys)]
            train = np.bincount(place[trains], minlength=len(found))
            kept = np.bincount(place[trains & (part != tuned_on)], minlength=len(found))
            if name == "u":
                i = np.searchsorted(found, START)
                train[i], kept[i] = (n_docs != held_out).sum(), ((n_docs != held_out) & (n_docs != tuned_on)).sum()
            sides.append((found, train, kept, _share(found, ranges)))
        for r in np.flatnonzero(sum(np.diff(s[3]) for s in sides)).tolist():
            cuts = [(s, s[3][r], s[3][r + 1]) for s in sides]
            out.append((r, block, *(x for s, a, b in cuts for x in (s[0][a:b].tobytes(), _packed(s[1][a:b]), _packed(s[2][a:b])))))
        return _columns(out, _SENT)

    def add(table: pa.Table) -> pa.Table:
        sent = table.to_pydict()
        sizes, totals, sums = {}, {}, []
        for k in "ub":
            keys = np.concatenate([np.frombuffer(x, np.uint64) for x in sent[f"{k}_keys"]])
            found, place = _distinct(keys)
            sizes[k] = np.cumsum([0, *(len(x) // 8 for x in sent[f"{k}_keys"])])
            for c in ("train", "kept"):
                count = np.bincount(place, _unpacked(sent[f"{k}_{c}"]), len(found)).astype(np.int64)
                totals[k, c] = count[place]
                if k == "u":
                    word = found != START
                    sums += [int(count[word].sum()), int((count[word] > 0).sum())]
        out = []
        for i, block in enumerate(sent["block"]):
            cells = [_packed(totals[k, c][sizes[k][i] : sizes[k][i + 1]]) for k in "ub" for c in ("train", "kept")]
            out.append((block, sent["range"][i], *cells, *(sums if i == 0 else [0] * 4)))
        return _columns(out, _BACK)

    packed = dealt.select("text", "fold", "block").groupBy("block").applyInArrow(send, _ddl(_SENT))
    return packed.groupBy("range").applyInArrow(add, _ddl(_BACK))


def _packed(counts: np.ndarray) -> bytes:
    """Counts as a byte for their width, then as unsigned integers of 1, 2, 4 or 8 bytes, the narrowest that hold them."""
    wide = next(w for w in (1, 2, 4, 8) if w == 8 or counts.max(initial=0) < 1 << 8 * w)
    return bytes([wide]) + counts.astype(f"<u{wide}").tobytes()


def _unpacked(raw: list[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64) for x in raw)])


def _totals(table: pa.Table, name: str) -> np.ndarray:
    """A block's totals, joined over the ranges in order."""
    return _unpacked(table.sort_by("range").column(name).to_pylist())


def _estimates(docs: pa.Table, back: pa.Table, which: str, n_all: int, v_all: int) -> dict[str, np.ndarray]:
    """For each token of a block: count, context count, p2, p1; with the texts' offsets."""
    key, context, at = _block_tokens(docs.column("text"))
    words, place = _distinct(np.append(key, START))
    pairs, pair_place = _distinct(_bigrams(key, context))
    unigram, bigram = _totals(back, f"u_{which}"), _totals(back, f"b_{which}")
    count = unigram[place[:-1]]
    before = np.empty_like(count)
    before[1:] = count[:-1]
    before[at[:-1]] = unigram[place[-1]]
    return {"at": at, "count": count, "context": before, "p2": bigram[pair_place] / np.maximum(before, 1), "p1": count / max(n_all, 1)}


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for a context that was never seen, else 1 + the whole binary logarithm of its count."""
    return np.where(context > 0, np.frexp(context.astype(float))[1], 0)


def _cells(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(HALF_OCTAVES - 1 + np.rint(2 * np.log2(np.maximum(p, 1e-30))), 1, HALF_OCTAVES - 1), 0).astype(np.int64)


def learn_weights(cells: list[tuple[int, int, int, int]], v_all: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights (bucket, 3: bigram, unigram, uniform) by EM on held-out counts.

    cells: (bucket, cell of p2, cell of p1, count). A bucket without held-out tokens takes the
    weights of the nearest lower one that has some (else the nearest higher, else equal shares).
    """
    weights = np.full((66, 3), np.nan)
    value = lambda c: np.where(c > 0, 2.0 ** ((c - HALF_OCTAVES + 1) / 2), 0.0)
    table = np.array(cells, np.int64).reshape(-1, 4)
    for bucket in np.unique(table[:, 0]):
        rows = table[table[:, 0] == bucket]
        p = np.stack([value(rows[:, 1]), value(rows[:, 2]), np.full(len(rows), 1 / (v_all + 1))], axis=1)
        n = rows[:, 3].astype(float)
        w = np.array([0.0, 0.5, 0.5]) if bucket == 0 else np.array([1.0, 1.0, 1.0]) / 3
        for _ in range(rounds):
            part = p * w
            w = (part / part.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0)
            w = w / w.sum()
        w = np.maximum(w, [0.0 if bucket == 0 else 1e-6, 1e-6, 1e-6])  # an unseen event keeps some probability
        weights[bucket] = w / w.sum()
    known = np.flatnonzero(~np.isnan(weights[:, 0]))
    for b in range(len(weights)):
        if np.isnan(weights[b, 0]):
            near = known[known < b][-1:] if (known < b).any() else known[:1]
            weights[b] = weights[near[0]] if len(near) else [1 / 3] * 3
    weights[0] = [0, weights[0, 1] + weights[0, 0] / 2, weights[0, 2] + weights[0, 0] / 2]
    return weights


def score_documents(docs: DataFrame, held_out: int = 1, tuned_on: int = 0, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Counts come from all documents whose fold isn't ``held_out``. A null text counts as empty and
    has its end token alone. With nothing to learn from, base_score is that of add-half smoothing
    over an empty corpus and score that of the uniform distribution. Ties and repeated rows are
    documents of their own; other columns are not read.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    kind = dict(docs.dtypes)["doc_id"]
    dealt, ranges, tuning_blocks = blocks(docs, tuned_on, block_bytes, range_bytes)
    folder = f"{shared_folder(spark)}/lm-{uuid.uuid4().hex}"
    count_keys(dealt, ranges, held_out, tuned_on).write.option("compression", "zstd").parquet(folder)
    back = spark.read.parquet(folder)
    sums = back.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_train", "v_train", "n_kept", "v_kept")]).first()
    n_train, v_train, n_kept, v_kept = (int(sums[c]) for c in ("n_train", "v_train", "n_kept", "v_kept"))

    def tally(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _columns([], pa.schema([(c, pa.int64()) for c in ("bucket", "p2", "p1", "n")]))
        e = _estimates(left, right, "kept", n_kept, v_kept)
        cell = (bucket_of(e["context"]) * HALF_OCTAVES + _cells(e["p2"])) * HALF_OCTAVES + _cells(e["p1"])
        found, n = np.unique(cell, return_counts=True)
        return pa.table({"bucket": found // HALF_OCTAVES**2, "p2": found // HALF_OCTAVES % HALF_OCTAVES, "p1": found % HALF_OCTAVES, "n": n})

    tuning = dealt.where(F.col("fold") == tuned_on).groupBy("block").cogroup(back.where(F.col("block") < tuning_blocks).groupBy("block"))
    cells = tuning.applyInArrow(tally, "bucket long, p2 long, p1 long, n long").groupBy("bucket", "p2", "p1").agg(F.sum("n").alias("n"))
    weights = learn_weights([tuple(r) for r in cells.collect()], v_kept)  # 66 x 100 x 100 cells at most

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        e = _estimates(left, right, "train", n_train, v_train)
        w = weights[bucket_of(e["context"])]
        model = np.log10(w[:, 0] * e["p2"] + w[:, 1] * e["p1"] + w[:, 2] / (v_train + 1))
        base = np.log10((e["count"] + 0.5) / (n_train + 0.5 * (v_train + 1)))
        at = e["at"][:-1]
        add = lambda x: np.add.reduceat(x, at)  # noqa: E731  each text has its end token
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "held_out": pa.array(left.column("fold").to_numpy() == held_out),
                "n_tokens": np.diff(e["at"]),
                "n_known": add((e["count"] > 0).astype(np.int64)),
                "train_tokens": np.full(len(at), n_train, np.int64),
                "base_score": add(base),
                "score": add(model),
            }
        )

    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, schema)
