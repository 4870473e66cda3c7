"""Nearest neighbours by randomly rotated one-bit codes (operator 2).

A vector, less the centre, is filled up with zeros to ``spread`` times its dimensions and rotated at
random; only the signs are kept: one bit a rotated dimension, packed into 64-bit words, with two scalars, its length and the inner product of its direction with
its code. A query is rotated likewise and cut into four bit planes, so that an inner product is
estimated from bit counts. The estimate's error is bounded by the code's own scalar. The vectors of
the best estimates are ranked first; of the others, those whose upper bound reaches the k-th best of
them are ranked again by the exact inner product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLANES = 4
#: Vectors and queries in a block; the same at every size of the input.
DATA_BLOCK, QUERY_BLOCK = 8192, 8192


class OneBitCodes:
    """Codes for vectors of a dimension, of ``spread`` bits a dimension, filled up to a multiple of 64. More bits make the error smaller."""

    def __init__(self, dim: int, centre: np.ndarray, sureness: float = 4.0, spread: int = 4, seed: int = 3):
        self.dim, self.wide = dim, -(-dim * spread // 64) * 64
        self.centre = centre
        self.sureness = sureness / math.sqrt(max(self.wide - 1, 1))
        self.rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(self.wide, dim)))[0].T

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed codes (n, words), lengths, and inner products of the directions with their codes (over 0)."""
        x = (vectors - self.centre) @ self.rotation
        length = np.sqrt((x**2).sum(axis=1))
        bits = x > 0
        align = np.abs(x).sum(axis=1) / (np.sqrt(self.wide) * np.where(length > 0, length, 1))
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64), length, np.where(length > 0, align, 1)

    def prepared(self, codes: np.ndarray, length: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of a block of codes: its words by place, and what bounds need of each code."""
        scale = length / align
        per = (np.bitwise_count(codes).sum(axis=1), 2 * scale / math.sqrt(self.wide), self.sureness * scale * np.sqrt(np.maximum(1 - align**2, 0)), self.sureness * scale)
        return np.ascontiguousarray(codes.T), *(x.astype(np.float32) for x in per)

    def bounds(self, queries: np.ndarray, block: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the inner products (queries x vectors of a prepared block), and their error bounds, in single precision."""
        words, ones, factor, by_norm, by_lost = block
        y = queries @ self.rotation
        low = y.min(axis=1, keepdims=True)
        step = np.maximum((y.max(axis=1, keepdims=True) - low) / (2**PLANES - 1), 1e-300)
        level = np.rint((y - low) / step).astype(np.uint8)
        lost = np.sqrt(((low + step * level - y) ** 2).sum(axis=1, keepdims=True)).astype(np.float32)
        dot = np.zeros((len(queries), words.shape[1]), np.uint16 if self.wide << PLANES < 1 << 16 else np.int32)
        for p in reversed(range(PLANES)):
            plane = np.packbits((level >> p) & 1, axis=1, bitorder="little").view(np.uint64)
            dot <<= 1
            for w in range(len(words)):
                dot += np.bitwise_count(plane[:, w, None] & words[w])
        single = lambda x: x.astype(np.float32)
        estimate = single(dot)
        estimate *= single(step)
        estimate += single(low) * ones
        estimate -= single(y.sum(axis=1, keepdims=True) / 2)
        estimate *= factor
        estimate += single(queries @ self.centre[:, None])
        error = single(np.sqrt((y**2).sum(axis=1, keepdims=True))) * by_norm
        error += lost * by_lost
        return estimate, error


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up in the order of the dimensions."""
    return np.cumsum(vectors * query, axis=1)[:, -1]


def nearest_in(codes: OneBitCodes, q_rows: np.ndarray, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, copies: np.ndarray, v: np.ndarray, packed: tuple, k: int) -> list[tuple[np.ndarray, ...]]:
    """(places of queries, places of vectors, scores, copies): each query's k best of these vectors, ties to the smaller id; of its own row one copy is left out.

    q_rows and rows: keys of the queries' and of the vectors' rows (id and vector); copies: how often the table holds each.
    """
    out = []
    with np.errstate(over="ignore"):
        block, single = codes.prepared(*packed), v.astype(np.float32)
    block_size = np.abs(v).max(initial=0.0)
    huge = max(block_size, np.abs(q).max(initial=0.0)) > 1e15  # beyond what single precision can bound: rank all
    for i in range(0, len(q), 16):  # few, so that their matrices stay in the cache
        some, names = q[i : i + 16], q_rows[i : i + 16]
        estimate, error = codes.bounds(some, block)
        for j, name in enumerate(names):
            own = rows == name
            left = copies - own
            gone = left == 0
            likely = np.where(gone, -np.inf, estimate[j])
            first = np.argpartition(-likely, 2 * k)[: 2 * k] if len(ids) > 2 * k else np.arange(len(ids))
            first = first[~gone[first]]
            if not len(first):
                continue
            query = some[j].astype(np.float32)
            slack = 1e-5 * float(np.abs(query).sum() * block_size)  # of sums in single precision
            least = np.partition(single[first] @ query, -k)[-k] - slack if len(first) >= k else -np.inf
            again = np.flatnonzero(~gone & (huge | (likely + error[j] >= least)))
            if len(again) > k and not huge:
                roughly = single[again] @ query
                again = again[roughly >= np.partition(roughly, -k)[-k] - slack]
            score = exact(some[j], v[again].astype(np.float64))
            order = np.lexsort((ids[again], -score))[:k]
            best = again[order]
            out.append((np.full(len(best), i + j), best, score[order], left[best]))
    return out


def search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, sureness: float = 4.0, centre_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, its k nearest other rows by inner product.

    All rows are indexed; the centre alone comes from a bounded sample of ``centre_rows`` rows (by a
    hash of the row). Equal rows are taken together and counted, so a vector that many rows hold is one. Queries and vectors
    are dealt into blocks of DATA_BLOCK and QUERY_BLOCK rows, and each pair of blocks is one task of bounded size; vectors
    travel in the precision they are stored in. Vectors that are null or zero, hold a null or a non-finite component, or differ
    from the most frequent dimension take no part, nor do null ids. Repeated rows are candidates and queries each: a query
    leaves out its own row only, not others of its id. Other columns are not read; no rows give no rows.
    """
    stored = "float" if dict(vectors.dtypes)[vec_col] == "array<float>" else "double"
    kind = np.float32 if stored == "float" else np.float64
    vec = F.col(f"`{vec_col}`").cast(f"array<{stored}>")
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))
    schema = "query_id long, rank int, vec_id long, score double"
    shape = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q")).orderBy(F.desc("n"), "dim").first()
    if shape is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim, n, n_queries = shape
    rows = rows.where(F.size("vec") == dim)
    sample = rows.orderBy(F.xxhash64("id", "vec"), "id").limit(centre_rows).select(F.col("vec").cast("array<double>").alias("vec")).toArrow().column("vec").combine_chunks()
    codes = OneBitCodes(dim, sample.values.to_numpy().reshape(-1, dim).mean(axis=0), sureness)
    as_bytes = lambda a: pa.array([x.tobytes() for x in a], pa.binary())

    def packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("vec").flatten().to_numpy().reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column("id"), as_bytes(v + kind(0))], ["id", "raw"])  # -0.0 becomes 0.0

    distinct = rows.mapInArrow(packed_rows, "id long, raw binary").groupBy("id", "raw").agg(F.count("*").alias("copies")).withColumn("row", F.xxhash64("id", "raw"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.frombuffer(b"".join(b.column("raw").to_pylist()), kind).reshape(-1, dim).astype(np.float64)
            code, length, align = codes.encode(v)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "row", "copies", "raw")), as_bytes(code), pa.array(length), pa.array(align)], ["id", "row", "copies", "raw", "code", "length", "align"])

    indexed = distinct.select("id", "row", "copies", "raw").mapInArrow(index, "id long, row long, copies long, raw binary, code binary, length double, align double")
    cuts, q_cuts = max(1, math.ceil(n / DATA_BLOCK)), max(1, math.ceil(n_queries / QUERY_BLOCK))
    part = lambda m: F.pmod("row", F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    data = indexed.withColumn("db", part(cuts)).withColumn("qb", each(q_cuts))
    queries = distinct.where(F.col("id") % every == 0).withColumn("qb", part(q_cuts)).withColumn("db", each(cuts))

    def match(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        as_rows = lambda t, c, of: np.frombuffer(b"".join(t.column(c).to_pylist()), of).reshape(t.num_rows, -1)
        found = []
        of = lambda t, c: t.column(c).to_numpy()
        if left.num_rows and right.num_rows:
            packed = (as_rows(right, "code", np.uint64), of(right, "length"), of(right, "align"))
            found = nearest_in(codes, of(left, "row"), as_rows(left, "raw", kind).astype(np.float64), of(right, "id"), of(right, "row"), of(right, "copies"), as_rows(right, "raw", kind), packed, k)
        q, v, score, copies = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64, np.int64)))
        return pa.table({"query_id": of(left, "id")[q], "query_row": of(left, "row")[q], "query_copies": of(left, "copies")[q], "vec_id": of(right, "id")[v], "score": score, "copies": copies})

    out = "query_id long, query_row long, query_copies long, vec_id long, score double, copies long"
    found = queries.select("id", "row", "copies", "raw", "qb", "db").groupBy("qb", "db").cogroup(data.groupBy("qb", "db")).applyInArrow(match, out)
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    best = best.withColumn("before", F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < k)
    ranked = best.withColumn("rank", F.explode(F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("copies"), F.lit(k)))))
    again = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("query_copies"))))
    return again.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
