"""Token files of directly addressable codes (operator 7).

An id is cut into chunks of 8 bits, lowest first. Level k holds the k-th chunk of every id that has
one, as plain bytes, and a bitmap that says which of these ids go on to level k + 1. The place of an
id's next chunk is the number of set bits before it, which a rank directory (set bits before every
512-bit block) gives with a count within one block. So any id is read with one lookup a level, and
any range with one slice a level, without decoding what stands before it.

A segment is one container: a header, the documents' first positions, then for each level the
bitmap, the directory and the chunks. Segments are rows of a Parquet table, so Spark's writers commit
them, and a lost task's files are never seen.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.pieces import whole_text_encoder
from folio.llm.textarrays import TextBatch, slices

MAGIC = b"DACF0001"
BLOCK_BITS = 512
#: Ids after which a segment is closed.
SEGMENT_IDS = 1 << 20


def pack(ids: np.ndarray, starts: np.ndarray) -> bytes:
    """A container of the ids (unsigned 32-bit); starts: each document's first position, and the end."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest):
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(bits) // (BLOCK_BITS // 8)) * (BLOCK_BITS // 8), np.uint8)
        padded[: len(bits)] = bits
        ones = np.bitwise_count(padded.reshape(-1, BLOCK_BITS // 8)).sum(axis=1, dtype=np.uint32)
        before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32)
        levels.append((len(rest), padded, before, (rest & 0xFF).astype(np.uint8)))
        rest = rest[more] >> 8
    out = [MAGIC, struct.pack("<QQB", len(ids), len(starts) - 1, len(levels)), starts.astype("<u4").tobytes()]
    for n, padded, before, chunks in levels:
        out += [struct.pack("<Q", n), padded.tobytes(), before.astype("<u4").tobytes(), chunks.tobytes()]
    return b"".join(out)


class Reader:
    """Random access to a container's ids; nothing is decoded on opening."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token container")
        self.n_ids, self.n_docs, n_levels = struct.unpack_from("<QQB", raw, 8)
        at = 8 + struct.calcsize("<QQB")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.starts = take("<u4", self.n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", raw, at)
            at += 8
            blocks = -(-n // BLOCK_BITS)
            self.levels.append((take("u1", blocks * BLOCK_BITS // 8), take("<u4", blocks), take("u1", n)))

    @staticmethod
    def _rank(bits: np.ndarray, before: np.ndarray, i: int) -> int:
        """Set bits before bit i."""
        block = i // BLOCK_BITS
        if block == len(before):
            return int(before[-1]) + int(np.bitwise_count(bits[-BLOCK_BITS // 8 :]).sum()) if block else 0
        inside = np.unpackbits(bits[block * BLOCK_BITS // 8 : i // 8 + 1], bitorder="little")[: i - block * BLOCK_BITS]
        return int(before[block]) + int(inside.sum())

    def get(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, (bits, before, chunks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not (bits[i // 8] >> (i % 8)) & 1:
                break
            i = self._rank(bits, before, i)
        return value

    def range(self, a: int, b: int) -> np.ndarray:
        """The ids at positions a to b - 1."""
        out = np.zeros(max(0, b - a), np.uint32)
        where = np.arange(len(out))
        for k, (bits, before, chunks) in enumerate(self.levels):
            if b <= a:
                break
            out[where] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * k)
            more = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 :][: b - a].astype(bool)
            where = where[more]
            a = self._rank(bits, before, a)
            b = a + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.range(int(self.starts[k]), int(self.starts[k + 1]))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; made here only in local mode without one, as in tests. A cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: driver and executors need a shared folder")
        import tempfile

        folder = tempfile.mkdtemp(prefix="folio-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def segments(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """shard, segment, n_ids, doc_ids, container: the documents' ids in ascending doc_id order.

    Shards are ranges of doc_id in order (null ids first). Rows with the same doc_id follow one another by a hash of
    their texts, whatever the partitions were, and equal rows, which are told apart by a number, are spread over shards like others; each
    has its own place. Each document's ids end with ``end_id``, so an empty or null text has one id.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, segment = whole_text_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        names: list[pa.Array] = []
        size = 0

        def close() -> pa.RecordBatch:
            per_doc = np.concatenate(counts)
            box = pack(np.concatenate(held), np.concatenate([[0], np.cumsum(per_doc)]))
            ids = pa.concat_arrays(names)
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([size], pa.int64()), lists, pa.array([box], pa.binary())], ["shard", "segment", "n_ids", "doc_ids", "container"])

        for whole in batches:
            for batch in slices(whole, "text"):
                ids, at = encoder.ids(TextBatch.of(batch.column("text")))
                ids, at = np.insert(ids, at[1:], end_id), at + np.arange(len(at))
                held.append(ids)
                counts.append(np.diff(at))
                names.append(batch.column("doc_id"))
                size += len(ids)
                if size >= SEGMENT_IDS:
                    yield close()
                    held, counts, names, size, segment = [], [], [], 0, segment + 1
        if held:
            yield close()

    tied = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("nth"))
    ordered = tied.repartitionByRange("doc_id", "tie", "nth").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return ordered.mapInArrow(run, f"shard int, segment int, n_ids long, doc_ids array<{kind}>, container binary")


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> None:
    """The documents' token file: a Parquet table of segments in ``folder``."""
    segments(docs, tokenizer_path, end_id).write.mode("overwrite").option("compression", "zstd").parquet(folder)


def segment_starts(files: DataFrame) -> DataFrame:
    """shard, segment and the number of ids in all segments before it.

    The running sum goes over one row a shard, and within each shard over its segments, so no task
    meets all segments.
    """
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    places = files.select("shard", "segment", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inner_start"))
    return places.join(shards, "shard").select("shard", "segment", (F.col("shard_start") + F.col("inner_start")).alias("segment_start"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a token file, from the files alone.

    start counts the ids of all documents before it; the checksum is of the little-endian unsigned
    32-bit ids. Containers are read where they are scanned; only the documents' rows are joined.
    """
    files = spark.read.parquet(folder)
    kind = dict(files.dtypes)["doc_ids"].removeprefix("array<")[:-1]
    names = ["shard", "segment", "doc_id", "inner", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                box = Reader(batch.column("container")[r].as_py())
                crcs = [zlib.crc32(box.document(k).astype("<u4")) for k in range(box.n_docs)]
                starts = box.starts.astype(np.int64)
                same = lambda c: pa.array(np.full(box.n_docs, batch.column(c)[r].as_py(), np.int32))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same("shard"), same("segment"), batch.column("doc_ids")[r].values, pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())], names)

    rows = files.select("shard", "segment", "doc_ids", "container").mapInArrow(run, f"shard int, segment int, doc_id {kind}, inner long, n_tokens long, ids_crc32 long")
    return rows.join(segment_starts(files), ["shard", "segment"]).select("doc_id", (F.col("segment_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the documents' token file into the shared folder and read it back.

    No rows: an empty file, no rows. Nulls, ties and repeated rows as in ``segments``.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, folder, tokenizer_path, end_id)
    return read(spark, folder)
