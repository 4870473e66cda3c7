"""Whole batches of text as byte arrays.

Every text operator of this subpackage works on Arrow batches. The helpers here view the UTF-8
bytes of a batch as one numpy array with document offsets, find words and lines in it, and hash
spans of it, without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import SparkSession

#: Bytes of text that the helpers handle at once; larger Arrow batches are cut by documents.
SLICE_BYTES = 2 << 20

#: Rows of an Arrow batch for tables of texts, so that JVM and worker hold some megabytes of them at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 2 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LONG_SPAN = 64

_is_sep = np.zeros(256, bool)
_is_sep[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32

def _powers_of(step: np.uint64) -> np.ndarray:
    """Powers of the hash base (or of its inverse) modulo 2^64, for all places of a slice."""
    steps = np.full(SLICE_BYTES + _LONG_SPAN + 1, step, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


@cache
def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    return _powers_of(_BASE), _powers_of(_BASE_INV)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash, so that its high bits spread evenly."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class TextBatch:
    """The texts of some rows as one byte array; a null text counts as empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    @classmethod
    def of(cls, column: pa.Array | pa.ChunkedArray | list) -> TextBatch:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if not isinstance(column, pa.Array):
            column = pa.array(column, pa.string())
        column = column.cast(pa.large_binary()).fill_null(b"")
        _, off, data = column.buffers()
        offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        return cls(raw[offsets[0] : offsets[-1]], offsets - offsets[0])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def lowered(self) -> TextBatch:
        """A-Z in lower case, all else as it is."""
        return TextBatch(_lower[self.data], self.offsets)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, "right") - 1

    def per_doc(self, positions: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """For each document, how many of the (sorted) positions lie in it, or the sum of their weights."""
        cuts = np.searchsorted(positions, self.offsets)
        if weights is None:
            return np.diff(cuts)
        sums = np.concatenate([[0], np.cumsum(weights)])
        return sums[cuts[1:]] - sums[cuts[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes other than 0x20 and 0x09-0x0D, cut at documents."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        inside = ~_is_sep[self.data]
        first = np.zeros(len(self.data) + 1, bool)
        first[self.offsets] = True
        before = np.concatenate([[False], inside[:-1]])
        after = np.concatenate([inside[1:], [False]])
        starts = np.flatnonzero(inside & (~before | first[:-1]))
        ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        return starts, ends

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span (in order of their starts); equal spans have equal hashes, wherever they stand.

        A polynomial modulo 2^64 from running sums, some megabytes at a time; long spans are hashed
        one by one.
        """
        up, down = _power_tables()
        out = np.empty(len(starts), np.uint64)
        long = ends - starts > _LONG_SPAN
        at = 0
        while at < len(starts):
            base = int(starts[at])
            to = int(np.searchsorted(starts, base + SLICE_BYTES))
            s = starts[at:to] - base
            e = np.where(long[at:to], starts[at:to], ends[at:to]) - base
            n = int(e.max())
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data[base : base + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
            out[at:to] = mix((sums[e] - sums[s]) * down[s])
            at = to
        for i in np.flatnonzero(long):
            out[i] = xxhash.xxh64_intdigest(self.data[starts[i] : ends[i]].tobytes(), 7)
        return out


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows with about ``most`` bytes of text at most (one row at least)."""
    offsets = TextBatch.of(batch.column(column)).offsets
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows and about BATCH_BYTES; for applications over tables of texts, where long ones would add up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
