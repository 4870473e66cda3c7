"""Packing documents into fixed windows, by the sum-of-squares rule (operator 8).

Full windows are cut from a document as it comes. The remainder is placed online: among the fill
levels that have an open window with room (and level 0, a new window) the one is taken after which
the sum of the squared numbers of open windows per level is smallest. The level array holds these
numbers. At the end of a task its open windows are merged by cutting the emptiest into the fullest,
and what is left, less than one window, is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from folio.llm.pieces import whole_text_encoder
from folio.llm.textarrays import TextBatch, slices

#: A piece: its document's row in the task, its start there, and its ids.
Piece = tuple[int, int, np.ndarray]


class SquaresPacker:
    """Windows of ``capacity`` tokens; yields a window's pieces when it is closed."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, np.int64)  # the level array: open windows per fill level
        self._windows: dict[int, list[list[Piece]]] = defaultdict(list)

    def level_for(self, size: int) -> int:
        """The fill level at which a piece of this size leaves the smallest sum of squares; ties go to the fullest.

        Moving a window from level h to h + size changes the sum by 2 (open[h + size] - open[h] + 1);
        levels 0 and capacity hold no open windows and count as nothing.
        """
        last = self.capacity - size
        here, there = self.open[: last + 1], self.open[size:]
        change = 2 * (there - here) + 2
        change[0] = 2 * there[0] + 1
        if last:
            change[last] = 1 - 2 * here[last]
        else:
            change[0] = 0
        change[(here == 0) & (np.arange(last + 1) > 0)] = np.iinfo(np.int64).max
        return last - int(np.argmin(change[::-1]))

    def place(self, piece: Piece) -> Iterator[list[Piece]]:
        size = len(piece[2])
        level = self.level_for(size)
        window = self._windows[level].pop() if level else []
        if level:
            self.open[level] -= 1
        window.append(piece)
        if level + size == self.capacity:
            yield window
        else:
            self.open[level + size] += 1
            self._windows[level + size].append(window)

    def add(self, row: int, ids: np.ndarray) -> Iterator[list[Piece]]:
        """A document: full windows first, then its remainder by the rule."""
        full = len(ids) // self.capacity * self.capacity
        for at in range(0, full, self.capacity):
            yield [(row, at, ids[at : at + self.capacity])]
        if full < len(ids):
            yield from self.place((row, full, ids[full:].copy()))

    def finish(self) -> Iterator[list[Piece]]:
        """Close what is open: pieces of the emptiest windows fill the fullest, and the last one is cut at powers of two."""
        rest = [w for level in sorted(self._windows) for w in self._windows[level]]
        self._windows.clear()
        self.open[:] = 0
        queue = [piece for window in rest[::-1] for piece in window][::-1]
        left = sum(len(p[2]) for p in queue)

        def fill(size: int) -> list[Piece]:
            window: list[Piece] = []
            while size:
                row, start, ids = queue.pop()
                if len(ids) > size:
                    queue.append((row, start + size, ids[size:]))
                    ids = ids[:size]
                window.append((row, start, ids))
                size -= len(ids)
            return window

        while left:
            size = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= size
            yield fill(size)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row a piece.

    A map over the scan's partitions: each task packs its own documents and keeps its open windows
    only, so nothing is shuffled. A sequence's id is the task's partition and a number in it, so a
    repeated task gives the same ids. A null text counts as empty and holds ``end_id`` alone; ties
    and repeated rows are documents of their own; no rows give no sequences.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = whole_text_encoder(tokenizer_path), SquaresPacker(capacity)
        sequence = TaskContext.get().partitionId() << 36
        names: dict[int, tuple[object, int]] = {}  # of documents with an open piece: doc_id and tokens
        row = 0
        out: list[tuple] = []

        def put(window: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids in window:
                name, tokens = names[doc]
                out.append((name, start, len(ids), zlib.crc32(ids.astype("<u4")), tokens, sequence, offset))
                offset += len(ids)
            sequence += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            kinds = [id_type, *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

        for whole in batches:
            id_type = whole.column("doc_id").type
            for batch in slices(whole, "text"):
                ids, at = encoder.ids(TextBatch.of(batch.column("text")))
                ids, at = np.insert(ids, at[1:], end_id), at + np.arange(len(at))
                for name, a, b in zip(batch.column("doc_id").to_pylist(), at.tolist(), at[1:].tolist(), strict=False):
                    names[row] = (name, b - a)
                    for window in packer.add(row, ids[a:b]):
                        put(window)
                    row += 1
                still = {p[0] for level in packer._windows.values() for w in level for p in w}
                names = {k: v for k, v in names.items() if k in still}
                if out:
                    yield flush()
        for window in packer.finish():
            put(window)
        if out:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
