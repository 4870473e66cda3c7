"""Rows of one group packed into arrays before they are exchanged, and groups taken whole, many at once, behind the exchange."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType


def starts_of(batch: pa.RecordBatch, by: list[str]) -> np.ndarray:
    """Where runs of rows with equal ``by`` start; nulls equal one another."""
    change = np.zeros(batch.num_rows, bool)
    change[:1] = True
    for c in by:
        code = pc.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(change)


def packed(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each run of neighbouring rows with equal ``by`` (within an Arrow batch); the other columns become arrays, in the rows' order.

    A group whose rows stand together goes through an exchange as a few rows, with its key once in each.
    """
    rest = [c for c in rows.columns if c not in by]
    schema = StructType([*(rows.schema[c] for c in by), *(StructField(c, ArrayType(rows.schema[c].dataType)) for c in rest)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                starts = starts_of(batch, by)
                offsets = pa.array(np.append(starts, batch.num_rows).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in rest]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(starts)) for c in by), *lists], [*by, *rest])

    return rows.select(*by, *rest).mapInArrow(run, schema)


def _planes(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _from_planes(raw: bytes, at: int, n: int, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T).view(kind).ravel()


_SIZE = np.dtype(np.int32)


def squeeze(batches: Iterator[pa.RecordBatch], by: list[str], rest: list[str], name: str) -> Iterator[pa.RecordBatch]:
    """by and name, the other columns as one value, for each run of rows with equal ``by``."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = []
        for c in rest:
            values = batch.column(c)
            known = values.is_valid().to_numpy(zero_copy_only=False)
            if pa.types.is_string(values.type):
                wide = values.cast(pa.large_binary()).fill_null(b"")
                ends = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
                columns.append((np.where(known, np.diff(ends), -1).astype(_SIZE), ends, wide.buffers()[2] or b""))
            else:
                columns.append((values.fill_null(0).to_numpy(zero_copy_only=False), known.astype(np.int8), None))
        starts = starts_of(batch, by)
        values = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            parts = [np.array(b - a, _SIZE).tobytes()]
            for numbers, more, data in columns:
                parts += [_planes(numbers[a:b]), more[a:b].tobytes() if data is None else memoryview(data)[int(more[a]) : int(more[b])]]
            values.append(press.compress(b"".join(parts)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(starts)) for c in by), pa.array(values, pa.binary())], [*by, name])


def squeezed(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """by, name: ``packed``, with the other columns (strings, or numbers of a fixed width) of a run as one compressed value, for wide rows that would fill the disk.

    Sizes of strings (-1 for null) and numbers go in as planes of bytes. ``spread`` gives the arrays back.
    """
    rest = [c for c in rows.columns if c not in by]
    schema = StructType([*(rows.schema[c] for c in by), StructField(name, BinaryType())])
    return rows.select(*by, *rest).mapInArrow(lambda batches: squeeze(batches, by, rest, name), schema)


def spread(values: pa.Array, schema: pa.Schema) -> list[pa.ListArray]:
    """An array for each column that ``squeezed`` took together, of the types in schema; a null value has empty ones."""
    press = zstandard.ZstdDecompressor()
    sizes = np.zeros(len(values) + 1, np.int32)
    parts: list[list[np.ndarray]] = [[] for _ in schema]
    marks: list[list] = [[] for _ in schema]
    for i, value in enumerate(values):
        if not value.is_valid:
            continue
        raw = press.decompress(value.as_buffer())
        n = int(np.frombuffer(raw, _SIZE, 1)[0])
        sizes[i + 1], at = n, _SIZE.itemsize
        for k, field in enumerate(schema):
            text = pa.types.is_string(field.type)
            kind = _SIZE if text else np.dtype(field.type.to_pandas_dtype())
            parts[k].append(_from_planes(raw, at, n, kind))
            at += n * kind.itemsize
            more = int(np.maximum(parts[k][-1], 0).sum()) if text else n
            marks[k].append(raw[at : at + more])
            at += more
    ends = pa.array(np.cumsum(sizes, dtype=np.int32))
    out = []
    for part, mark, field in zip(parts, marks, schema, strict=True):
        if pa.types.is_string(field.type):
            length = np.concatenate(part) if part else np.zeros(0, _SIZE)
            offsets = np.append(0, np.cumsum(np.maximum(length, 0)))
            whole = pa.Array.from_buffers(pa.large_string(), len(length), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(b"".join(mark))]).cast(pa.string())
            known = length >= 0
        else:
            whole = pa.array(np.concatenate(part) if part else np.zeros(0, field.type.to_pandas_dtype()), field.type)
            known = np.frombuffer(b"".join(mark), np.int8) > 0
        out.append(pa.ListArray.from_arrays(ends, whole if known.all() else pc.if_else(pa.array(known), whole, pa.scalar(None, field.type))))
    return out


def dealt(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with those of each group one after another in one partition."""
    return rows.repartition(*by).sortWithinPartitions(*by)


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows again, cut so that each batch holds whole groups, for rows that ``dealt`` has put in order."""
    held: list[pa.RecordBatch] = []

    def joined() -> Iterator[pa.RecordBatch]:
        if held:
            yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()

    key = lambda b, i: [b.column(c)[i].as_py() for c in by]
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and key(held[-1], held[-1].num_rows - 1) != key(batch, 0):
            yield from joined()
        last = int(starts_of(batch, by)[-1])
        if last:
            held.append(batch.slice(0, last))
            yield from joined()
        held.append(batch.slice(last))
    yield from joined()


def merged(lists: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group of rows whose other columns are arrays: the arrays one after another, in no particular order. No aggregate, so no rows are held but one batch's."""
    rest = [c for c in lists.columns if c not in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, by):
            first = starts_of(batch, by)
            columns = [batch.column(c).take(pa.array(first)) for c in by]
            for c in rest:
                sizes = pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
                ends = np.append(0, np.cumsum(sizes))
                columns.append(pa.ListArray.from_arrays(pa.array(ends[np.append(first, batch.num_rows)].astype(np.int32)), batch.column(c).flatten()))
            yield pa.RecordBatch.from_arrays(columns, [*by, *rest])

    return dealt(lists.select(*by, *rest), by).mapInArrow(run, lists.select(*by, *rest).schema)


def gathered(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group, with its other columns as arrays of like order; a group's rows are exchanged packed."""
    return merged(packed(rows, by), by)


def flat(batch: pa.RecordBatch, column: str, group: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All items of an array column, and the group of each; a null array has none."""
    lists = batch.column(column)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(group, sizes)


def ranks(values: pa.Array) -> np.ndarray:
    """The place of each value among the distinct ones in their order (of bytes, for strings); -1 for null."""
    found = values.dictionary_encode()
    names = found.dictionary
    order = pc.array_sort_indices(names.cast(pa.large_binary()) if pa.types.is_string(names.type) else names).to_numpy()
    rank = np.empty(len(names) + 1, np.int64)
    rank[order] = np.arange(len(names))
    rank[-1] = -1
    return rank[pc.fill_null(found.indices, len(names)).to_numpy(zero_copy_only=False)]


def folded(rows: DataFrame, by: list[str], fold: Callable[[list[dict]], list[dict]], schema: StructType) -> DataFrame:
    """What ``fold`` makes of the rows of each group, given as dicts; groups are exchanged packed, and many are handed on at once."""
    rest = [c for c in rows.columns if c not in by]
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, by):
            first = starts_of(batch, by)
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, batch.num_rows)))
            sizes = np.bincount(np.repeat(group, pc.list_value_length(batch.column(rest[0])).to_numpy(zero_copy_only=False)), minlength=len(first))
            of = pa.array(np.repeat(first, sizes))
            flat_rows = pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in by), *(batch.column(c).flatten() for c in rest)], [*by, *rest]).to_pylist()
            out, at = [], 0
            for size in sizes.tolist():
                out += fold(flat_rows[at : at + size])
                at += size
            yield pa.RecordBatch.from_pylist(out, schema=types)

    return dealt(packed(rows, by), by).mapInArrow(run, schema)
