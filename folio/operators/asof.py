"""Nearest rows by position, and icons between the characters of text: joins whose rows grow with the rows, not with their pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from folio.operators import runs


def nearest(rows: DataFrame, others: DataFrame, by: list[str], at: Column, other_at: Column, carried: list[str]) -> DataFrame:
    """rows with near: struct(distance, carried...) of the row of others with the nearest position in the same group; null if the group has none.

    Of equally near ones the smallest by ``carried`` counts. Both sides go through one exchange as one sequence by position; each row looks at the last
    one of others before it and at the next. A row without a position has nothing near; others without one are left out.
    """
    name = F.struct(*carried)
    points = others.select(*by, other_at.cast("double").alias("at"), name.alias("name")).where("at IS NOT NULL").groupBy(*by, "at").agg(F.min("name").alias("name"))
    point = F.struct("at", "name")
    kind = points.select(point.alias("p")).schema["p"].dataType
    row = F.struct(*rows.columns)
    both = points.select(*by, F.col("at"), F.lit(0).alias("side"), point.alias("point"), F.lit(None).cast(rows.select(row.alias("r")).schema["r"].dataType).alias("row"))
    both = both.unionByName(rows.select(*by, at.cast("double").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(kind).alias("point"), row.alias("row")))
    forth, back = Window.partitionBy(*by).orderBy("at", "side"), Window.partitionBy(*by).orderBy(F.desc("at"), F.desc("side"))
    seen = both.withColumn("before", F.last("point", ignorenulls=True).over(forth)).withColumn("after", F.last("point", ignorenulls=True).over(back)).where("side = 1")
    close = lambda p: F.when(F.col(p).isNotNull() & F.col("at").isNotNull(), F.struct(F.abs(F.col("at") - F.col(f"{p}.at")).alias("distance"), F.col(f"{p}.name").alias("name")))
    best = F.least(close("before"), close("after"))
    out = seen.withColumn("best", best)
    near = F.when(F.col("best").isNotNull(), F.struct(F.col("best.distance").alias("distance"), *[F.col(f"best.name.{c}").alias(c) for c in carried]))
    return out.select("row.*", near.alias("near"))


#: Pairs of an icon and a span around it that are held at once.
_PAIRS = 1 << 21


def _first(code: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """For each code, the row that is smallest by keys."""
    order = np.lexsort((*reversed(keys), code))
    return order[np.append(True, code[order][1:] != code[order][:-1])] if len(order) else order


@dataclass
class _Lines:
    """Spans and icons of whole lines, by the number of their line; ``name`` is an id's place in the order of ids."""

    line: np.ndarray
    x0: np.ndarray
    x1: np.ndarray
    size: np.ndarray
    name: np.ndarray
    icon_line: np.ndarray
    x: np.ndarray
    icon: np.ndarray  # rows of one icon_id of a line have one number

    def _candidates(self, icon: np.ndarray, span: np.ndarray, offset: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, ...]:
        left = np.where(np.isnan(self.x0), -np.inf, self.x0)[span]
        best = _first(self.icon[icon], [distance, left, self.name[span], offset])
        return icon[best], span[best], offset[best], distance[best]

    def _ends(self, icons: np.ndarray, spans: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Each icon with the nearest ends of spans before and after it."""
        at, span = np.concatenate([self.x0[spans], self.x1[spans]]), np.concatenate([spans, spans])
        offset = np.concatenate([np.zeros(len(spans), np.int64), self.size[spans]])
        known = ~np.isnan(at)
        at, span, offset = at[known], span[known], offset[known]
        left = np.where(np.isnan(self.x0), -np.inf, self.x0)[span]
        order = np.lexsort((offset, self.name[span], left, at, self.line[span]))
        at, span, offset = at[order], span[order], offset[order]
        new = np.append(True, (at[1:] != at[:-1]) | (self.line[span][1:] != self.line[span][:-1]))[: len(at)]
        at, span, offset = at[new], span[new], offset[new]
        line = np.concatenate([self.line[span], self.icon_line[icons]])
        order = np.lexsort((np.arange(len(line)) >= len(at), np.concatenate([at, self.x[icons]]), line))
        place = np.arange(len(order))
        is_end = order < len(at)
        before = np.maximum.accumulate(np.where(is_end, place, -1))
        after = np.minimum.accumulate(np.where(is_end, place, len(order))[::-1])[::-1]
        for near in (before, after):
            mine = np.flatnonzero(~is_end & (near >= 0) & (near < len(order)))
            mine = mine[line[order[mine]] == line[order[near[mine]]]]
            end, icon = order[near[mine]], icons[order[mine] - len(at)]
            yield icon, span[end], offset[end], np.abs(self.x[icon] - at[end])

    def _inside(self, icons: np.ndarray, spans: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Each icon with the two gaps around it of each span that it is in."""
        spans = spans[self.x1[spans] >= self.x0[spans]]
        line = np.concatenate([self.line[spans], self.icon_line[icons], self.line[spans]])
        at = np.concatenate([self.x0[spans], self.x[icons], self.x1[spans]])
        side = np.repeat([0, 1, 2], [len(spans), len(icons), len(spans)])
        order = np.lexsort((side, at, line))
        seen = np.empty(len(order), np.int64)
        seen[order] = np.cumsum(side[order] == 1)
        icons = icons[order[side[order] == 1] - len(spans)]
        low, n = seen[: len(spans)], seen[len(spans) + len(icons) :] - seen[: len(spans)]
        upto = np.cumsum(n)
        cuts = np.unique(np.searchsorted(upto, np.arange(0, upto[-1] + _PAIRS, _PAIRS)).clip(0, len(spans))) if len(n) else [0]
        cuts = np.unique([*cuts, 0, len(spans)])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = n[a:b]
            span = np.repeat(spans[a:b], own)
            icon = icons[np.arange(len(span)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(low[a:b], own)]
            x, x0, x1, size = self.x[icon], self.x0[span], self.x1[span], self.size[span]
            wide = x1 - x0
            lower = np.minimum(np.floor(np.divide((x - x0) * size, wide, out=np.zeros(len(x)), where=wide != 0)).astype(np.int64), size)
            for offset in (lower, np.minimum(lower + 1, size)):
                yield icon, span, offset, np.abs(x - (x0 + offset / size * wide))

    def placed(self) -> tuple[np.ndarray, ...]:
        """A row of each icon number that has a gap, and the span and the offset of that."""
        icons, spans = np.flatnonzero(~np.isnan(self.x)), np.flatnonzero(self.size > 0)
        found = [self._candidates(*c) for part in (self._ends, self._inside) for c in part(icons, spans)]
        icon, span, offset, _ = self._candidates(*map(np.concatenate, zip(*found, strict=True)))
        return icon, span, offset


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.float64)


_BY = ["page_id", "line"]


def _packed_lines(spans: DataFrame, icons: DataFrame, text: bool) -> tuple[DataFrame, list[tuple[str, pa.Schema]]]:
    """Spans and icons (s, i: compressed values, see ``runs.squeezed``), rows of one line one after another; and the columns in each. Spans have their text, or else its size."""
    more = F.col("text") if text else F.coalesce(F.length("text"), F.lit(0)).alias("size")
    s = spans.select(*_BY, "span_id", F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"), more)
    i = icons.select(*_BY, "icon_id", F.col("x").cast("double").alias("x"))
    inner = [(name, to_arrow_schema(StructType([f for f in df.schema if f.name not in _BY]))) for name, df in (("s", s), ("i", i))]
    return runs.dealt(runs.squeezed(s, _BY, "s").unionByName(runs.squeezed(i, _BY, "i"), allowMissingColumns=True), _BY), inner


def _whole_lines(batches: Iterator[pa.RecordBatch], inner: list[tuple[str, pa.Schema]]) -> Iterator[pa.RecordBatch]:
    """Whole lines with the columns of their spans and icons as arrays."""
    for batch in runs.whole_groups(batches, _BY):
        columns = [a for name, schema in inner for a in runs.spread(batch.column(name), schema)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _BY), *columns], [*_BY, *(n for _, schema in inner for n in schema.names)])


@dataclass
class _Placed:
    """Whole lines with the gap of each icon: ``key(groups)`` gives the columns of lines, icon_of and span_of rows of the arrays."""

    batch: pa.RecordBatch
    first: np.ndarray
    span_id: pa.Array
    icon_id: pa.Array
    lines: _Lines
    icon: np.ndarray
    span: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Placed:
        first = runs.starts_of(batch, _BY)
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, batch.num_rows)))
        span_id, line = runs.flat(batch, "span_id", group)
        icon_id, icon_line = runs.flat(batch, "icon_id", group)
        names = runs.ranks(icon_id) + 1
        icon = icon_line * (int(names.max(initial=0)) + 1) + names
        part = lambda c: _numbers(batch.column(c).flatten())
        size = part("size") if "size" in batch.schema.names else _numbers(pc.fill_null(pc.utf8_length(batch.column("text").flatten()), 0))
        lines = _Lines(line, part("x0"), part("x1"), size.astype(np.int64), runs.ranks(span_id), icon_line, part("x"), icon)
        return cls(batch, first, span_id, icon_id, lines, *lines.placed())

    def key(self, groups: np.ndarray) -> list[pa.Array]:
        return [self.batch.column(c).take(pa.array(self.first[groups])) for c in _BY]


def gaps(spans: DataFrame, icons: DataFrame, width: float = 64.0) -> DataFrame:
    """page_id, line, icon_id, span_id, offset: the gap between characters (or end of a span) of the icon's line that is nearest to its x.

    Characters of a span are equally wide. The spans that an icon is in are found from one sequence by position; else the nearest gap is an end of
    a span, found likewise. Of equally near gaps the leftmost span's first one counts. Spans without text have no gap, so an icon of a line
    without text is in no row. Both sides are exchanged once, packed by line. ``width`` has no effect any more; callers may give it.
    """

    rows, within = _packed_lines(spans, icons, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_lines(batches, within):
            p = _Placed.of(batch)
            columns = [*p.key(p.lines.icon_line[p.icon]), p.icon_id.take(pa.array(p.icon)), p.span_id.take(pa.array(p.span)), pa.array(p.offset.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*_BY, "icon_id", "span_id", "offset"])

    schema = StructType([*(icons.schema[c] for c in (*_BY, "icon_id")), spans.schema["span_id"], StructField("offset", IntegerType())])
    return rows.mapInArrow(run, schema)


def icons_in_text(spans: DataFrame, icons: DataFrame, width: float = 64.0) -> DataFrame:
    """page_id, line, span_id, nth, type, text, icon_id: spans cut where icons stand, with the icons between the pieces; empty pieces are left out.

    spans: page_id, line, span_id, text, x0, x1. icons: page_id, line, icon_id, x (their centre). Icons of one gap stand by x, then by id.
    """
    rows_by_line, within = _packed_lines(spans, icons, True)
    names = [*_BY, "span_id", "nth", "type", "text", "icon_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_lines(batches, within):
            p = _Placed.of(batch)
            n = p.lines
            texts = batch.column("text").flatten()
            span_key = n.line * (int(n.name.max(initial=0)) + 2) + n.name + 1
            # All rows of an icon's id stand at its gap, in all rows of the span's id.
            order = np.argsort(n.icon[p.icon])
            known = n.icon[p.icon][order]
            at = np.searchsorted(known, n.icon)
            rows = np.flatnonzero(at < len(known))
            rows = rows[known[at[rows]] == n.icon[rows]]
            chosen = order[at[rows]]
            by_cut = np.lexsort((n.icon[rows], np.where(np.isnan(n.x), -np.inf, n.x)[rows], p.offset[chosen], span_key[p.span[chosen]]))
            rows, chosen = rows[by_cut], chosen[by_cut]
            target, offset = span_key[p.span[chosen]], p.offset[chosen]
            low, high = np.searchsorted(target, span_key), np.searchsorted(target, span_key, "right")
            plain = np.flatnonzero((low == high) & (n.size > 0))
            whole = [*p.key(n.line[plain]), p.span_id.take(pa.array(plain)), pa.array(np.zeros(len(plain), np.int32)), pa.repeat("text", len(plain)), texts.take(pa.array(plain)), pa.nulls(len(plain), pa.string())]
            yield pa.RecordBatch.from_arrays(whole, names)
            cut = np.flatnonzero(low < high)
            icon_id = p.icon_id.take(pa.array(rows)).cast(pa.string()).to_pylist()
            own, nth, kinds, pieces, inner = [], [], [], [], []
            for s, text, a, b in zip(cut.tolist(), texts.take(pa.array(cut)).to_pylist(), low[cut].tolist(), high[cut].tolist(), strict=True):
                places = [0, *offset[a:b].tolist(), len(text)]
                parts = []
                for k in range(b - a + 1):
                    if piece := text[places[k] : places[k + 1]]:
                        parts.append(("text", piece, None))
                    if k < b - a:
                        parts.append(("icon", None, icon_id[a + k]))
                own += [s] * len(parts)
                nth += range(len(parts))
                for kind, piece, icon in parts:
                    kinds.append(kind)
                    pieces.append(piece)
                    inner.append(icon)
            of = np.array(own, np.int64)
            yield pa.RecordBatch.from_arrays([*p.key(n.line[of]), p.span_id.take(pa.array(of)), pa.array(nth, pa.int32()), pa.array(kinds, pa.string()), pa.array(pieces, pa.string()), pa.array(inner, pa.string())], names)

    more = [StructField("nth", IntegerType()), StructField("type", StringType()), StructField("text", StringType()), StructField("icon_id", StringType())]
    return rows_by_line.mapInArrow(run, StructType([*(spans.schema[c] for c in (*_BY, "span_id")), *more]))
