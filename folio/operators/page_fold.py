"""A page's blocks from its spans in one pass: a table function that keeps the state of the page it reads.

Spans, pictures and icons of a page come as rows in one order, through one exchange. Lines close as soon as the next span leaves them;
what waits for the page's end is the blocks made so far, since a heading's level depends on all headings of the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from folio.functions import text as T


class Fonts(NamedTuple):
    """Font names by what they say about a span, and the sizes and heights at which that holds."""

    heading: Sequence[str] = ()
    decorative: Sequence[str] = ()
    bold: str = ""
    italic: str = ""
    bold_italic: str = ""
    dingbat: str = ""
    footer_y: float = 790.0
    heading_size: float = 8.0
    subheading_size: float = 10.0
    body_size: float = 7.5


class Limits(NamedTuple):
    """Points that two spans of a line differ by at most, gaps that split words and paragraphs, and characters of a paragraph."""

    line: float = 3.0
    word_gap: float = 1.5
    gap_factor: float = 1.5
    gap: float = 12.0
    icon_reach: float = 5.0
    most_chars: int = 600


MARKS = {"bold": ["bold"], "subheading": ["bold"], "italic": ["italic"], "bold_italic": ["bold", "italic"]}
HEADINGS = {"heading", "subheading"}
UNSEEN = {"footer", "diagram_label"}
SHOWN = ("heading", "paragraph", "list_item")

_CHILD = "struct<type:string,text:string,marks:array<string>,symbol_id:string,instance_id:string>"
_BLOCKS = f"page_id string, block_id string, pos int, kind string, level int, x0 double, y0 double, x1 double, y1 double, children array<{_CHILD}>"


def with_roles(spans: DataFrame, fonts: Fonts) -> DataFrame:
    """spans with role: the first rule on place, font and size that holds."""
    font, size = F.col("font_name"), F.col("font_size")
    of_heading = font.isin(list(fonts.heading))
    role = (
        F.when(F.col("y0") >= fonts.footer_y, "footer")
        .when(of_heading & (size >= fonts.heading_size), "heading")
        .when(font.isin(list(fonts.decorative)), "decorative")
        .when(of_heading & (size < fonts.body_size), "diagram_label")
        .when((font == fonts.bold) & (size >= fonts.subheading_size), "subheading")
        .when(font == fonts.dingbat, "bullet")
        .when(font == fonts.italic, "italic")
        .when(font == fonts.bold, "bold")
        .when(font == fonts.bold_italic, "bold_italic")
        .otherwise("body")
    )
    return spans.withColumn("role", role)


_PREFIXES = frozenset(T.COMPOUND_PREFIXES)


def tidy(text: str) -> str:
    """What T.normalize does, for one string."""
    text = re.sub(T.CONTROL, "", text)
    text = re.sub("([a-zA-Z]+)- ([a-z])", lambda m: m[1] + ("-" if m[1].lower() in _PREFIXES else "") + m[2], text)
    return re.sub("([a-z])([.!?])([A-Z])", r"\1\2 \3", text)


class Child(NamedTuple):
    type: str
    text: str | None = None
    marks: list[str] | None = None
    symbol_id: str | None = None
    instance_id: str | None = None


class Block:
    """A block that may still grow: kind, number on the page, box, children; size is a heading's largest font."""

    def __init__(self, kind: str, number: int, box: tuple | None, children: list[Child], size: float | None = None):
        self.kind, self.number, self.box, self.children, self.size, self.suffix, self.level = kind, number, box, children, size, "", None

    @property
    def text(self) -> str:
        return "".join(c.text for c in self.children if c.text is not None and c.type == "text")


def around(boxes: Sequence) -> tuple | None:
    """The box around all of these (with x0, y0, x1, y1)."""
    return (min(b.x0 for b in boxes), min(b.y0 for b in boxes), max(b.x1 for b in boxes), max(b.y1 for b in boxes)) if boxes else None


class Page:
    """The state of a page while its rows come."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.icons: list = []
        self.figures: list = []
        self.line: list = []
        self.paragraph: list = []
        self.table: tuple[int, list[list]] | None = None
        self.blocks: list[Block] = []
        self.number = 0
        self.sizes: set[float] = set()

    def _open(self, kind: str, box: tuple | None, children: list[Child], size: float | None = None) -> None:
        self.number += 1
        if children:
            self.blocks.append(Block(kind, self.number, box, children, size))

    def add(self, span) -> None:
        if self.line and abs(self.line[-1].y0 - span.y0) >= self.limits.line:
            self.close_line()
        self.line.append(span)

    def apart(self, before: str, after: str, a, b) -> bool:
        """Whether a space is due between two texts: none there yet, and a gap between their spans."""
        return bool(before) and bool(after) and not before[-1].isspace() and not after[0].isspace() and abs(b.x0 - a.x1) > self.limits.word_gap

    def inlines(self, spans: Sequence) -> list[Child]:
        """Texts of spans; neighbours with the same marks are one."""
        out: list[tuple[str, list[str]]] = []
        last = None
        for span in spans:
            text, marks = span.text or "", MARKS.get(span.role, [])
            if not text.strip():
                continue
            if out and self.apart(out[-1][0], text, last, span):
                text = " " + text
            if out and out[-1][1] == marks:
                out[-1] = (out[-1][0] + text, marks)
            else:
                out.append((text, marks))
            last = span
        return [Child("text", tidy(t), marks) for t, marks in out]

    def with_icons(self, spans: Sequence) -> list[Child]:
        """Texts of a paragraph line by line, with the icons of each line before the text that reaches beyond them."""
        lines: list[list] = []
        for span in spans:
            if lines and abs(lines[-1][-1].y0 - span.y0) < self.limits.line:
                lines[-1].append(span)
            else:
                lines.append([span])
        out: list[Child] = []
        before = None
        for line in lines:
            texts = self.inlines(line)
            if not texts:
                continue
            if out and out[-1].type == "text" and self.apart(out[-1].text, texts[0].text, before, line[0]):
                texts[0] = texts[0]._replace(text=" " + texts[0].text)
            _, top, _, bottom = around(line)
            reach = self.limits.icon_reach
            due = sorted((i for i in self.icons if i.y0 >= top - reach and i.y1 <= bottom + reach), key=lambda i: i.x0)
            known = [s for s in line if s.text]
            width = sum(s.x1 - s.x0 for s in known) / sum(len(s.text) for s in known) if known else 10.0
            x = min(s.x0 for s in line)
            for text in texts:
                while due and due[0].x0 <= x:
                    out.append(self.icon(due.pop(0)))
                out.append(text)
                x += len(text.text) * width
            out += map(self.icon, due)
            before = line[-1]
        return out

    @staticmethod
    def icon(row) -> Child:
        return Child("icon", None, None, row.symbol_id, row.instance_id)

    def close_paragraph(self) -> None:
        spans, self.paragraph = self.paragraph, []
        if spans:
            texts = self.inlines(spans)
            self._open("paragraph", around(spans), self.with_icons(spans) if texts and self.icons else texts)

    def close_table(self) -> None:
        rows = self.table[1] if self.table else []
        self.table = None
        if rows:
            children: list[Child] = []
            for k, row in enumerate(rows):
                children += [Child("line_break")] * (k > 0) + self.inlines(row)
            self.number += 1
            self.blocks.append(Block("table", self.number, around([s for row in rows for s in row]), children))

    def close_line(self) -> None:
        line, self.line = self.line, []
        if not line:
            return
        roles = {s.role for s in line}
        heading = bool(roles & HEADINGS) and "body" not in roles
        title = tidy("".join(s.text or "" for s in line if s.role != "decorative").strip()) if heading else ""
        step = bool(re.match(T.STEP_NUMBER, title))
        size = max(s.font_size or 0.0 for s in line)
        if title and not step:
            self.sizes.add(size)
        regions = [s.table_region for s in line if s.table_region is not None and s.table_region >= 0]
        region = next((r for r in sorted(set(regions)) if 2 * regions.count(r) > len(line)), None)
        if region is not None:
            if self.table is None:
                self.close_paragraph()
            elif self.table[0] != region:
                self.close_table()
            self.table = (region, [*(self.table[1] if self.table else []), line])
            return
        self.close_table()
        if heading:
            self.close_paragraph()
            if title:
                self._open("list_item" if step else "heading", around(line), [Child("text", title, [])], None if step else size)
        elif roles == {"decorative"}:
            return
        elif "bullet" in roles:
            self.close_paragraph()
            rest = [s for s in line if s.role != "bullet"]
            self._open("list_item", around(rest), self.inlines(rest))
        else:
            if self.paragraph:
                font = line[0].font_size or self.paragraph[-1].font_size or 0.0
                if abs(line[0].y0 - self.paragraph[-1].y1) > (font * self.limits.gap_factor if font > 0 else self.limits.gap):
                    self.close_paragraph()
            self.paragraph += line

    def close(self, finish: bool) -> list[Block]:
        self.close_line()
        self.close_table()
        self.close_paragraph()
        for figure in self.figures:
            self._open("figure", around([figure]), [Child("figure", None, None, figure.symbol_id)])
        largest = sorted(self.sizes, reverse=True)
        base = 0 if not largest else 1 if largest[0] >= 14 else 2 if largest[0] >= 10 else 3
        for block in self.blocks:
            if block.kind == "heading":
                block.level = min(base + largest.index(block.size), 6)
        return self.finished() if finish else self.blocks

    def finished(self) -> list[Block]:
        return one_icon_each(without_repeats(cut_long(joined_items(self.blocks), self.limits.most_chars)))


def joined_items(blocks: list[Block]) -> list[Block]:
    """A list item takes in the paragraphs that follow within 20 points of its growing box, if it is a mere number or they are indented as far."""
    out: list[Block] = []
    for b in blocks:
        item = out[-1] if out and out[-1].kind == "list_item" else None
        if item is not None and b.kind == "paragraph" and item.box and b.box and -5.0 <= b.box[1] - item.box[3] <= 20.0 and (len(item.text.strip()) <= 5 or b.box[0] >= item.box[0] - 5.0):
            last = item.children[-1]
            if last.type == "text" and last.text and not last.text[-1].isspace():
                item.children[-1] = last._replace(text=last.text + " ")
            item.children += b.children
            item.box = (min(item.box[0], b.box[0]), min(item.box[1], b.box[1]), max(item.box[2], b.box[2]), max(item.box[3], b.box[3]))
        else:
            out.append(b)
    return out


def cut_long(blocks: list[Block], most: int) -> list[Block]:
    """Paragraphs of more than ``most`` characters are cut at the last sentence boundary within that many, as often as it takes; icons stay with the text before them."""
    out: list[Block] = []
    for b in blocks:
        part, rest = 0, b
        while b.kind == "paragraph" and len(rest.text) > most:
            ends = [m.start() + 2 for m in re.finditer(T.SENTENCE_BOUNDARY, rest.text[:most])]
            if not ends:
                break
            first, left = [], []
            room = ends[-1]
            for c in rest.children:
                n = len(c.text) if c.type == "text" else 0
                if room <= 0:
                    left.append(c)
                elif n <= room:
                    first.append(c)
                else:
                    first.append(c._replace(text=c.text[:room]))
                    left.append(c._replace(text=c.text[room:]))
                room -= n
            head = Block("paragraph", b.number, b.box, first)
            rest = Block("paragraph", b.number, b.box, left)
            head.suffix = f".{part}" if part else ""
            out.append(head)
            part += 1
            rest.suffix = f".{part}"
        out.append(rest)
    return out


def without_repeats(blocks: list[Block]) -> list[Block]:
    out: list[Block] = []
    for b in blocks:
        if not (out and out[-1].text and out[-1].text[:80] == b.text[:80]):
            out.append(b)
    return out


def one_icon_each(blocks: list[Block]) -> list[Block]:
    """Of an icon instance in several places the first one in a block that readers see stays, else the first."""
    places: dict[str, list[tuple[int, int]]] = {}
    for k, b in enumerate(blocks):
        for i, c in enumerate(b.children):
            if c.type == "icon" and c.instance_id:
                places.setdefault(c.instance_id, []).append((k, i))
    lost = set()
    for own in places.values():
        kept = next((p for p in own if blocks[p[0]].kind in SHOWN), own[0])
        lost |= set(own) - {kept}
    for k, b in enumerate(blocks):
        b.children = [c for i, c in enumerate(b.children) if (k, i) not in lost]
    return blocks


def _table_function(limits: Limits, finish: bool):
    class FoldPage:
        def __init__(self):
            self.page, self.name = Page(limits), None

        def eval(self, row) -> Iterator[tuple]:
            self.name = row.page_id
            if row.side == 2:
                self.page.add(row)
            else:
                (self.page.figures if row.side == 1 else self.page.icons).append(row)
            yield from ()

        def terminate(self) -> Iterator[tuple]:
            for pos, b in enumerate(self.page.close(finish) if self.name is not None else []):
                yield (self.name, f"{self.name}.b{b.number:03d}{b.suffix}", pos, b.kind, b.level, *map(float, b.box or ()), *[None] * (0 if b.box else 4), [tuple(c) for c in b.children])

    return udtf(FoldPage, returnType=_BLOCKS)


_ROW = {"page_id": "string", "side": "int", "pos": "int", "text": "string", "role": "string", "table_region": "int", "font_size": "double", **dict.fromkeys(("x0", "y0", "x1", "y1"), "double"), "symbol_id": "string", "instance_id": "string"}


def fold_pages(spans: DataFrame, icons: DataFrame | None = None, figures: DataFrame | None = None, limits: Limits = Limits(), finish: bool = True) -> DataFrame:
    """page_id, block_id, pos, kind, level, box, children: every page's blocks in order, by one exchange on page_id.

    spans: page_id, pos (their order on the page), text, role (``with_roles``), font_size, box, table_region (the table that the span's centre is
    in, or null). icons: page_id, pos, symbol_id, instance_id, box. figures: page_id, pos, symbol_id (the asset), box. Spans in the footer and
    labels of diagrams are left out. With ``finish`` list items take in what continues them, long paragraphs are cut, repeats left out and
    icon instances kept once; without, blocks are as the lines make them. Null texts are empty; a page without rows has no blocks.
    """
    sides = [(0, icons), (1, figures), (2, spans.where(~F.col("role").isin(*UNSEEN)))]
    rows = []
    for side, df in sides:
        if df is not None:
            have = {c.lower() for c in df.columns}
            rows.append(df.select(*[(F.lit(side) if c == "side" else F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in _ROW.items()]))
    table = rows[0]
    for more in rows[1:]:
        table = table.unionByName(more)
    return _table_function(limits, finish)(table.asTable().partitionBy("page_id").orderBy("side", "pos"))
