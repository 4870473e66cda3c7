"""The trie of conversations' common beginnings, by truncation peeling (operator 12).

From the deepest turn upwards, conversations that end at a depth join the nodes that survive there; a node is finished, its last turn
is stripped, and what is left is grouped again. So nodes are found and added up in one pass, without a list of members.

On a cluster the rows are peeled in blocks of the order of their paths. A block finishes every node that lies in it alone; the others are
beginnings of its first or last path, since equal beginnings are neighbours. These two paths, with what their nodes have so far, are the
rows of the next level, whose blocks finish more, until one block holds all that is left.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.dac import shared_folder

#: Bytes of a path's hash. The hash at a depth covers all turns up to it; equal hashes count as equal beginnings (md5, then blake2b).
WIDE = 16
#: Nodes that a block holds, at least; a block has some rows more than its two open ones in any case.
BLOCK_NODES, BLOCK_ROWS = 50_000, 64
#: Ids that are hashed together before a node's ids meet.
CHUNK_IDS = 4096
NOTHING = hashlib.sha256(b"").hexdigest()

_PART = "struct<depth:long,n:long,first:long,children:long,leaves:long,saved:long,ends:string>"
_LEVEL = f"conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node binary, parent binary, path binary, sizes binary, parts array<{_PART}>"


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first of its hundred."""
    return F.pmod(F.crc32(conv_id.cast("string")), F.lit(6)).cast("int")


def rebuilt(conversations: DataFrame, most_shared: int = 5) -> DataFrame:
    """conv_id, turns (array of digest, size) of every conversation, with its first turns taken from conversation c - c % 100.

    Turns are in order of turn (null first), rows of one turn by role and by the hash of role and text; null roles and texts are empty,
    and rows without a conv_id are no conversation's. A turn is its hash and its number of code points here, and
    a conversation's turns, some 40 bytes each, are one row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("size")).alias("row"))
    turns = F.transform(F.array_sort(F.collect_list("row")), lambda r: F.struct(r["digest"].alias("digest"), r["size"].alias("size")))
    own = rows.groupBy("conv_id").agg(turns.alias("own")).checkpoint()
    heads = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("own", 1, most_shared).alias("head"))
    rows = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", shared_turns(F.col("conv_id"))).join(heads, "base", "left")
    head = F.when(F.col("head").isNull(), F.slice("own", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    return rows.select("conv_id", F.concat(head, F.slice("own", F.col("h") + 1, F.size("own"))).alias("turns"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns = batch.column("turns")
        at, flat = turns.offsets.to_pylist(), turns.values
        digests, sizes = flat.field("digest").to_pylist(), flat.field("size").to_numpy(zero_copy_only=False).astype("<i8")
        nodes, paths, packed = [], [], []
        for a, b in zip(at, at[1:], strict=False):
            last, path = b"", []
            for digest in digests[a:b]:
                last = hashlib.blake2b(last + digest, digest_size=WIDE).digest()
                path.append(last)
            nodes.append(last)
            paths.append(b"".join(path))
            packed.append(sizes[a:b].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, pa.binary()) for c in (nodes, paths, packed))], ["conv_id", "node", "path", "sizes"])


_CHUNK = ["node", "first", "n", "ids", "path", "sizes"]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node's ascending ids, as the text that is hashed."""
    held, ids = None, []

    def close() -> pa.RecordBatch:
        row = (held[0], ids[0], len(ids), ",".join(map(str, ids)).encode(), *held[1:])
        return pa.RecordBatch.from_pylist([dict(zip(_CHUNK, row, strict=True))], pa.schema([("node", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("path", pa.binary()), ("sizes", pa.binary())]))

    out = []
    for batch in batches:
        for conv, node, path, sizes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "node", "path", "sizes")), strict=True):
            if ids and (held[0] != node or len(ids) == CHUNK_IDS):
                out.append(close())
                ids = []
            held = (node, path, sizes)
            ids.append(conv)
            if len(out) >= 256:
                yield from _together(out)
                out = []
    if ids:
        out.append(close())
    yield from _together(out)


def _together(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if batches:
        yield from pa.Table.from_batches(batches).combine_chunks().to_batches()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a node from its chunks in order: a running hash, however many there are."""
    now, out = None, []
    row = lambda: {"path": now[1], "sizes": now[2], "n": now[3], "first": now[4], "ends": now[5].hexdigest()}
    schema = pa.schema([("path", pa.binary()), ("sizes", pa.binary()), ("n", pa.int64()), ("first", pa.int64()), ("ends", pa.string())])
    for batch in batches:
        for node, first, n, ids, path, sizes in zip(*(batch.column(c).to_pylist() for c in _CHUNK), strict=True):
            if now is not None and now[0] == node:
                now[5].update(b"," + ids)
                now[3] += n
                continue
            if now is not None:
                out.append(row())
            now = [node, path, sizes, n, first, hashlib.sha256(ids)]
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if now is not None:
        out.append(row())
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def ended(turns: DataFrame) -> DataFrame:
    """path, sizes, n, first, ends: each distinct conversation once, with how many are equal, the smallest id, and the hash of their ids in order.

    Ids of one node are spread by ranges and leave them as text of some thousand ids a row, so that a conversation which a third of all
    repeat passes one task only as that text, streamed.
    """
    paths = turns.mapInArrow(_paths, "conv_id long, node binary, path binary, sizes binary").checkpoint()
    spread = paths.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    chunks = spread.mapInArrow(_chunks, "node binary, first long, n long, ids binary, path binary, sizes binary")
    return chunks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_ends, "path binary, sizes binary, n long, first long, ends string")


class Part(NamedTuple):
    """What a node at a depth has so far: members, the smallest one, finished children and their sums, and the hash of those that end there."""

    depth: int
    n: int
    first: int
    children: int
    leaves: int
    saved: int
    ends: str | None


class Path(NamedTuple):
    """A row to be peeled: hashes of its beginnings, code points of its turns, and parts for some of its depths."""

    path: bytes
    sizes: bytes
    parts: list[Part]

    def key(self, depth: int) -> bytes:
        return self.path[WIDE * (depth - 1) : WIDE * depth] if depth else b""

    def keys(self) -> list[bytes]:
        return [self.key(d) for d in range(len(self.path) // WIDE + 1)]


class _Node:
    __slots__ = ("row", "n", "first", "children", "leaves", "saved", "ends", "kids")

    def __init__(self, row: Path):
        self.row, self.n, self.first, self.children, self.leaves, self.saved, self.ends, self.kids = row, 0, None, 0, 0, 0, None, []

    def add(self, n: int, first: int, children: int, leaves: int, saved: int, ends: str | None) -> None:
        self.n += n
        self.first = first if self.first is None else min(self.first, first)
        self.children += children
        self.leaves += leaves
        self.saved += saved
        self.ends = self.ends or ends


def peel(rows: list[Path], closed: bool) -> tuple[list[dict], list[Path]]:
    """Finished nodes of a run of rows in order of their paths, and the paths that stay open: the first and the last, unless nothing lies beside the run (``closed``)."""
    fresh: dict[int, list[tuple[Path, Part]]] = {}
    for row in rows:
        for part in row.parts:
            fresh.setdefault(part.depth, []).append((row, part))
    left = rows[0].keys()
    right = [k for k in rows[-1].keys() if k not in set(left)]
    still_open = set() if closed else {*left, *right}
    spines: dict[bytes, Part] = {}
    done: list[dict] = []
    alive: dict[bytes, _Node] = {}
    for depth in range(max(fresh), -1, -1):
        for row, part in fresh.get(depth, ()):
            key = row.key(depth)
            if key not in alive:
                alive[key] = _Node(row)
            alive[key].add(*part[1:])
        above: dict[bytes, _Node] = {}
        for key, node in alive.items():
            row, finished = node.row, key not in still_open
            if finished:
                size = int.from_bytes(row.sizes[8 * (depth - 1) : 8 * depth], "little") if depth else 0
                node.leaves = node.leaves if node.children else 1
                node.saved += (node.n - 1) * size
            elif node.n:
                spines[key] = Part(depth, node.n, node.first, node.children, node.leaves, node.saved, node.ends)
            for kid in node.kids:
                done.append(kid | ({"parent_conv_id": node.first} if finished else {"parent": key}))
            if depth:
                up = row.key(depth - 1)
                if up not in above:
                    above[up] = _Node(row)
                if finished:
                    above[up].add(node.n, node.first, 1, node.leaves, node.saved, None)
            if finished:
                found = {"conv_id": node.first, "depth": depth, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved, "ends_sha256": node.ends, "node": key}
                (above[up].kids if depth else done).append(found)
        alive = above
    paths = []
    for row, keys in ((rows[0], left), (rows[-1], right)):
        parts = [spines[k] for k in keys if k in spines]
        if parts:
            paths.append(Path(row.path, row.sizes, parts))
    return done, paths


_SCHEMA = pa.schema(
    [*((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string()), *((c, pa.binary()) for c in ("node", "parent", "path", "sizes")), ("parts", pa.list_(pa.struct([*((c, pa.int64()) for c in Part._fields[:-1]), ("ends", pa.string())])))]
)


def _level(rows: DataFrame, first: bool, closed: bool, block_nodes: int, block_rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Path] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            done, open_paths = peel(held, closed)
            out = [d | {"node": None} for d in done] if first else done
            out += [{"path": p.path, "sizes": p.sizes, "parts": [x._asdict() for x in p.parts]} for p in open_paths]
            yield from pa.Table.from_pylist(out, _SCHEMA).to_batches(max_chunksize=4096)

        for batch in batches:
            for path, sizes, parts in zip(*(batch.column(c).to_pylist() for c in ("path", "sizes", "parts")), strict=True):
                held.append(Path(path, sizes, [Part(**p) for p in parts]))
                size += len(path) // WIDE + 1
                if not closed and size >= block_nodes and len(held) >= block_rows:
                    yield from close()
                    held, size = [], 0
        if held:
            yield from close()

    return rows.select("path", "sizes", "parts").mapInArrow(run, _LEVEL)


def prefix_nodes(conversations: DataFrame, block_nodes: int = BLOCK_NODES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the rebuilt conversations' trie.

    A node is a distinct sequence of first turns (role and text). The root is the empty one; a conversation without a row does not exist,
    so no rows give no root. Repeated rows are turns of their own. Levels are written to the shared folder; only the nodes whose parent was
    finished in a later block than theirs are joined with it.
    """
    spark = conversations.sparkSession
    folder = f"{shared_folder(spark)}/trie-{uuid.uuid4().hex}"
    none = F.lit(0).cast("long")
    part = F.struct((F.octet_length("path") / WIDE).cast("long").alias("depth"), "n", "first", none.alias("children"), none.alias("leaves"), none.alias("saved"), "ends")
    rows = ended(rebuilt(conversations)).select("path", "sizes", F.array(part).alias("parts"))
    nodes, level, closed = None, 0, False
    while True:
        # The last level is small: all its rows are one block.
        ordered = rows.coalesce(1).sortWithinPartitions("path") if closed else rows.repartitionByRange("path").sortWithinPartitions("path")
        _level(ordered, level == 0, closed, block_nodes, block_rows).write.parquet(f"{folder}/{level}")
        found = spark.read.schema(_LEVEL).parquet(f"{folder}/{level}")
        finished = found.where("conv_id IS NOT NULL").drop("path", "sizes", "parts")
        nodes = finished if nodes is None else nodes.unionByName(finished)
        if closed:
            break
        rows, level = found.where("parts IS NOT NULL"), level + 1
        count, size = rows.agg(F.count("*"), F.sum(F.octet_length("path") / WIDE + 1)).first()
        if not count:
            break
        closed = count <= block_rows or size <= block_nodes
    late = nodes.where("node IS NOT NULL").select(F.col("node").alias("parent"), F.col("conv_id").alias("late"))
    out = nodes.where("parent IS NULL").drop("parent").withColumn("late", F.lit(None).cast("long")).unionByName(nodes.where("parent IS NOT NULL").join(late, "parent", "left").drop("parent"))
    return out.select("conv_id", "depth", F.coalesce("parent_conv_id", "late").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


_CRC = """xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
        lambda acc, byte: list_reduce([CAST(x AS BIGINT) FOR x IN range(8)], lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END, xor(acc, byte)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"""

ORACLE = f"""
    WITH t AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, mark) AS k
        FROM (SELECT conv_id, turn, role, text, md5(strlen(role) || ':' || role || text) AS mark FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))
    ), c AS (
        SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)
    ), r AS (
        SELECT conv_id, mark, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS depth FROM (
            SELECT c.conv_id, 0 AS part, k, mark, text FROM c JOIN t ON t.conv_id = base AND k <= h
            UNION ALL SELECT c.conv_id, 1, k, mark, text FROM c JOIN t ON t.conv_id = c.conv_id AND k > h)
    ), p AS (
        SELECT conv_id, depth, text, string_agg(mark, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM r
        UNION ALL SELECT conv_id, 0, '', '' FROM c
    ), m AS (
        SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM p
    ), n AS (
        SELECT depth, key, left(key, greatest(0, 32 * (depth - 1))) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(length(text)) AS size,
            sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
        FROM m GROUP BY depth, key
    ), k AS (
        SELECT up AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up
    ), f AS (
        SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (key)
    ), s AS (
        SELECT a.key, CAST(sum((b.n_convs - 1) * b.size) AS BIGINT) AS saved_tokens, count(*) FILTER (b.n_children = 0) AS n_leaves FROM f AS a JOIN f AS b ON starts_with(b.key, a.key) GROUP BY a.key
    )
    SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
    FROM f JOIN s USING (key) LEFT JOIN n AS u ON f.depth > 0 AND u.key = f.up
"""
