"""SimHash near-duplicates: fingerprints, exact links, components (operator 4).

Links between fingerprints come from tiles: blocks of fingerprints, ordered by population count, that
are compared whole with numpy's exclusive or and bit counts. Two fingerprints at a distance of r bits
differ in population count by r at most, so tiles and strips of tiles whose counts are further apart
are skipped. To keep the number of tile pairs from growing with the square of the corpus, only
fingerprints that agree in the bits of some mask meet. A bucket of such fingerprints is one tile; a hot
one is cut into tiles of bounded size, and each pair of its tiles is a group of its own.

``near_duplicates`` links 64-bit fingerprints within a few bits: with ``groups`` bit groups and a radius
of r, two fingerprints within r bits agree in at least ``groups - r`` of them, so one mask for each choice
of ``groups - r`` groups loses no link. ``similar_texts`` finds texts by the Jaccard similarity of their
shingle sets: fingerprints of 256 bits meet by random masks, are compared, and each link is then
checked with the two sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.components import connected_components
from folio.llm.textarrays import TextBatch, _is_sep, mix, slices

#: Fingerprints in a tile at most; a tile pair is one numpy comparison of 4 million pairs.
TILE = 2048
#: Bytes of text that are cut into shingles at once; the places and hashes of its words take some 50 times as much.
SLICE = 1 << 19
#: A broadcast of keys (8 bytes each) is made up to this count, which is looked at first.
MOST_BROADCAST = 1 << 18
#: Bytes of shingle sets in a tile of them at most, but for one row's own.
SET_BYTES = 64 << 20
#: Distinct texts that a mask's bucket holds on average at most.
BUCKET = 64
_GOLD = 0x9E3779B97F4A7C15


def shingle_hashes(batch: TextBatch, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every document's word shingles in order, repeats included, and each document's offset into them.

    Fewer words than ``width``: the whole sequence is one shingle; none: no shingle.
    """
    low = batch.lowered()
    starts, ends = low.words()
    words = low.per_doc(starts)
    keep = ~_is_sep[low.data]
    gap = np.concatenate([[False], keep[:-1]]) & ~keep  # the byte after a word becomes its one space
    kept = keep | gap
    raw = np.where(gap, np.uint8(32), low.data)[kept].tobytes()
    at = np.cumsum(kept) - 1
    s, e = at[starts] if len(starts) else starts, at[ends - 1] + 1 if len(ends) else ends
    counts = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    upto = np.concatenate([[0], np.cumsum(counts)])
    first_word = np.cumsum(words) - words
    doc = np.repeat(np.arange(len(words)), counts)
    begin = first_word[doc] + np.arange(upto[-1]) - upto[doc]
    end = begin + np.minimum(width, words[doc]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b], seed) for a, b in zip(s[begin].tolist(), e[end].tolist(), strict=True)), np.uint64, len(doc))
    return h, upto


def fingerprints_of(h: np.ndarray, upto: np.ndarray, words: int = 1) -> np.ndarray:
    """(documents, words): a bit of a document's fingerprint is 1 if it is set in over half of its hashes; zero without hashes.

    The first word is of the hashes themselves, each other one of the hashes mixed anew.
    """
    n = np.diff(upto)
    out = np.zeros((len(n), words), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        for w in range(words):
            own = mix(h ^ np.uint64(w * _GOLD % (1 << 64))) if w else h
            for bit in range(64):
                ones = np.add.reduceat((own >> np.uint64(bit)) & np.uint64(1), upto[full])
                out[full, w] |= (2 * ones.astype(np.int64) > n[full]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (long, the fingerprint's 64 bits) of every whole text; a null text counts as empty. No shuffle."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                fp = fingerprints_of(*shingle_hashes(TextBatch.of(batch.column("text")), width, seed))[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


class Tile:
    """Fingerprints in order of their population counts; words (n, words), and optionally the sizes of the sets they stand for."""

    def __init__(self, fp: np.ndarray, sizes: np.ndarray | None = None):
        ones = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
        self.order = np.argsort(ones, kind="stable")
        self.ones, self.fp = ones[self.order], fp[self.order]
        self.sizes = None if sizes is None else sizes[self.order]

    def near(self, rows: slice, other: Tile, columns: slice, radius: int, least: tuple[int, int] | None) -> np.ndarray:
        """Which of these rows are within the radius of which columns of the other tile, and of a size that allows the similarity ``least``."""
        x, y = self.fp[rows], other.fp[columns]
        bits = np.bitwise_count(x[:, 0, None] ^ y[None, :, 0])
        bits = bits if x.shape[1] < 4 else bits.astype(np.uint16)
        for w in range(1, x.shape[1]):
            bits += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
        near = bits <= radius
        if least is not None and self.sizes is not None:
            m, n = self.sizes[rows][:, None], other.sizes[columns][None, :]
            near &= (least[1] * m >= least[0] * n) & (least[1] * n >= least[0] * m)
        return near


def tile_links(a: Tile, b: Tile, radius: int, least: tuple[int, int] | None = None, labels: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (places in a, places in b) between two tiles, or within one if they are the same, that join all pairs within the radius.

    Compared in strips of rows, so that a strip's matrix stays in the cache; a strip looks only at the
    columns whose population counts are within the radius of its own. A link between two fingerprints
    that earlier links join already is left out, so there are fewer links than fingerprints. With
    labels of a's and b's fingerprints all pairs of different labels are given instead.
    """
    same = a is b
    joined = np.arange(len(a.ones) if same else len(a.ones) + len(b.ones))
    shift = 0 if same else len(a.ones)
    for at in range(0, len(a.ones), 128):
        rows = slice(at, min(at + 128, len(a.ones)))
        low = max(np.searchsorted(b.ones, a.ones[at] - radius), at if same else 0)
        columns = slice(int(low), int(np.searchsorted(b.ones, a.ones[rows.stop - 1] + radius, "right")))
        if columns.start >= columns.stop:
            continue
        near = a.near(rows, b, columns, radius, least)
        if same:
            near &= np.arange(columns.start, columns.stop)[None, :] > np.arange(rows.start, rows.stop)[:, None]
        if labels is not None:
            i, j = np.nonzero(near & (labels[0][a.order[rows]][:, None] != labels[1][b.order[columns]][None, :]))
            yield a.order[i + at], b.order[j + columns.start]
            continue
        lefts, rights = [], []
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            j = np.flatnonzero(near[i]) + columns.start
            of = joined[j + shift]
            others = of != joined[at + i]
            other, first = np.unique(of[others], return_index=True)
            if len(other):
                hit = j[others][first]
                lefts.append(np.full(len(hit), at + i))
                rights.append(hit)
                joined[np.isin(joined, other)] = joined[at + i]
        if lefts:
            yield a.order[np.concatenate(lefts)], b.order[np.concatenate(rights)]


def small_links(fp: np.ndarray, own: np.ndarray, radius: int, sizes: np.ndarray | None = None, least: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All near pairs of places within runs of equal ``own``, for many short runs at once: each place with its next, second next and further neighbours."""
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    k = 1
    while k < len(own):
        i = np.flatnonzero(own[k:] == own[:-k])
        if not len(i):
            break
        bits = np.bitwise_count(fp[i] ^ fp[i + k]).sum(axis=1, dtype=np.int64)
        good = bits <= radius
        if least is not None and sizes is not None:
            good &= (least[1] * sizes[i] >= least[0] * sizes[i + k]) & (least[1] * sizes[i + k] >= least[0] * sizes[i])
        lefts.append(i[good])
        rights.append(i[good] + k)
        k += 1
    return np.concatenate(lefts), np.concatenate(rights)


def _groups_of(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Sorted rows (bucket, pair, ...) as numpy columns, cut so that a group of (bucket, pair) is never divided."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in names}
        new = np.flatnonzero((rows["bucket"][1:] != rows["bucket"][:-1]) | (rows["pair"][1:] != rows["pair"][:-1])) + 1
        cut = int(new[-1]) if len(new) else 0
        if cut:
            yield {c: x[:cut] for c, x in rows.items()}
        held = {c: x[cut:] for c, x in rows.items()}
    if held is not None and len(held["bucket"]):
        yield held


def broadcast_if_few(keys: DataFrame) -> DataFrame | None:
    """keys (a checkpointed column of longs), to be broadcast if there are MOST_BROADCAST of them at most; None if there are none."""
    n = keys.count()
    return None if not n else F.broadcast(keys) if n <= MOST_BROADCAST else keys


def dealt(rows: DataFrame, fp: list[str], radius: int, tile: int = TILE, sets: DataFrame | None = None, size: str | None = None) -> DataFrame:
    """rows (bucket, fp words, ...) with pair and side, and the columns of sets (by id), dealt by (bucket, pair) and sorted: a hot bucket's rows once for each pair of tiles they take part in.

    With sets, a row counts for as many as its set (of ``size`` hashes) takes shares of SET_BYTES, so a tile is bounded in bytes too.
    """
    weight = F.lit(1) if sets is None else F.floor(8 * F.col(size) * tile / SET_BYTES) + 1
    # A 16th of the ids (by a hash) tells hot buckets: one of `tile` rows has tile / 16 of them, and is taken as hot from half of that on.
    seen = rows.where(F.pmod(F.xxhash64("id"), F.lit(16)) == 0) if tile >= 1024 else rows
    enough = tile / 32 if tile >= 1024 else tile
    hot = seen.groupBy("bucket").agg(F.sum(weight).alias("total")).where(F.col("total") > enough).select("bucket").checkpoint()
    placed = {"pair": F.lit(0).cast("long"), "side": F.lit(0)}
    few = broadcast_if_few(hot)
    if few is None:
        out = rows.withColumns(placed)
    else:
        ones = sum((F.bit_count(c) for c in fp[1:]), F.bit_count(fp[0]))
        warm = rows.join(few, "bucket", "left_semi").withColumn("ones", ones)
        w = Window.partitionBy("bucket").orderBy("ones")
        # Tiles of a bucket: runs of its population counts with about `tile` fingerprints; a count with more is cut by a hash.
        spans = warm.groupBy("bucket", "ones").agg(F.sum(weight).alias("n"))
        spans = spans.withColumn("run", F.floor((F.sum("n").over(w) - 1) / tile)).withColumn("cuts", F.ceil(F.col("n") / tile).cast("int"))
        tiles = spans.groupBy("bucket", "run", "cuts").agg(F.min("ones").alias("low"), F.max("ones").alias("high"))
        tiles = tiles.select("bucket", "run", "cuts", "low", "high", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("part"))
        tiles = tiles.withColumn("t", F.row_number().over(Window.partitionBy("bucket").orderBy("run", "cuts", "part")).cast("long"))
        left = tiles.select("bucket", F.col("t").alias("a"), F.col("low").alias("a_low"), F.col("high").alias("a_high"))
        right = tiles.select("bucket", F.col("t").alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
        pairs = left.join(right, "bucket").where((F.col("a") <= F.col("b")) & (F.col("b_low") - F.col("a_high") <= radius) & (F.col("a_low") - F.col("b_high") <= radius))
        pair = F.col("a") * (1 << 31) + F.col("b")
        sides = pairs.select("bucket", pair.alias("pair"), F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("t"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("a").alias("t"), F.lit(0).alias("side")), F.struct(F.col("b").alias("t"), F.lit(1).alias("side"))))).alias("s"))
        sides = sides.select("bucket", "pair", "s.t", "s.side")
        tiled = warm.join(spans.select("bucket", "ones", "run", "cuts"), ["bucket", "ones"])
        tiled = tiled.withColumn("part", F.when(F.col("cuts") > 1, F.pmod(F.xxhash64(*fp), F.col("cuts"))).otherwise(F.lit(0)).cast("int"))
        tiled = tiled.join(tiles.select("bucket", "run", "cuts", "part", "t"), ["bucket", "run", "cuts", "part"]).join(sides, ["bucket", "t"])
        names = [*rows.columns, *placed]
        out = rows.join(few, "bucket", "left_anti").withColumns(placed).select(*names).unionByName(tiled.select(*names))
    out = out if sets is None else out.join(sets, "id")
    return out.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair", "side")


class Checked:
    """Of near pairs those whose sets have the similarity asked for, as far as they join what isn't joined yet."""

    def __init__(self, sets: np.ndarray, labels: np.ndarray, least: tuple[int, int]):
        self.sets, self.labels, self.least = sets, labels.tolist(), least
        self.parent: dict[int, int] = {}

    def _root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def links(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs of places (i, j), enough of the similar ones to join all of them."""
        over, under = self.least
        lefts, rights = [], []
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        for x, ys in zip(*(np.unique(i), np.split(j, np.flatnonzero(np.diff(i)) + 1)), strict=True) if len(i) else ():
            own = self._root(self.labels[x])
            left = [y for y in ys.tolist() if self._root(self.labels[y]) != own and len(self.sets[y])]
            mine = np.frombuffer(self.sets[x], np.uint64)
            if not left or not len(mine):
                continue
            others = np.frombuffer(b"".join(self.sets[y] for y in left), np.uint64)
            sizes = np.array([len(self.sets[y]) // 8 for y in left])
            hit = mine[np.minimum(np.searchsorted(mine, others), len(mine) - 1)] == others
            both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
            for k in np.flatnonzero(under * both >= over * (len(mine) + sizes - both)).tolist():
                a, b = self._root(self.labels[x]), self._root(self.labels[left[k]])
                if a != b:
                    self.parent[max(a, b)] = min(a, b)
                    lefts.append(x)
                    rights.append(left[k])
        return np.array(lefts, np.int64), np.array(rights, np.int64)


def links(rows: DataFrame, fp: list[str], radius: int, size: str | None = None, least: tuple[int, int] | None = None, label: str | None = None, sets: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """bucket, src, dst: links that join all ids of a bucket whose fingerprints are within ``radius`` bits.

    rows: bucket, id, the words ``fp`` of the fingerprint, all long. ``size`` and ``least``: set sizes, of which pairs that can't
    have the similarity ``least`` are skipped. ``label``: give all pairs of different labels, not only enough to join them; with
    ``sets`` (id, shingles: sorted hashes as bytes), of these pairs only similar ones, enough to join them.
    """
    names = ("bucket", "pair", "side", "id", *fp, *([size] if size else []), *([label] if label else []), *(["shingles"] if sets is not None else []))
    exact = sets is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(bucket: np.ndarray, src: np.ndarray, dst: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (bucket, src, dst)], ["bucket", "src", "dst"])

        for g in _groups_of(batches, names):
            words = np.stack([g[c].astype(np.int64).view(np.uint64) for c in fp], axis=1)
            sizes, ids, side = g[size] if size else None, g["id"], g["side"]
            starts = np.concatenate([[0], np.flatnonzero((g["bucket"][1:] != g["bucket"][:-1]) | (g["pair"][1:] != g["pair"][:-1])) + 1, [len(ids)]])
            many = np.diff(starts)
            few = np.flatnonzero(np.repeat((many <= 16) & (g["pair"][starts[:-1]] == 0), many))
            if len(few):
                own = np.repeat(np.arange(len(many)), many)[few]
                i, j = small_links(words[few], own, radius, None if sizes is None else sizes[few], least)
                i, j = few[i], few[j]
                if label:
                    i, j = i[g[label][i] != g[label][j]], j[g[label][i] != g[label][j]]
                if exact:
                    i, j = Checked(g["shingles"], g[label], least).links(i, j)
                yield found(g["bucket"][i], ids[i], ids[j])
            for k in np.flatnonzero((many > 16) | ((g["pair"][starts[:-1]] != 0) & (many > 1))).tolist():
                at, to = int(starts[k]), int(starts[k + 1])
                split = at + int(np.searchsorted(side[at:to], 1))
                part = lambda s, e: Tile(words[s:e], None if sizes is None else sizes[s:e])  # noqa: B023, E731
                a = part(at, split)
                one_tile = split == to and g["pair"][at] >> 31 == g["pair"][at] & ((1 << 31) - 1)
                b, shift = (a, at) if one_tile else (part(split, to), split)
                labels = (g[label][at:split], g[label][shift : shift + len(b.ones)]) if label else None
                checks = Checked(g["shingles"], g[label], least) if exact else None
                for i, j in tile_links(a, b, radius, least, labels):
                    i, j = i + at, j + shift
                    if checks:
                        i, j = checks.links(i, j)
                    yield found(np.full(len(i), g["bucket"][at]), ids[i], ids[j])

    sent = dealt(rows, fp, radius, tile, sets, size).select(*names)
    return sent.mapInArrow(run, "bucket long, src long, dst long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def met(distinct: DataFrame, fp: list[str], masks: list[tuple[int, ...]], *others: str) -> DataFrame:
    """bucket, id, the words ``fp`` and the columns ``others``: a row for each mask; a bucket is a hash of the mask's number and the bits under it."""
    table = F.array(*[F.struct(F.lit(t).alias("t"), *[F.lit(_signed(m)).cast("long").alias(f"m{k}") for k, m in enumerate(mask)]) for t, mask in enumerate(masks)])
    under = F.transform(table, lambda m: F.xxhash64(m["t"], *[F.col(c).bitwiseAND(m[f"m{k}"]) for k, c in enumerate(fp)]))
    return distinct.select(F.explode(under).alias("bucket"), "id", *fp, *others)


def group_masks(groups: int, agree: int) -> list[tuple[int, ...]]:
    """Of a word cut into ``groups`` bit groups, the masks of every choice of ``agree`` groups."""
    cuts = [round(64 * k / groups) for k in range(groups + 1)]
    return [(sum(((1 << (cuts[k + 1] - cuts[k])) - 1) << cuts[k] for k in chosen),) for chosen in combinations(range(groups), agree)]


def random_masks(tables: int, bits: int, words: int, seed: int = 5) -> list[tuple[int, ...]]:
    """Masks of ``bits`` bits each, at random over ``words`` words."""
    rng = np.random.default_rng(seed)
    chosen = [rng.choice(64 * words, bits, replace=False).tolist() for _ in range(tables)]
    return [tuple(sum(1 << (b % 64) for b in c if b // 64 == w) for w in range(words)) for c in chosen]


def near_duplicates(docs: DataFrame, width: int = 4, seed: int = 42, radius: int = 4, groups: int = 6, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links, itself included.

    Texts without a word have fingerprint zero and are linked like any other. Repeated rows keep a
    row each; a null doc_id gets the component of its fingerprint, whose component_id is null if no
    row of it has a doc_id. No rows give no rows.
    """
    from folio.llm.dac import shared_folder

    shared_folder(docs.sparkSession)
    fps = fingerprints(docs, width, seed).checkpoint()
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")).checkpoint()
    buckets = met(nodes.select("fp", F.col("fp").alias("id")), ["fp"], group_masks(groups, groups - radius))
    pairs = links(buckets, ["fp"], radius, tile=tile).select("src", "dst")
    labels = connected_components(pairs, "src", "dst")
    linked = nodes.join(labels, nodes["fp"] == labels["id"]).select("fp", "least_id", "component").checkpoint()
    first = linked.groupBy("component").agg(F.min("least_id").alias("first_id"))
    roots = nodes.join(linked.join(first, "component").select("fp", "first_id", F.lit(True).alias("in_group")), "fp", "left")
    roots = roots.select("fp", F.when(F.col("in_group"), F.col("first_id")).otherwise(F.col("least_id")).alias("component_id"))
    return fps.join(roots, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Words of a wide fingerprint. All of them are compared: over 128 bits, texts that share a passage only (a similarity of 0.4) pass one time in five, over 256 once in hundreds.
WIDE = 4


def _sets(h: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's sorted set of hashes, one after the other, and their offsets."""
    doc = np.repeat(np.arange(len(upto) - 1), np.diff(upto))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(upto) - 1))])


def wide_fingerprints(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """row_key and doc_id as they came, node (a hash of the set of shingles), n (its size) and the words f0, f1, ... of every whole text's wide fingerprint. No shuffle."""
    kind = dict(docs.dtypes)["doc_id"]
    words = [f"f{w}" for w in range(WIDE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                h, upto = _sets(*shingle_hashes(TextBatch.of(batch.column("text")), width, seed))
                raw, at = h.tobytes(), (8 * upto).tolist()
                node = np.array([xxhash.xxh64_intdigest(raw[a:b], seed) for a, b in zip(at[:-1], at[1:], strict=True)], np.uint64)
                fp = fingerprints_of(h, upto, WIDE).view(np.int64)
                columns = [batch.column("row_key"), batch.column("doc_id"), pa.array(node.view(np.int64)), pa.array(np.diff(upto)), *(pa.array(np.ascontiguousarray(fp[:, w])) for w in range(WIDE))]
                yield pa.RecordBatch.from_arrays(columns, ["row_key", "doc_id", "node", "n", *words])

    return docs.select("row_key", "doc_id", "text").mapInArrow(run, f"row_key long, doc_id {kind}, node long, n long, " + ", ".join(f"{w} long" for w in words))


def _shingle_sets(texts: DataFrame, width: int, seed: int) -> DataFrame:
    """node as it came, and the sorted set of its text's shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                h, upto = _sets(*shingle_hashes(TextBatch.of(batch.column("text")), width, seed))
                raw, at = h.tobytes(), (8 * upto).tolist()
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles binary")


def checked(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) with true: whether their sets have a Jaccard similarity of least[0] / least[1] or more."""
    over, under = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xs"), batch.column("ys"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(under * both >= over * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "similar"])

    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("xs"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("ys"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "xs", "ys").mapInArrow(run, "a long, b long, similar boolean")


def radius_for(similarity: float, bits: int, sureness: float = 3.2) -> int:
    """The distance that sets of this Jaccard similarity keep within, but for seven cases in ten thousand: each bit differs with the angle between the sets over pi."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.ceil(bits * p + sureness * math.sqrt(bits * p * (1 - p)))


def masks_for(n: int, similarity: float, missed: float = 8e-4, least_bits: int = 16) -> tuple[int, int]:
    """Number of masks and bits a mask for n distinct texts: buckets of chance hold BUCKET at most, and of pairs of this similarity a share of ``missed`` at most meets under no mask.

    Two sets agree in a bit with 1 minus their angle over pi, so twice the texts take a bit more and, at a similarity of 0.8, 18 % more masks.
    """
    bits = max(least_bits, math.ceil(math.log2(max(n, 1) / BUCKET)))
    meets = (1 - math.acos(2 * similarity / (1 + similarity)) / math.pi) ** bits if similarity < 1 else 1.0
    return (math.ceil(math.log(missed) / math.log1p(-meets)) if meets < 1 else 1), bits


def similar_texts(docs: DataFrame, width: int = 5, least: tuple[int, int] = (4, 5), missed: float = 8e-4, seed: int = 42, tile: int = TILE) -> DataFrame:
    """row_key, doc_id, component: texts are in one component if links of a similarity of least[0] / least[1] or more connect them.

    docs: row_key (long, equal for equal rows only), doc_id (null or repeated ones too), text. Texts with the same set, those
    without a word included, are in one component. Repeated rows keep a row each. Nothing is linked that isn't as similar as
    asked. Of pairs just as similar as asked a share of ``missed`` meets under none of the masks, which follow the number of distinct texts.

    Tiles give enough links to join what is near. Where the sets refute one of them, the near texts of that bucket meet again
    with their sets, and all near pairs which aren't joined yet are checked in place: no row is made for a pair that isn't similar.
    """
    from folio.llm.dac import shared_folder

    shared_folder(docs.sparkSession)
    words = [f"f{w}" for w in range(WIDE)]
    near = radius_for(least[0] / least[1], 64 * WIDE)
    keys = wide_fingerprints(docs, width, seed).checkpoint()
    nodes = keys.groupBy("node").agg(F.min("row_key").alias("row_key"), F.first("n").alias("n"), *[F.first(w).alias(w) for w in words]).checkpoint()
    masks = random_masks(*masks_for(nodes.count(), least[0] / least[1], missed), WIDE)
    rows = met(nodes.withColumnRenamed("node", "id"), words, masks, "n")
    ordered = lambda found: found.select("bucket", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    held = ordered(links(rows, words, near, "n", least, tile=tile)).checkpoint()

    names = held.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = nodes.join(names, "node").select("node", "row_key").checkpoint()
    few = broadcast_if_few(wanted)
    if few is None:
        return keys.select("row_key", "doc_id", F.col("node").alias("component"))
    sets = _shingle_sets(docs.join(few, "row_key"), width, seed).dropDuplicates(["node"]).checkpoint()
    found = checked(held.select("a", "b").distinct(), sets, least).checkpoint()
    labels = connected_components(found.where("similar"), "a", "b")
    doubted = held.join(found.where("NOT similar"), ["a", "b"], "left_semi").select("bucket").distinct().checkpoint()
    few = broadcast_if_few(doubted)
    if few is not None:
        suspects = nodes.join(names, "node").withColumnRenamed("node", "id").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        again = met(suspects, words, masks, "n", "component").join(few, "bucket", "left_semi").checkpoint()
        more = links(again, words, near, "n", least, "component", sets.withColumnRenamed("node", "id"), tile=min(tile, TILE // 4))
        more = ordered(more).select("a", "b").checkpoint()
        if not more.isEmpty():
            labels = connected_components(found.where("similar").select("a", "b").unionByName(more), "a", "b")
    return keys.select("row_key", "doc_id", "node").join(labels.withColumnRenamed("id", "node"), "node", "left").select("row_key", "doc_id", F.coalesce("component", "node").alias("component"))
