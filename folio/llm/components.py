"""Connected components of a graph given as a DataFrame of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Links in a block that one task joins up by itself.
BLOCK = 1_000_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between ids: each node but the smallest of its component, and that one. Union by the smaller root, with path halving."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(ids)))
    for x, y in zip(place[: len(a)].tolist(), place[len(a) :].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        parent[max(x, y)] = min(x, y)
    root = np.array(parent, np.int64)
    while len(ids) and (root[root] != root).any():
        root = root[root]
    own = np.arange(len(ids)) != root
    return ids[own], ids[root[own]]


def _within_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if found:
        x, root = stars(*(np.concatenate([f[k] for f in found]) for k in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(root)], ["a", "b"])


def connected_components(edges: DataFrame, src: str, dst: str, most_rounds: int = 60, block: int = BLOCK) -> DataFrame:
    """id, component (the smallest id reachable) of every node that has a link to another; ids are longs.

    First the links are taken in blocks of about ``block``, and each block's are joined up by one task: they become stars, and where there is
    one block only, that is all. Else follow rounds of two steps, each a shuffle that sends a node's neighbours to their smallest one: first
    the larger neighbours are linked to the smallest of the neighbourhood, then the smaller ones are.
    The links shrink to stars within a number of rounds that grows with the logarithm of the largest
    component. Minima are taken by a grouped aggregate with partial sums and joined back, so no
    task holds a hub's neighbours. Each round is checkpointed to the shared folder.
    """
    both = lambda e: e.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(e.select(F.col("b").alias("x"), F.col("a").alias("y")))
    links = edges.select(F.greatest(src, dst).cast("long").alias("a"), F.least(src, dst).cast("long").alias("b")).where("a <> b").distinct().checkpoint()
    blocks = max(1, -(-links.count() // block))
    links = links.coalesce(blocks).mapInArrow(_within_blocks, "a long, b long").checkpoint()
    if blocks == 1:
        most_rounds = 0
    state = None
    for _ in range(most_rounds):
        around = both(links)
        low = around.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        large = around.join(low, "x").where("y > x").select(F.col("y").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        hooked = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(down.select("a", F.col("m").alias("b")))
        links = hooked.distinct().checkpoint()
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    else:
        if most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
