"""Tokenizing whole batches of text.

``split`` finds the matches of the public tokenizers' pattern for a batch at once with numpy, from a
class per code point. ``PieceEncoder`` keeps the ids of pieces it has seen (in the worker, up to a
number of pieces) and asks a tokenizer for the others only, so that a tokenizer's work grows with the
distinct pieces of a task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
import regex

from folio.llm.textarrays import TextBatch

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4


@cache
def _classes() -> np.ndarray:
    """The class of every code point, as the pattern's \\p{L}, \\p{N} and \\s see it."""
    table = np.full(0x110000, OTHER, np.uint8)
    for start, stop in ((0, 0xD800), (0xE000, 0x110000)):
        chars = "".join(map(chr, range(start, stop)))
        for name, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
            for m in regex.finditer(name, chars):
                table[start + m.start() : start + m.end()] = value
    return table


def split(batch: TextBatch) -> np.ndarray:
    """Byte positions at which the pattern's matches start; they cover the texts without gaps."""
    data = batch.data
    if not len(data):
        return np.zeros(0, np.int64)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(chars)
    kind = _classes()[chars]
    first = np.zeros(n + 1, bool)  # of documents, in code points
    first[np.searchsorted(at, batch.offsets)] = True
    space = kind == SPACE
    before = np.concatenate([[0], kind[:-1]])
    blank_before = np.concatenate([[False], chars[:-1] == 0x20])
    goes_on = np.concatenate([~space[1:] & ~first[1:-1], [False]])  # a character that isn't space follows in the document
    start = np.where(space, (before != SPACE) | goes_on, (before != kind) & ~((before == SPACE) & blank_before))
    start |= first[:-1]

    quote = np.flatnonzero(start & (chars == 0x27) & (np.concatenate([kind[1:], [0]]) == LETTER) & ~first[1:])
    if len(quote):
        c1 = chars[quote + 1]
        c2 = np.where(quote + 2 < n, chars[np.minimum(quote + 2, n - 1)], 0)
        c2[first[np.minimum(quote + 2, n)]] = 0
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        hit, end = quote[one | two], (quote + np.where(one, 2, 3))[one | two]
        start[hit + 1] = False
        start[end[end < n]] = True
    return at[start]


class PieceEncoder:
    """Ids of whole texts, piece by piece.

    encode: gives the ids of each piece of a list. most: pieces that are remembered at most.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = 1_200_000):
        self._encode, self._most = encode, most
        self._clear()

    def _clear(self) -> None:
        self._key = np.zeros(0, np.uint64)  # hashes of known pieces, sorted; of each, its place in _flat and its number of ids
        self._start = np.zeros(0, np.int32)
        self._count = np.zeros(0, np.int32)
        self._flat = np.zeros(0, np.uint32)

    def ids(self, batch: TextBatch) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch, and each document's offset into them."""
        starts = split(batch)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(batch) + 1, np.int64)
        ends = np.append(starts[1:], len(batch.data))
        code, distinct = pd.factorize(batch.hashes(starts, ends))
        if len(self._key) > self._most:
            self._clear()
        rows = np.searchsorted(self._key, distinct)
        known = rows < len(self._key)
        known[known] = self._key[rows[known]] == distinct[known]
        new = np.flatnonzero(~known)
        if len(new):
            some = np.empty(len(distinct), np.int64)
            some[code] = np.arange(len(code))
            new = new[np.argsort(distinct[new])]
            where = some[new]
            raw = batch.data.tobytes()
            found = self._encode([raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            count = np.fromiter(map(len, found), np.int32, len(found))
            at = rows[new]
            self._start = np.insert(self._start, at, len(self._flat) + np.cumsum(count) - count)
            self._count = np.insert(self._count, at, count)
            self._key = np.insert(self._key, at, distinct[new])
            self._flat = np.append(self._flat, np.fromiter((i for x in found for i in x), np.uint32, int(count.sum())))
            rows = np.searchsorted(self._key, distinct)
        piece = rows[code]
        count = self._count[piece].astype(np.int64)
        end = np.cumsum(count)
        ids = self._flat[np.repeat(self._start[piece] - (end - count), count) + np.arange(end[-1])]
        upto = np.concatenate([[0], end])
        return ids, upto[np.searchsorted(starts, batch.offsets)]


class AddedTokenEncoder:
    """Ids of whole texts in which added tokens stand for themselves; the parts between go to an encoder of pieces.

    added: the tokens' content and id. Where several match at a place, the longest does.
    """

    def __init__(self, encoder: PieceEncoder, added: dict[str, int]):
        self._encoder = encoder
        self._added = {k.encode(): v for k, v in added.items()}
        self._find = re.compile(b"|".join(re.escape(k) for k in sorted(self._added, key=len, reverse=True)))

    def ids(self, batch: TextBatch) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch, and each document's offset into them."""
        raw = batch.data.tobytes()
        if not self._added or not any(k in raw for k in self._added):
            return self._encoder.ids(batch)
        parts, ends, tokens, at = [], [], [], 0  # bounds of parts, the last part of each document, and the id after a part (-1: none)
        for a, b in zip(batch.offsets.tolist(), batch.offsets[1:].tolist(), strict=False):
            for m in self._find.finditer(raw, a, b):
                parts.append((at := max(at, a), m.start()))
                tokens.append(self._added[m[0]])
                at = m.end()
            parts.append((max(at, a), b))
            tokens.append(-1)
            ends.append(len(parts))
            at = b
        data = np.concatenate([batch.data[a:b] for a, b in parts])
        ids, upto = self._encoder.ids(TextBatch(data, np.concatenate([[0], np.cumsum([b - a for a, b in parts])])))
        token = np.array(tokens)
        hit = np.flatnonzero(token >= 0)
        out = np.insert(ids, upto[hit + 1], token[hit].astype(ids.dtype))
        upto = upto + np.concatenate([[0], np.cumsum(token >= 0)])
        return out, upto[np.concatenate([[0], ends]).astype(np.int64)]


@cache
def library_encoder(path: str) -> PieceEncoder:
    """A worker's encoder over a tokenizer file of the tokenizers library, added tokens taken as plain text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    def encode(pieces: list[bytes]) -> list[list[int]]:
        return [x.ids for x in tokenizer.encode_batch_fast([p.decode("utf-8") for p in pieces], add_special_tokens=False)]

    return PieceEncoder(encode)


@cache
def whole_text_encoder(path: str) -> AddedTokenEncoder:
    """A worker's encoder that gives what the library gives for whole texts at its defaults."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    odd = [t["content"] for t in tokens if t["single_word"] or t["lstrip"] or t["rstrip"]]
    if odd:
        raise ValueError(f"added tokens that depend on what is around them aren't supported: {odd}")
    return AddedTokenEncoder(library_encoder(path), {t["content"]: t["id"] for t in tokens})
