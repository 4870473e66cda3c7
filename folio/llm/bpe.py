"""Byte-level BPE by prefix dynamic programming (operator 5).

For every prefix of a piece exactly one token can end its encoding: the one whose predecessor's
prefix is encoded validly and which forms a pair with that prefix's last token that BPE would leave
unmerged. The table of these last tokens is the whole state: appending bytes extends it, an edit
invalidates it from the edit on and only until it falls into step with the old one, and reading it
backwards gives the encoding.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folio.llm.pieces import PieceEncoder
from folio.llm.textarrays import TextBatch, slices


class PrefixBpe:
    """The ids that byte-pair encoding by ranks gives, one piece (a match of the pattern) at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self._automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self._automaton.make_automaton()

    @classmethod
    def from_file(cls, path: str) -> PrefixBpe:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(t): int(i) for t, i in map(bytes.split, lines)})

    def halves(self, i: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes token i: its encoding with the ranks below its own. None: a single byte."""
        t = self.token[i]
        if len(t) == 1:
            return None
        if i not in self._halves:
            parts = [t[k : k + 1] for k in range(len(t))]
            while len(parts) > 2:
                rank = [self.ranks.get(a + b, i) for a, b in zip(parts, parts[1:], strict=False)]
                k = rank.index(min(rank))
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self._halves[i] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return self._halves[i]

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two neighbours as they are: no merge across their border comes before the merges that made them."""
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            known = self._fits[key] = self._undo(left, right)
        return known

    def _undo(self, left: int, right: int) -> bool:
        """Take back the merges at the border, latest first; at each step the pair across it must not merge earlier than what was taken back."""
        before = len(self.token) + 1
        while True:
            across = self.ranks.get(self.token[left] + self.token[right])
            if across is not None and across < before:
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                before, left = left, a[1]  # type: ignore[index]
            else:
                before, right = right + 1, b[0]

    def _extend(self, text: bytes, last: list[int]) -> Iterator[int]:
        """Give every prefix that the table lacks its last token; yields the prefixes' lengths.

        The automaton names the tokens that end at a byte, longest first; one of them at most fits.
        """
        at = max(0, len(last) - self.longest)
        fits, undo = self._fits, self.fits
        for end, (t, size) in self._automaton.iter(text.decode("latin-1"), at):
            if len(last) == end + 1:
                begin = end + 1 - size
                if begin == 0:
                    ok = True
                else:
                    ok = fits.get((last[begin], t))
                    if ok is None:
                        ok = undo(last[begin], t)
                if ok:
                    last.append(t)
                    yield end + 1

    def last_tokens(self, piece: bytes) -> list[int]:
        """The last token of every prefix (index 0 is the empty prefix's -1)."""
        return self.append([-1], b"", piece)

    def read(self, last: list[int]) -> list[int]:
        out, at = [], len(last) - 1
        while at:
            out.append(last[at])
            at -= len(self.token[last[at]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.read(self.last_tokens(piece))

    def append(self, last: list[int], piece: bytes, more: bytes) -> list[int]:
        """The table of piece + more from the piece's table; nothing before is computed again."""
        table = list(last)
        for _ in self._extend(piece + more, table):
            pass
        return table

    def edit(self, last: list[int], piece: bytes, start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """piece[start:stop] replaced by new, and its table.

        The table before the edit stays. After it, entries are computed until as many in a row as the
        longest token has bytes equal the old ones; from there on the old ones hold, since an entry
        depends on that many entries before it.
        """
        text = piece[:start] + new + piece[stop:]
        table, shift, same = last[: start + 1], len(text) - len(piece), 0
        for end in self._extend(text, table):
            same = same + 1 if end > start + len(new) and table[end] == last[end - shift] else 0
            if same >= self.longest:
                return text, table + last[end - shift + 1 :]
        return text, table

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@cache
def _encoder(path: str) -> tuple[PieceEncoder, np.ndarray, np.ndarray, np.ndarray]:
    """A worker's encoder, the ids as decimal text, and the tokens' bytes with their offsets."""
    bpe = PrefixBpe.from_file(path)
    n = max(bpe.token) + 1
    digits = np.array([str(i) for i in range(n)], object)
    tokens = [bpe.token.get(i, b"") for i in range(n)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
    return PieceEncoder(lambda pieces: [bpe.encode(p) for p in pieces]), digits, np.frombuffer(b"".join(tokens), np.uint8), offsets


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) of every whole text.

    A null text counts as empty and has no ids; ties and repeated rows are encoded each; other
    columns, whatever their names, are not read. A map over the rows: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)[0]
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, at = encoder.ids(TextBatch.of(batch.column("text")))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["doc_id", "ids"])

    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['id']}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, bytes (binary) from doc_id, ids; null ids give null bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, flat, offsets = _encoder(path)
        for batch in batches:
            out = [None if ids is None else b"".join(flat[offsets[i] : offsets[i + 1]].tobytes() for i in ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, bytes binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of every text's ids and of the bytes they decode to.

    A null or empty text has no ids: both digests are those of the empty string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, digits, flat, offsets = _encoder(path)
        size = np.diff(offsets)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, at = encoder.ids(TextBatch.of(batch.column("text")))
                length = size[ids]
                end = np.cumsum(length)
                decoded = flat[np.repeat(offsets[ids] - (end - length), length) + np.arange(end[-1] if len(end) else 0)].tobytes()
                upto = np.concatenate([[0], end])[at].tolist()
                shown = digits[ids].tolist()
                cuts = at.tolist()
                shas = [hashlib.sha256(" ".join(shown[a:b]).encode()).hexdigest() for a, b in zip(cuts, cuts[1:], strict=False)]
                backs = [hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(upto, upto[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
