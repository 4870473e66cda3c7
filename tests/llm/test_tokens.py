"""Operators 5, 7 and 8 against the tokenizer libraries."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import bpe, dac, packing
from folio.llm.pieces import library_encoder, split
from folio.llm.textarrays import TextBatch
from tests.llm.fixtures import clashing, documents, texts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
with open(RANKS, "rb") as lines:
    _ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
ENCODING = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks, special_tokens={})
PREFIX = bpe.PrefixBpe(_ranks)
AWKWARD = st.text(st.sampled_from("ab'srevldtm 1 2.!'  \n\t\r　é一½Ⅷ x\x1c\x85\U0001f600"), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(AWKWARD, max_size=6))
def test_split_is_the_pattern(some):
    expected, base = [], 0
    for text in some:
        for m in regex.findall(public_tokenizers.PATTERN, text):
            expected.append(base)
            base += len(m.encode())
    assert split(TextBatch.of(some)).tolist() == expected


@settings(max_examples=200, deadline=None)
@given(AWKWARD)
def test_prefix_bpe_is_tiktoken(text):
    ids = [i for piece in regex.findall(public_tokenizers.PATTERN, text) for i in PREFIX.encode(piece.encode())]
    assert ids == ENCODING.encode_ordinary(text)
    assert PREFIX.decode(ids) == text.encode()


def test_append_and_edit_agree_with_a_fresh_table():
    rng = random.Random(3)
    for _ in range(100):
        piece = bytes(rng.choice(b"abcde theraning") for _ in range(rng.randint(0, 400)))
        table = PREFIX.last_tokens(piece)
        a = rng.randint(0, len(piece))
        b = rng.randint(a, min(len(piece), a + 5))
        new = bytes(rng.choice(b"athe") for _ in range(rng.randint(0, 4)))
        edited, found = PREFIX.edit(table, piece, a, b, new)
        assert edited == piece[:a] + new + piece[b:]
        assert found == PREFIX.last_tokens(edited)
        assert PREFIX.append(table, piece, new) == PREFIX.last_tokens(piece + new)


def test_library_encoder_is_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    library.encode_special_tokens = True
    some = [t for _, t in texts()] + ["<|endoftext|> x", "it's we'LL"]
    ids, at = library_encoder(TOKENIZER).ids(TextBatch.of(some))
    for i, t in enumerate(some):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids


def _expected(end):
    return [(i, np.array([*ENCODING.encode_ordinary(t or ""), *end], "<u4")) for i, t in texts()]


def test_round_trip_digests(spark):
    rows = bpe.round_trip(clashing(documents(spark)), RANKS).collect()
    shown = lambda ids: hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    expected = [(i, len(ids), shown(ids.tolist()), hashlib.sha256((t or "").encode()).hexdigest()) for (i, ids), (_, t) in zip(_expected([]), texts(), strict=True)]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, expected))
    ids = bpe.encode_documents(documents(spark), RANKS)
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode_documents(ids, RANKS).collect()}
    assert all(back[i] == (t or "").encode() for i, t in texts() if i != 13)
    assert bpe.round_trip(documents(spark, []), RANKS).count() == 0


def test_container_has_random_access():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = rng.choice([0, 255, 256, 50000, 70000, 2**32 - 1], n).astype(np.uint32)
        starts = np.array([0, *sorted(rng.integers(0, n + 1, 3)), n])
        box = dac.Reader(dac.pack(ids, starts))
        assert [box.get(i) for i in range(n)] == ids.tolist()
        for a, b in ((0, n), (n // 3, n // 2), (n, n)):
            assert box.range(a, b).tolist() == ids[a:b].tolist()
        assert np.concatenate([box.document(k) for k in range(4)]).tolist() == ids.tolist()


def test_token_file(spark):
    rows = sorted(dac.round_trip(clashing(documents(spark)).repartition(3), TOKENIZER, 2).collect(), key=lambda r: r["start"])
    by_id = defaultdict(list)
    for i, ids in _expected([2]):
        by_id[i].append((len(ids), zlib.crc32(ids)))
    start = 0
    for r in rows:
        assert r["start"] == start
        by_id[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
        start += r["n_tokens"]
    assert not any(by_id.values())
    ids = [r["doc_id"] for r in rows]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert dac.round_trip(documents(spark, []), TOKENIZER, 2).count() == 0


def test_packing_covers_every_id_once(spark):
    rows = packing.pack_documents(clashing(documents(spark)).repartition(2), TOKENIZER, 0, 64).collect()
    whole = defaultdict(list)
    for i, ids in _expected([0]):
        whole[i].append(ids)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for group in sequences.values():
        group.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in group] == np.cumsum([0, *(r["length"] for r in group)])[:-1].tolist()
        size = sum(r["length"] for r in group)
        assert size == 64 or size & (size - 1) == 0 and size < 64
    for i, texts_ in whole.items():
        for ids in texts_:
            some = sorted(pieces[i, len(ids)], key=lambda r: r["start"])
            assert sum(r["length"] for r in some) == len(ids)
            assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for r in some)
    assert packing.pack_documents(documents(spark, []), TOKENIZER, 0).count() == 0


def test_level_choice_is_the_least_sum_of_squares():
    rng = np.random.default_rng(2)
    for _ in range(200):
        packer = packing.SquaresPacker(16)
        packer.open[1:16] = rng.integers(0, 4, 15)
        size = int(rng.integers(1, 16))

        def after(level):
            now = packer.open.copy()
            if level:
                now[level] -= 1
            if level + size < 16:
                now[level + size] += 1
            return int((now[1:16] ** 2).sum())

        allowed = [h for h in range(16 - size + 1) if h == 0 or packer.open[h]]
        assert after(packer.level_for(size)) == min(map(after, allowed))


def test_hashes_do_not_depend_on_the_place(monkeypatch):
    from folio.llm import textarrays

    words = ["a", "b", "ab", "ba", "", "x" * 64, "x" * 65, "y" * 500, "été"]
    rng = random.Random(1)
    some = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    seen: dict[bytes, int] = {}
    for size in (1 << 20, 300):
        monkeypatch.setattr(textarrays, "SLICE_BYTES", size)
        textarrays._power_tables.cache_clear()
        batch = TextBatch.of(some)
        starts, ends = batch.words()
        for a, b, h in zip(starts, ends, batch.hashes(starts, ends).tolist(), strict=True):
            assert seen.setdefault(batch.data[a:b].tobytes(), h) == h
    textarrays._power_tables.cache_clear()
    assert len(set(seen.values())) == len(seen)


def test_rows_of_one_doc_id_have_a_fixed_order(spark):
    rows = [(5, f"text number {k} " * (1 + k % 3)) for k in range(40)] + [(None, "a"), (None, "b"), (5, None), (1, "x")]
    docs = documents(spark, rows)
    runs = [sorted(map(tuple, dac.round_trip(d, TOKENIZER, 2).collect()), key=str) for d in (docs.coalesce(1), docs.repartition(7, "text"))]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
