"""Operators 7 and 8 against the tokenizers library at its defaults, over texts that hold its added token."""

import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from folio.llm import dac, packing
from folio.llm.pieces import whole_text_encoder
from folio.llm.queries import TOKENIZER
from folio.llm.textarrays import TextBatch
from tests.llm.fixtures import documents, texts

END = "<|endoftext|>"
TEXTS = [f"a {END} x", END, END * 3, f"{END}été ", f"it's {END}'s  {END}\n", f"  {END}  ", "<|endoftext|", "|>", "", None, f"x{END}1{END}", "<|endo", "ftext|>"]


def wanted(text):
    return Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids


def test_encoder_is_the_library_at_its_defaults():
    assert wanted(TEXTS[0]) == [64, 220, 50256, 2124]
    for some in (TEXTS, TEXTS[::-1], [t for _, t in texts()], [END], []):
        ids, at = whole_text_encoder(TOKENIZER).ids(TextBatch.of(some))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [wanted(t) for t in some]
        assert len(at) == len(some) + 1 and at[-1] == len(ids)


def test_token_file_and_packing_hold_added_tokens(spark):
    rows = list(enumerate(TEXTS))
    start = 0
    for r in sorted(dac.round_trip(documents(spark, rows), TOKENIZER, 2).collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*wanted(TEXTS[r["doc_id"]]), 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids))
        start += len(ids)
    pieces = defaultdict(int)
    for r in packing.pack_documents(documents(spark, rows), TOKENIZER, 0, 64).collect():
        ids = np.array([*wanted(TEXTS[r["doc_id"]]), 0], "<u4")
        assert r["doc_tokens"] == len(ids) and zlib.crc32(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"]
        pieces[r["doc_id"]] += r["length"]
    assert pieces == {i: len(wanted(t)) + 1 for i, t in rows}
