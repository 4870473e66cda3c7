"""Texts that hold some characters twice in a row, against the pattern itself."""

import random
import re

import pytest

from folio.functions import text as T
from folio.operators import qa


@pytest.mark.parametrize("kept", [T._KEPT, 7])
def test_repeats_against_the_pattern(monkeypatch, kept):
    monkeypatch.setattr(T, "_KEPT", kept)
    monkeypatch.setattr(T, "_PAIRS", 50)
    T._kept_anchors.cache_clear()
    rng = random.Random(3)
    lines = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 70))) for letters in ("ab", "abc", "abcdef", "aé日😀") for _ in range(800)]
    lines += ["".join(rng.choice("abcdefgh") for _ in range(k)) + "-" + 2 * "".join(map(chr, range(200, 200 + m))) + "+" for k in range(0, 30, 3) for m in range(1, 40)]
    found = [T.has_repeat(line) for line in lines]
    T._kept_anchors.cache_clear()
    assert found == [bool(re.search(T.REPEAT, line)) for line in lines] and 100 < sum(found) < len(found) - 100


def test_repeats_end_with_lines_as_in_the_engine(spark):
    texts = ["abcdabcd", "abcd\nabcd", "ab\rcdab\rcd", "x yzx yz", "aaaa\x85aaaa", "a\x0bcda\x0bcd", None, "", "😀bcd😀bcd", "cdabcdab" * 2000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(T.repeated(df["text"])).collect()] == [r[0] for r in df.select(df["text"].rlike(T.REPEAT)).collect()]


def test_a_long_line_without_repeats(spark):
    """200,000 characters; a search that backtracks would compare each with all others."""
    df = spark.createDataFrame([("p", "b", "".join(chr(0x4E00 + random.Random(1).randrange(9) + i % 20000) for i in range(200000)))], "page_id string, block_id string, text string")
    found = qa.glued_text(df)
    assert T.REPEAT not in found._jdf.queryExecution().executedPlan().toString() and found.count() in (0, 1)
