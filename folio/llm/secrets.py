"""Secret scans: fixed patterns, and strings that a tokenizer finds hard (operator 6).

Text that people write costs few tokens a character, since a vocabulary holds its words; a random
string falls apart into short tokens. A run of key characters whose ratio of characters to tokens is
low, or a part of it behind a readable prefix, is taken as a secret, unless it is a digest of a known
length, a UUID, a date or a plain number. The ratio decides on all else, in one case or without digits too.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of [0-9a-f]+ is maximal, so the short ones need no look
KINDS = ("assign", "access", "hex", "random")

#: A run of characters of keys. Its length is bounded below only.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})")
IDENTIFIER = re.compile(
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"  # UUID
    r"|[0-9]{4}[_/-]?[0-9]{2}[_/-]?[0-9]{2}[T_-][0-9_/+-]*Z?"  # dates and times
)
NUMBER = re.compile(r"[0-9_+/=-]+")  # numbers and rules
#: A digest or identifier at the end of a run; what stands before it is judged by itself.
KNOWN_END = re.compile(rf"(?:^|(?<=[_/=+-]))(?:{DIGEST.pattern}|{IDENTIFIER.pattern})$")
#: Characters from a run's end in which a known one is looked for; digests and dates are shorter.
END_CHARS = 160
#: Words as they are written, in one case or with a capital.
WORDS = re.compile(r"(?:(?:[A-Z]?[a-z]+|[A-Z]+)[_/=+-]*)+")
#: Consonants as they hardly stand in a word, and letters that stand for vowels in some language.
CROWD, VOWEL = re.compile(r"(?i:[bcdfghjklmnpqrstvxz]{4})"), re.compile(r"(?i:[aeiouwy])")
#: Of what could be words, with a ratio over this, only those without vowels enough are random.
WORD_RATIO = 1.9
#: Letters and digits that a key has, different ones; sequences of bases and repeated letters have fewer.
LEAST_DISTINCT = 8
PREFIX = re.compile(r"(?:[A-Za-z]+[_/=-]+)+")
PART = re.compile(r"[A-Za-z0-9+]{20,}")
_KEYWORD = ("passw", "secret", "token", "api")


@cache
def _tiktoken(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, lines)}
    return tiktoken.Encoding("secrets", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three fixed patterns, each leftmost and non-overlapping, failing matches dropped."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORD):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def pronounceable(part: str) -> bool:
    return not CROWD.search(part) and 10 * len(VOWEL.findall(part)) >= 3 * sum(c.isalpha() for c in part)


def is_random(run: str, encoding, most_ratio: float) -> bool:
    """Whether a run, what follows its prefix of words, or a part between separators is random.

    Left out before the ratio decides: parts under 20 characters or of few different ones, plain numbers, digests of known lengths, UUIDs and
    dates. A vocabulary of one language finds words of others hard too, so what could be words and lies just under the limit needs four consonants
    in a row besides, or less than three vowels in ten letters. Linear in the run's length.
    """
    known = KNOWN_END.search(run, max(0, len(run) - END_CHARS))
    run = run[: known.start()] if known else run
    prefix = PREFIX.match(run)
    for part in {run, run[prefix.end() :] if prefix else run, *PART.findall(run)}:
        if len(part) < 20 or NUMBER.fullmatch(part) or DIGEST.fullmatch(part):
            continue
        if len({c for c in part if c.isalnum()}) < LEAST_DISTINCT:
            continue
        n = len(encoding.encode_ordinary(part))
        if len(part) <= most_ratio * n and (len(part) <= WORD_RATIO * n or not (WORDS.fullmatch(part) and pronounceable(part))):
            return True
    return False


def random_spans(text: str, encoding, most_ratio: float) -> list[tuple[int, int, int]]:
    """Spans of the token-efficiency test."""
    return [(m.start(), 3, m.end()) for m in RUN.finditer(text) if is_random(m[0], encoding, most_ratio)]


def all_spans(text: str, encoding, most_ratio: float) -> tuple[list, list]:
    """The base spans, and these with the method's own; a random span inside a base span isn't named again."""
    base = base_spans(text)
    extra, at, reach = [], 0, -1
    for x in random_spans(text, encoding, most_ratio):  # both in order of their starts: `reach` is the furthest end of a base span that starts no later
        while at < len(base) and base[at][0] <= x[0]:
            reach = max(reach, base[at][2])
            at += 1
        if x[2] > reach:
            extra.append(x)
    return base, sorted(base + extra)


def _shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, ranks_path: str, most_ratio: float = 2.0) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every whole text.

    most_ratio: characters a token, at or under which a run is random. Offsets count code points. A
    null or empty text has no spans (the digest is that of the empty string); ties and repeated rows
    are scanned each; other columns are not read. A map over the rows: no shuffle.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _tiktoken(ranks_path)
        for batch in batches:
            counts, shas, shown = ([], [], []), [], []
            for text in batch.column("text"):
                base, spans = all_spans(text.as_py() or "", encoding, most_ratio)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                shas.append(hashlib.sha256(_shown(base).encode()).hexdigest())
                shown.append(_shown(spans))
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(shown, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, ranks_path: str, most_ratio: float = 2.0, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """The rows as they came, each secret of ``text_col`` replaced by ``mark``; of an assignment its value only.

    Overlapping spans become one mark. A text without secrets, null included, stays as it is; all
    rows and columns stay.
    """
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _tiktoken(ranks_path)
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            texts = []
            for cell in batch.column(i):
                text = cell.as_py()
                if text:
                    spans = []
                    for start, k, end in all_spans(text, encoding, most_ratio)[1]:
                        start = ASSIGN.match(text, start).start(2) if k == 0 else start
                        if spans and start < spans[-1][1]:
                            spans[-1][1] = max(end, spans[-1][1])
                        else:
                            spans.append([start, end])
                    for start, end in spans[::-1]:
                        text = text[:start] + mark + text[end:]
                texts.append(text)
            columns = batch.columns
            columns[i] = pa.array(texts, batch.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.select(*names).mapInArrow(run, schema)
