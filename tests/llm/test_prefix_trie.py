"""The trie of rebuilt conversations against plain Python and the oracle SQL; many levels of small blocks against one."""

import hashlib
import random
import zlib

import duckdb
import pytest

from folio.llm import prefix_trie
from tests.llm.fixtures import clashing

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def talk(seed=1, n=60):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "ünï", "", None])) for c in [*range(n), *range(100, 110), -7, -100] for t in range(rng.randrange(1, 6))]
    rows += [(c, t, "user", "same") for c in range(201, 240) for t in range(2)]  # no conversation 200: nothing is shared
    rows += [(300, t, "user", f"long {t}") for t in range(90)]
    rows += [(301, None, "user", "first"), (301, 0, "user", "next"), (302, 5, "b", "x"), (302, 5, "a", "y"), (302, 5, "a", "y"), (None, 0, "user", "lost")]
    rows += [(c, 0, "system", "z" * 3000) for c in (400, 401)]
    rng.shuffle(rows)
    return rows


def plain(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, role, mark, text))
    own = {c: [(r[2], r[4]) for r in sorted(turns)] for c, turns in own.items()}
    members = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append((c, d == len(whole)))
    out = []
    for node, found in members.items():
        below = [k for k in members if k[: len(node)] == node]
        kids = {k for k in below if len(k) == len(node) + 1}
        leaves = sum(not any(o[: len(k)] == k and len(o) == len(k) + 1 for o in below) for k in below)
        saved = sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k)
        ends = ",".join(str(c) for c in sorted(c for c, last in found if last))
        up = min(c for c, _ in members[node[:-1]]) if node else None
        out.append((min(c for c, _ in found), len(node), up, len(found), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [(50_000, 64), (7, 3)])
def test_against_python_and_sql(spark, sizes):
    rows = talk()
    found = prefix_trie.prefix_nodes(clashing(spark.createDataFrame(rows, SCHEMA)), *sizes).select(*COLUMNS).collect()
    want = plain(rows)
    assert sorted((tuple(r) for r in found), key=str) == want
    with duckdb.connect() as c:
        c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        assert sorted((tuple(r) for r in c.execute(prefix_trie.ORACLE).fetchall()), key=str) == want


def test_a_conversation_that_most_repeat(spark):
    """More ids of one node than a chunk holds."""
    rows = [(100 * i + 1, 0, "user", "hello") for i in range(20_000)] + [(100 * i + 2, t, "user", str(i)) for i in range(3) for t in range(4)]
    found = prefix_trie.prefix_nodes(spark.createDataFrame(rows, SCHEMA)).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain(rows)


def test_blocks_peel_like_one():
    """Runs of a sorted table, peeled by themselves and their open paths together, give what one run gives."""
    rng = random.Random(3)
    paths = sorted({b"".join(hashlib.md5(bytes(p[: d + 1])).digest() for d in range(len(p))) for p in ([rng.randrange(3) for _ in range(rng.randrange(0, 9))] for _ in range(150))})
    rows = []
    for i, path in enumerate(paths):
        depth = len(path) // 16
        rows.append(prefix_trie.Path(path, b"".join((k + 1).to_bytes(8, "little") for k in range(depth)), [prefix_trie.Part(depth, i % 3 + 1, 1000 - i, 0, 0, 0, str(i))]))
    whole, none = prefix_trie.peel(rows, True)
    assert not none
    done, spines = [], []
    for at in range(0, len(rows), 11):
        finished, still_open = prefix_trie.peel(rows[at : at + 11], False)
        done += finished
        spines += still_open
    last, none = prefix_trie.peel(spines, True)
    bare = lambda found: sorted(str([d[k] for k in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")]) for d in found)
    assert not none and bare(done + last) == bare(whole)
