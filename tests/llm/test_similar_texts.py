"""The pipeline's near copies against all pairs of texts."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from folio.llm import simhash
from tests.llm.fixtures import documents


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def altered(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return words


def test_near_copies_just_above_the_threshold_leave(spark):
    rng = random.Random(6)
    rows, texts = [], []
    for k in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts += [" ".join(base)] + [" ".join(altered(rng, base, n)) for n in (3, 4, 5, 9)]
    rows = list(enumerate(texts, 1))
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {i: shingles(t) for i, t in rows}
    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    expected = {root(i) for i in sets}
    assert 30 < len(expected) < len(rows)
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(expected)


def test_refuted_links_leave_no_pair_unchecked(spark):
    """A crowd of texts around the threshold: those that the sets refute stay apart, and all others are joined."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(160)]
    rows = list(enumerate((" ".join(altered(rng, base, rng.choice((1, 2, 3, 4)))) for _ in range(60)), 1))
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(i, j) for i in sets for j in sets if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    group = {i: i for i in sets}
    for _ in sets:
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
    found = simhash.similar_texts(documents(spark, rows).withColumn("row_key", F.col("doc_id")), tile=16).collect()
    of = {r["doc_id"]: r["component"] for r in found}
    assert len({of[i] for i in of}) == len(set(group.values())) and all(of[i] == of[j] for i, j in pairs)


def test_rows_that_share_a_doc_id_or_have_none(spark):
    rng = random.Random(7)
    a, b, c, d = (" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(4))
    rows = [(1, a), (1, b), (1, b), (2, a + " tail"), (None, a), (None, c), (None, c), (None, d), (3, d), (None, None), (4, ""), (5, "!")]
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect()
    found = sorted(((r["doc_id"], r["text"]) for r in kept), key=str)
    assert found == sorted([(1, a), (1, b), (None, c), (3, d), (4, ""), (5, "!")], key=str)


def test_a_group_without_a_doc_id_bridges_two(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join([*words[: 200 - k], *(f"n{i}" for i in range(k))]) for k in (0, 16, 32)]
    rows = [(1, texts[0]), (None, texts[1]), (2, texts[2])]
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect()
    assert [r["doc_id"] for r in kept] == [1]


def test_checked_links_join_what_is_similar():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[int(rng.integers(0, 20)) :], rng.integers(0, 1 << 63, int(rng.integers(0, 8)), dtype=np.uint64)])) for _ in range(40)] + [np.zeros(0, np.uint64)]
    labels = np.arange(len(sets)) // 2
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if labels[i] != labels[j]]
    raw = np.array([s.tobytes() for s in sets], object)
    i, j = simhash.Checked(raw, labels, (4, 5)).links(*map(np.array, zip(*pairs)))
    similar = lambda a, b: len(sets[a]) and 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))
    assert all(similar(a, b) for a, b in zip(i.tolist(), j.tolist())) and len(i) < len(sets)

    def groups(links):
        own = labels.tolist()
        for _ in own:
            for a, b in links:
                low, high = sorted((own[a], own[b]))
                own = [low if x == high else x for x in own]
        return own

    assert groups(list(zip(i.tolist(), j.tolist()))) == groups([p for p in pairs if similar(*p)])


def test_masks_follow_the_number_of_texts():
    sizes = [10**4, 10**6, 10**8, 10**10]
    found = [simhash.masks_for(n, 0.8) for n in sizes]
    assert found[0] == (96, 16) and all(n / 2**bits <= simhash.BUCKET for n, (_, bits) in zip(sizes, found, strict=True))
    agree = 1 - np.arccos(2 * 0.8 / 1.8) / np.pi
    assert all((1 - agree**bits) ** tables <= 8e-4 for tables, bits in found)
    compared = [tables * n / 2**bits for n, (tables, bits) in zip(sizes, found, strict=True)]
    assert compared[3] / compared[1] < 10_000 / 100  # a text's comparisons grow far slower than the texts


def test_one_long_text_in_a_crowd(spark, monkeypatch):
    """Tiles of sets are cut by their bytes: a long text has tiles of its own, and what is joined is the same."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(5000)}" for _ in range(160)]
    long = [f"x{i}" for i in range(30_000)]
    texts = [" ".join(altered(rng, base, rng.choice((1, 2, 3, 4)))) for _ in range(40)] + [" ".join(long), " ".join(altered(rng, long, 50))]
    docs = documents(spark, list(enumerate(texts, 1))).withColumn("row_key", F.col("doc_id"))
    joined = lambda: sorted((r["doc_id"], r["component"]) for r in simhash.similar_texts(docs, tile=16).collect())
    whole = joined()
    monkeypatch.setattr(simhash, "SET_BYTES", 1 << 14)
    assert joined() == whole and dict(whole)[41] == dict(whole)[42] and len({c for _, c in whole}) < 25
