"""Operators 3, 4, 6, 9, 10 and the pipeline against brute force on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

import corpus_pipeline
from folio.llm import components, langid, lm, quality, secrets, simhash
from folio.llm.queries import RANKS
from tests.llm.fixtures import clashing, documents, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_fingerprint(text):
    words = WORD.findall(lowered(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, edges):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def test_simhash_groups(spark):
    extra = [(None, "only nameless rows hold this one"), (None, "only nameless rows hold this one")]
    rows = simhash.near_duplicates(clashing(documents(spark, texts() + extra))).collect()
    fps = defaultdict(list)
    for i, t in texts() + extra:
        fps[brute_fingerprint(t)].append(i)
    nodes = sorted(fps)
    comp = brute_components(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 4])
    first = {c: min((i for f in nodes if comp[f] == c for i in fps[f] if i is not None), default=None) for c in comp.values()}
    expected = Counter((i, f"{f:016x}", first[comp[f]]) for f, ids in fps.items() for i in ids)
    assert Counter(map(tuple, rows)) == expected
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_a_fingerprint_of_rows_without_doc_id_bridges_two(spark, monkeypatch):
    values = {"x": 0, "y": 0b1111, "z": 0b11111111}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: spark.createDataFrame([(1, values["x"]), (None, values["y"]), (2, values["z"])], "doc_id long, fp long"))
    assert {r["component_id"] for r in simhash.near_duplicates(documents(spark)).collect()} == {1}


def as_int(x):
    return int(np.int64(x).view(np.uint64))


@pytest.mark.parametrize("tile", [16, 100_000])
def test_links_join_all_near_pairs_in_hot_buckets(spark, tile):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [int(b) ^ sum({1 << int(k) for k in rng.integers(0, 64, int(rng.integers(0, 6)))}) for b in base for _ in range(12)]
    crowd = [int(base[0]) ^ (1 << int(i)) ^ (1 << int(j)) for i in range(24) for j in range(i)]
    fps = np.array(sorted({*map(int, base), *near, *crowd}), np.uint64)
    df = spark.createDataFrame([(int(x), int(x)) for x in fps.view(np.int64)], "id long, fp long")
    found = simhash.links(simhash.met(df, ["fp"], simhash.group_masks(6, 2)), ["fp"], 4, tile=tile).collect()
    assert all((as_int(r["src"]) ^ as_int(r["dst"])).bit_count() <= 4 for r in found)
    nodes = [int(x) for x in fps]
    brute = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (a ^ b).bit_count() <= 4]
    assert brute_components(nodes, [(as_int(r["src"]), as_int(r["dst"])) for r in found]) == brute_components(nodes, brute)


@pytest.mark.parametrize("tile", [8, 1000])
def test_links_across_labels_are_all_pairs(spark, tile):
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(0, 3)), k, int(rng.integers(0, 1 << 6)), int(rng.integers(0, 4)), int(rng.integers(1, 30))) for k in range(120)]
    df = spark.createDataFrame(rows, "bucket long, id long, f0 long, group long, n long").withColumn("f1", F.lit(7).cast("long"))
    found = simhash.links(df, ["f0", "f1"], 2, "n", (4, 5), "group", tile=tile).collect()
    fits = lambda m, n: 5 * min(m, n) >= 4 * max(m, n)
    expected = {(r[0], r[1], s[1]) for r in rows for s in rows if r[1] < s[1] and r[0] == s[0] and r[3] != s[3] and (r[2] ^ s[2]).bit_count() <= 2 and fits(r[4], s[4])}
    assert {(r["bucket"], min(r["src"], r["dst"]), max(r["src"], r["dst"])) for r in found} == expected and expected


def test_tiles_skip_what_their_population_counts_part():
    rng = np.random.default_rng(3)
    sparse, dense = (simhash.Tile(rng.choice(1 << k, (300, 1), replace=False).astype(np.uint64) | np.uint64(fill)) for k, fill in ((12, 0), (12, ((1 << 40) - 1) << 20)))
    assert not list(simhash.tile_links(sparse, dense, 4))
    looked = []
    sparse.near = lambda *a: looked.append(a) or simhash.Tile.near(sparse, *a)
    list(simhash.tile_links(sparse, dense, 4))
    assert not looked


@pytest.mark.parametrize("block", [40, 1_000_000])
def test_connected_components(spark, block):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 450)] + [(7, 7)]
    rows = components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b", block=block).collect()
    expected = brute_components({x for e in edges for x in e}, edges)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {r["id"]: r["component"] for r in rows} == {x: c for x, c in expected.items() if x in linked}
    assert len(rows) == len(linked)
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute_spans(text):
    text = text or ""
    keyword = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token", "api_key", "apikey")).replace("[__]", "_")
    found = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({keyword})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secret_scan(spark):
    rows = secrets.scan(clashing(documents(spark)), RANKS).collect()
    by_text = {i: t for i, t in texts() if i != 13}
    for r in rows:
        if r["doc_id"] in by_text:
            base = brute_spans(by_text[r["doc_id"]])
            shown = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
            assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
            assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
            assert set(filter(None, shown.split(","))) <= set(filter(None, r["spans"].split(",")))
    row = next(r for r in rows if r["doc_id"] == 12)
    assert "random:" in row["spans"] and (row["n_assign"], row["n_access"], row["n_hex"]) == (2, 1, 1)
    assert all(r["spans"] == "" for r in rows if r["doc_id"] in (1, 5, 9, 14))
    assert len(rows) == len(texts()) and secrets.scan(documents(spark, []), RANKS).count() == 0


def test_random_strings_are_told_from_names():
    import random
    import string

    encoding = secrets._tiktoken(RANKS)
    found = lambda t: [k for _, k, _ in secrets.random_spans(t, encoding, 2.0)]
    names = ["getElementByIdentifier2", "iPhone12ProMaxCase2020", "user_profile_image_v2_final", "2023-10-12T10-20-30Z", "da39a3ee5e6b4b0d3255bfef95601890afd80709", "123e4567-e89b-12d3-a456-426614174000", "antidisestablishmentarianism", "4532-1111-2222-3333-4444"]
    assert [n for n in names if found(f"see {n} here")] == []
    rng = random.Random(2)
    keys = ["".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(36)) for _ in range(200)]
    assert sum(bool(found(f"key {k}.")) for k in keys) >= 198


def test_redaction_keeps_all_but_secrets(spark):
    docs = documents(spark)
    rows = secrets.redact(docs, RANKS).collect()
    assert len(rows) == len(texts())
    before = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    changed = [r for r in rows if (r["doc_id"], r["text"]) not in before]
    assert [r["doc_id"] for r in changed] == [12]
    assert "hunter22" not in changed[0]["text"] and "04dbeb" not in changed[0]["text"] and "AKIA" not in changed[0]["text"] and "key token = " in changed[0]["text"]


def test_quality_counts(spark):
    rows = quality.judge(clashing(documents(spark)), quality.DecisionList(())).collect()
    found, expected = Counter(), Counter()
    for r in rows:
        found[(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"])] += 1
    for i, t in texts():
        t = t or ""
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        expected[(i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed, not failed)] += 1
    assert found == expected


def test_decision_list_is_learned_and_emitted(spark):
    rng = np.random.default_rng(1)
    table = {s: rng.random(600) for s in quality.SHARES}
    bad = (table["symbols_per_word"] > 0.7) | ((table["upper_share"] > 0.6) & (table["marks_per_word"] > 0.5))
    rules = quality.learn(table, bad)
    assert (rules.rejects(table) == bad).mean() > 0.97
    assert quality.learn(table, np.zeros(600, bool)).rules == ()
    counts = spark.createDataFrame([(60, 300, 50, 1, 0, 0, 20, 0, 0, 250, 40), (60, 300, 0, 1, 0, 0, 20, 0, 0, 250, 40), (0,) * 11], ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_bars", "n_letters", "n_distinct_words")))
    hit = quality.DecisionList(((quality.Condition("symbols_per_word", True, 0.5),),)).rule_number()
    assert [r[0] for r in counts.select(hit).collect()] == [1, None, None]


def test_language_model(spark):
    docs = clashing(documents(spark))
    for block_bytes in (1 << 20, 2000):
        rows = lm.score_documents(docs, block_bytes=block_bytes).collect()
        remainder = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 5
        train = Counter()
        for i, t in texts():
            if remainder(i) != 1:
                train.update([*WORD.findall(lowered(t)), None])
        n, v = sum(train.values()), len(train)
        found = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
        expected = Counter()
        for i, t in texts():
            words = [*WORD.findall(lowered(t)), None]
            base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
            expected[(i, remainder(i) == 1, len(words), sum(train[w] > 0 for w in words), n, round(base, 6))] += 1
        assert found == expected
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)
        scores = sorted(round(r["score"], 9) for r in rows)
        assert block_bytes == 1 << 20 or scores == pytest.approx(first, abs=1e-6)
        first = scores
    assert lm.score_documents(documents(spark, [])).count() == 0


def test_interpolated_scores_against_brute_force(spark):
    """Counts, held-out cells, expectation-maximisation and mixing in plain Python."""
    remainder = lambda i: zlib.crc32(str(i).encode()) % 5
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choice(words[: 5 + i % 55], int(rng.integers(0, 40))))) for i in range(200)]

    def counts(folds):
        one, two, context = Counter(), Counter(), Counter()
        for i, t in rows:
            if remainder(i) in folds:
                tokens = [*t.split(), "</s>"]
                one.update(tokens)
                two.update(zip(["<s>", *tokens], tokens))
                context["<s>"] += 1
        return one, two, Counter(one) + context

    bucket = lambda c: c.bit_length()  # noqa: E731  0 for none, else 1 + the whole logarithm
    half_octave = lambda p: 0 if p <= 0 else min(99, max(1, round(99 + 2 * math.log2(p))))

    def parts(context, token, one, two, before):
        return (two[context, token] / before[context] if before[context] else 0.0), one[token] / sum(one.values())

    kept = counts({2, 3, 4})
    cells = defaultdict(Counter)
    for i, t in rows:
        if remainder(i) == 0:
            tokens = [*t.split(), "</s>"]
            for c, w in zip(["<s>", *tokens], tokens):
                p2, p1 = parts(c, w, *kept)
                cells[bucket(kept[2][c])][half_octave(p2), half_octave(p1)] += 1
    value = lambda c: 2.0 ** ((c - 99) / 2) if c else 0.0
    uniform = 1 / (len(kept[0]) + 1)
    weights = {}
    for b, found in cells.items():
        w = [0.0, 0.5, 0.5] if b == 0 else [1 / 3] * 3
        for _ in range(60):
            got = [0.0, 0.0, 0.0]
            for (c2, c1), n in found.items():
                share = [w[0] * value(c2), w[1] * value(c1), w[2] * uniform]
                got = [g + n * x / sum(share) for g, x in zip(got, share)]
            w = [g / sum(got) for g in got]
        w = [max(x, 0.0 if b == 0 and k == 0 else 1e-6) for k, x in enumerate(w)]
        weights[b] = [x / sum(w) for x in w]

    def weight(b):
        if b not in weights:
            b = max((x for x in weights if x < b), default=min(weights))
        w = weights[b]
        return [0.0, w[1] + w[0] / 2, w[2] + w[0] / 2] if b == 0 else w

    train = counts({0, 2, 3, 4})
    expected = {}
    for i, t in rows:
        tokens = [*t.split(), "</s>"]
        total = 0.0
        for c, w in zip(["<s>", *tokens], tokens):
            p2, p1 = parts(c, w, *train)
            a = weight(bucket(train[2][c]))
            total += math.log10(a[0] * p2 + a[1] * p1 + a[2] / (len(train[0]) + 1))
        expected[i] = total
    found = lm.score_documents(documents(spark, rows), block_bytes=1500, range_bytes=4000).collect()
    assert {r["doc_id"]: r["score"] for r in found} == pytest.approx(expected, rel=1e-6)
    held = [r for r in found if r["held_out"] and r["n_tokens"] > 5]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_mixture_probabilities_sum_to_one():
    cells = [(0, 0, 80, 5), (1, 90, 80, 7), (3, 95, 70, 9), (3, 0, 60, 2)]
    weights = lm.learn_weights(cells, 1000)
    assert np.allclose(weights.sum(axis=1), 1) and (weights[0][0] == 0) and (weights >= 0).all()
    assert np.allclose(lm.learn_weights([], 10).sum(axis=1), 1)


def test_language_id(spark):
    english, other = "the rain in spain falls mainly on the plain ", "der regen fällt überwiegend auf die ebene und "
    rows = [(i, (english if i % 2 else other) * (1 + i % 5)) for i in range(80)] + [(90, None), (91, ""), (92, "123 !! ½"), (93, "日本語")]
    docs = spark.createDataFrame([(i, t, None if i > 70 else ("en" if i % 2 else "de")) for i, t in rows], "doc_id long, text string, lang string")
    net = langid.fit(docs, docs["doc_id"] >= 0, steps=120)
    out = {r["doc_id"]: r for r in langid.predict(clashing(docs), net).collect()}
    assert all(out[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(80))
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (90, 91, 92))
    assert out[93]["lang_pred"] in ("en", "de") and all(0 <= r["score"] <= 1 for r in out.values())
    assert langid.fit(docs.where("false"), docs["doc_id"] >= 0) is None
    assert langid.predict(docs.where("false"), net).count() == 0


def test_pipeline_stages(spark, tmp_path):
    good = lambda k: " ".join(f"word{k}x{j} of the" for j in range(40))
    rows = [(k, good(k)) for k in range(1, 30)] + [(40, good(1)), (41, good(2) + " more"), (42, None), (43, "!!"), (44, "short text"), (45, good(50) + ' password: "s3cretvalue"')]
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
    kept = {r["doc_id"]: r["text"] for r in at.collect()}
    assert set(kept) == {*range(1, 30), 45} and "s3cretvalue" not in kept[45]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == set(kept)


def test_fits_take_repeated_and_null_ids(spark):
    """A doc_id that many rows hold, or none, is neither left out whole nor taken whole."""
    rng = np.random.default_rng(6)
    en, de = ("the and of with house river".split(), "der und ein mit haus fluss".split())
    text = lambda words: " ".join(rng.choice(words, 60))
    rows = [(i, text(w), lang, "s", 1) for w, lang in ((en, "en"), (de, "de")) for i in [None] * 60 + [3] * 60]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    net = langid.fit(docs, F.lit(True), per_language=40, steps=60)
    assert net is not None and net.languages == ["de", "en"]
    drawn = []
    labels = spark.createDataFrame([(3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    original = quality.learn
    try:
        quality.learn = lambda table, bad, **_: drawn.append(len(bad)) or original(table, bad)
        quality.fit(docs, labels, most_rows=25)
    finally:
        quality.learn = original
    assert drawn == [25]


def test_spans_inside_of_base_spans_are_named_once():
    class Short:
        encode_ordinary = staticmethod(lambda part: part)

    text = " ".join(f"secret = {k:08x}qwertyuiopasdfghjklz and {k:08x}zxcvbnmasdfghjklqwert" for k in range(200))
    base, spans = secrets.all_spans(text, Short, 2.0)
    extra = [x for x in secrets.random_spans(text, Short, 2.0) if not any(s <= x[0] and x[2] <= e for s, _, e in base)]
    assert spans == sorted(base + extra) and len(extra) == 200
