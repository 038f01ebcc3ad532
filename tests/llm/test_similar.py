"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from quarry.llm import simhash
from tests.llm import brute


def shingles(text):
    w = brute.words((text or "").translate(brute.LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def similar(x, y):
    return 9 * len(x & y) >= 4 * (len(x) + len(y))


def documents():
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    common = r.choices(vocabulary, k=30)
    rows = []
    for _ in range(60):
        base = r.choices(vocabulary, k=r.choice([3, 6, 30, 60, 120])) + r.choice([[], common])
        rows.append(base)
        for _ in range(r.choice([0, 1, 3])):
            text = list(base)
            for _ in range(r.choice([0, 1, 2, 4, 8])):
                at = r.randrange(len(text))
                text[at : at + r.choice([0, 1])] = r.choices(vocabulary, k=r.choice([0, 1, 2]))
            rows.append(text)
    group = r.choices(vocabulary, k=80)
    rows += [[*group[:k], "x", *group[k:]] for k in range(0, 80, 2)]
    texts = [" ".join(w) for w in rows] + ["One two THREE four", "one two three four", "", None, " \n", "Aa  bb cc dd ee\tff", "aA bb cc dd ee ff"]
    return [(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3]), (3, "another text with this number")]


def low_ids(rows, label):
    """The smallest id of each group, null last."""
    low = {}
    for (d, _), k in zip(rows, label):
        low[k] = min(low.get(k, (True, 0)), (d is None, d or 0))
    return Counter(low.values())


def test_keep_one_is_brute_force_jaccard_at_a_wide_radius(spark):
    rows = documents()
    sets = [shingles(t) for _, t in rows]
    label = brute.groups(sets, similar)
    sizes = Counter(label)
    assert len(sizes) < len(rows) - 60 and max(sizes.values()) >= 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = simhash.keep_one(docs, radius=12)
    assert kept.columns == docs.columns
    assert Counter((r[0] is None, r[0] or 0) for r in kept.collect()) == low_ids(rows, label)


def test_stage_links_only_similar_texts_and_finds_most(spark):
    rows = documents()
    label = brute.groups([shingles(t) for _, t in rows], similar)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = Counter((r[0] is None, r[0] or 0) for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect())
    want = low_ids(rows, label)
    assert not want - kept  # no group loses its document
    assert sum((kept - want).values()) <= 0.1 * (len(rows) - sum(want.values()))
    assert simhash.similar(docs.limit(0)).count() == 0


def test_links_are_verified(spark):
    r = random.Random(3)
    words = [f"v{i}" for i in range(300)]
    pairs = []
    for edits in range(1, 25):
        a = r.choices(words, k=200)
        b = list(a)
        for at in r.sample(range(200), edits):
            b[at] = "new"
        pairs.append((a, b))
    rows = [(2 * k + j, " ".join(w)) for k, p in enumerate(pairs) for j, w in enumerate(p)]
    got = {d: c for d, c, *_ in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [similar(shingles(rows[2 * k][1]), shingles(rows[2 * k + 1][1])) for k in range(len(pairs))]
    assert [got[2 * k] == got[2 * k + 1] for k in range(len(pairs))] == linked
    assert 0 < sum(linked) < len(linked)


def test_plan_has_no_switch_by_size():
    """Candidate rows of a fingerprint hardly change from one size to the next, and costs grow evenly."""
    for radius in (simhash.RADIUS, simhash.WORD_RADIUS):
        def at(n):
            both = np.full((64, 64), n / 4) + np.diag(np.full(64, n / 4))
            parts = {m: simhash.group_bits(both, n, m) for m in simhash.PARTITIONS}
            equal = {(m, k): float(n) * n / 2 ** len(p) for m, ps in parts.items() for k, p in enumerate(ps)}
            return simhash.chosen(both, n, parts, equal, radius)

        for n in (1 << 18, 1 << 26):
            before, after = at(n - 1), at(n + 1)
            assert len(before[0]) == len(after[0])
        cost = [at(10**e)[1] / 10**e for e in range(4, 10)]
        assert all(a <= b <= 12 * a for a, b in zip(cost, cost[1:]))


def test_hot_buckets_are_split_and_lose_nothing(spark, monkeypatch):
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, 12, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in r.choice(64, r.integers(0, 6), replace=False)) for _ in range(900)], np.uint64)
    fps = np.unique(base[r.integers(0, 12, 900)] ^ flips).view(np.int64).tolist()
    df = spark.createDataFrame([(f, f, 10) for f in fps], "fp long, node long, size long").repartition(4)
    masks = [m for part in simhash.group_bits(np.eye(64), 1, 4) for m in simhash.masks_of(part, 0)]
    label = brute.groups(fps, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    for hot in (4096, 16):
        monkeypatch.setattr(simhash, "HOT", hot)
        comp = dict(simhash.components(simhash.probe(df, masks, 3)).collect())
        assert len({(comp.get(f, f), k) for f, k in zip(fps, label)}) == len(set(label)) == len({comp.get(f, f) for f in fps})


def test_linked_counts_like_sets():
    r = np.random.default_rng(2)
    base = np.arange(1, 120, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(119) > s], r.integers(200, 260, 8).astype(np.uint64)])) for s in r.random(60) * 0.3]
    want = {(i, j) for j in range(60) for i in range(j) if similar(set(sets[i].tolist()), set(sets[j].tolist()))}
    for columns in (4096, 16):
        assert set(zip(*(x.tolist() for x in simhash.linked(sets, columns)))) == want and want
    assert len(simhash.linked([base, base + np.uint64(500)])[0]) == 0


def test_groups_of_many_blocks(spark, monkeypatch):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = Counter(r[0] for r in simhash.keep_one(docs).collect())
    monkeypatch.setattr(simhash, "GROUP", 8)
    monkeypatch.setattr(simhash, "SMALL", 0)
    assert Counter(r[0] for r in simhash.keep_one(docs).collect()) == want


def test_a_hot_bucket_is_streamed():
    import pyarrow as pa

    def batches():
        for k in range(60):
            n = np.arange(10_000, dtype=np.int64) + 10_000 * k
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(10_000, 1 << 40), n, n, 0 * n)], names=["m", "fp", "node", "size"])

    out = list(simhash._buckets(3, 2, simhash.HOT)(batches()))
    assert sum(b.num_rows for b in out) == 600_000 and max(b.num_rows for b in out) <= 210_000
