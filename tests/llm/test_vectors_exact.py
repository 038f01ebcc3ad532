"""Links that the windows of operator 3's passes miss."""

from __future__ import annotations

import numpy as np

from quarry.llm import vectors
from tests.llm import brute


def test_sparse_links_of_a_dense_group_are_exact(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SPAN", 300, raising=False)
    r = np.random.default_rng(8)
    c = r.standard_normal(64)
    x = c / np.linalg.norm(c) + 0.4 * r.standard_normal((1000, 64)) / 8
    x[900:] = x[:100] + 0.2 * r.standard_normal((100, 64)) / 8
    x = x.astype(np.float32)
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = (y @ y.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    assert near.any() and 0.84 < np.median(y @ y.T) < 0.9
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted(vectors.near_duplicates(df, passes=1, window=1, exact=True).collect())
    label = brute.groups(list(range(len(x))), lambda a, b: bool(near[a, b]))
    low = {}
    for k, g in enumerate(label):
        low.setdefault(g, k)
    assert [(k, n, g) for k, n, g, _ in got] == [(k, int(near[k].sum()), low[g]) for k, g in enumerate(label)]


def test_passes_grow_with_the_rows():
    got = [vectors.passes_for(10**e) for e in range(1, 11)]
    assert got == sorted(got) and got[-1] < 20 * got[3]
    for n in (1 << 16, 1 << 24):
        assert abs(vectors.passes_for(n - 1) - vectors.passes_for(n + 1)) <= 1


def test_bounds_of_tasks_lose_nothing(spark):
    """Pairs that are next to each other in the one pass are found however its rows are dealt out."""
    r = np.random.default_rng(9)
    x = r.standard_normal((400, 8))
    x[200:] = x[:200] + 0.01 * r.standard_normal((200, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    outs = []
    try:
        for parts in ("1", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            outs.append(sorted(map(tuple, vectors.near_duplicates(df, passes=2, window=4).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert outs[0] == outs[1]


def test_groups_alone_find_what_lies_in_a_dense_crowd(spark):
    r = np.random.default_rng(8)
    c = r.standard_normal(64)
    x = r.standard_normal((1200, 64))
    x[:600] = c / np.linalg.norm(c) + 0.4 * r.standard_normal((600, 64)) / 8
    x[500:600] = x[:100] + 0.2 * r.standard_normal((100, 64)) / 8
    x[1100:] = x[1000:1100] + 0.2 * r.standard_normal((100, 64))
    y = x / np.linalg.norm(x, axis=1)[:, None]
    near = (y @ y.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {k: n for k, n, *_ in vectors.near_duplicates(df).collect()}
    assert near[:600, :600].sum() > 50 and near[1000:].sum() > 50
    assert all(got[k] == near[k].sum() for k in range(600))
    full = {k: n for k, n, *_ in vectors.near_duplicates(df, exact=True).collect()}
    assert all(full[k] == near[k].sum() for k in range(len(x)))
    assert sum(got.values()) >= 0.98 * near.sum() and all(got[k] <= near[k].sum() for k in range(len(x)))


def test_passes_follow_what_rows_share():
    """More shared bits ask for more passes, and never for fewer than are given."""
    assert vectors.passes_by({}, 9) == 9 and vectors.passes_by({3: 100}, 30) == 30
    got = [vectors.passes_by({3: 10, depth: 1000}, 20) for depth in (5, 10, 20, 30, 40)]
    assert got == sorted(got) and got[0] == 20 and got[-1] > 10 * got[1]
    for depth, p in zip((5, 10, 20, 30, 40), got):
        met = (1 - np.arccos(0.95) / np.pi) ** depth
        missed = 1000 * (1 - met) ** p + 10 * (1 - (1 - np.arccos(0.95) / np.pi) ** 3) ** p
        assert missed <= 1.01 and (p == 20 or missed > 0.9)


def test_a_crowd_below_near_gets_further_passes(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = r.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = x[0]
    x[:2000] = np.sqrt(0.6) * c + np.sqrt(0.4) * x[:2000]
    e = r.standard_normal((200, 64))
    x[1800:2000] = x[:200] + 0.3 * e / np.linalg.norm(e, axis=1)[:, None]
    y = x / np.linalg.norm(x, axis=1)[:, None]
    near = (y @ y.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    asked, plain = [], vectors.passes_by
    monkeypatch.setattr(vectors, "passes_by", lambda d, p, **k: asked.append((d, p, plain(d, p, **k))) or asked[-1][2])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {k: n for k, n, *_ in vectors.near_duplicates(df, window=4).collect()}
    shared, planned, done = asked[0]
    assert done > planned and 0 < sum(shared.values()) <= planned * len(x)
    assert near.any() and sum(got.values()) >= 0.99 * near.sum()
    assert all(got[k] <= near[k].sum() for k in range(len(x)))
