"""Lexical ranking inside tasks against the joined form and a plain count."""

from __future__ import annotations

import random

import pytest

from quarry.operators import postings, retrieval


def tables(spark, n=300, seed=3):
    r = random.Random(seed)
    words = ["the", "common", "rare", "alpha", "beta", "gamma", "delta"] + [f"w{k}" for k in range(40)]
    text = lambda m: " ".join(["the"] + r.choices(words, k=r.randrange(m)))
    docs = [(f"d{k:03}", text(12)) for k in range(n)] + [("long", "the rare " * 5000), ("empty", ""), ("null", None)]
    asked = [(k, text(8)) for k in range(25)] + [(90, ""), (91, None), (92, "Unknown1 words2")]
    return asked, docs, spark.createDataFrame(asked, "qid long, question string"), spark.createDataFrame(docs, "id string, text string").repartition(5)


@pytest.mark.parametrize("cells,pending", [(1 << 17, 1 << 20), (30, 40)])
def test_both_forms_agree(spark, monkeypatch, cells, pending):
    monkeypatch.setattr(postings, "CELLS", cells)
    monkeypatch.setattr(postings, "PENDING", pending)
    asked, docs, q, d = tables(spark)
    inside = [sorted(f(q, d, 4).collect()) for f in (retrieval.lexical_top_k, retrieval.bm25_top_k)]
    monkeypatch.setattr(postings, "fits", lambda *_: False)
    joined = [sorted(f(q, d, 4).collect()) for f in (retrieval.lexical_top_k, retrieval.bm25_top_k)]
    assert inside[0] == joined[0] and len(inside[1]) == len(joined[1])
    for a, b in zip(inside[1], joined[1]):
        assert (a["qid"], a["rank"]) == (b["qid"], b["rank"]) and abs(a["score"] - b["score"]) < 2e-6
    of = lambda s: {w for w in (s or "").lower().split() if len(w) >= 3}
    want = []
    for i, s in asked:
        n = sorted((-len(of(s) & of(t)), k) for k, t in docs if of(s) & of(t))[:4]
        want += [(i, k, -m, at) for at, (m, k) in enumerate(n, 1)]
    assert [tuple(r) for r in inside[0]] == sorted(want)


def test_empty_sides(spark):
    _, _, q, d = tables(spark, 20)
    for f in (retrieval.lexical_top_k, retrieval.bm25_top_k):
        assert f(q.limit(0), d).count() == 0 and f(q, d.limit(0)).count() == 0
        assert f(q.where("qid = 90"), d).count() == 0


def test_pieces_are_small_and_whole():
    import pyarrow as pa

    lists = [["w"] * n for n in (3, 0, 4, 9, 1, 1, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(lists, pa.list_(pa.string()))], names=["id", "w"])
    for whole in (batch, batch.slice(2, 4), batch.slice(0, 0)):
        got = list(postings.pieces(whole, 1, 5))
        assert [r for p in got for r in p.to_pylist()] == whole.to_pylist()
        assert all(p.num_rows == 1 or len(p.column(1).flatten()) <= 5 for p in got)
