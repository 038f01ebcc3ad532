"""Chunks scored in the tasks against the joins that score every candidate."""

import random

import pytest

from quarry.operators import retrieval, scoring

WORDS = "bank charge slev code pays bearer agent cb debtor iban nothing here".split()


def graph_of(spark, seed=1, n=120):
    r = random.Random(seed)
    say = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    chunks = [(i, r.choice([None, *range(1, 40)]), r.choice([None, "", say(3), say(9), say(30)])) for i in range(n)]
    entities = [("e0", "Charge Bearer", "T", ["cb"]), ("e1", "Bank", "T", []), ("e2", "SLEV", "T", None), ("e3", "Debtor", "T", ["bank", "agent"])]
    c = spark.createDataFrame(chunks, "id long, page long, text string").repartition(5)
    e = spark.createDataFrame(entities, "id string, name string, type string, aliases array<string>")
    q = spark.createDataFrame([(1, "What does the bank charge"), (2, "slev code of an agent"), (3, "?"), (4, "nothing bearer")], "qid int, question string")
    kw = spark.createDataFrame([(1, "bank"), (1, "charge bearer"), (2, "slev"), (4, "code"), (9, "bank")], "qid int, low string")
    seed = spark.createDataFrame([(1, "e0"), (1, "e1"), (1, "e3"), (2, "e2"), (4, "e1"), (9, "e1")], "qid int, id string")
    anchors = spark.createDataFrame([(1, 4), (1, 5), (3, 11), (2, 4), (9, 3)], "qid int, page long")
    return c, e, q, kw, seed, anchors


@pytest.mark.parametrize(("cells", "pending", "rows"), [(1 << 17, 1 << 18, 1024), (4, 5, 3)])
def test_best_chunks_are_those_of_the_joins(spark, monkeypatch, cells, pending, rows):
    c, e, q, kw, seed, anchors = graph_of(spark)
    all_ = retrieval.score_chunks(q, kw, seed, anchors, retrieval.mentions(e, c), c)
    want = {tuple(r) for r in retrieval.spread(all_, 2, 6).select("qid", "id", "page", "score", "rank").collect()}
    assert all_.count() > 100
    for name, value in (("CELLS", cells), ("PENDING", pending), ("ROWS", rows)):
        monkeypatch.setattr(scoring, name, value)
    best = retrieval.best_chunks(q, kw, seed, anchors, e, c, 2, 6)
    assert {tuple(r) for r in retrieval.spread(best, 2, 6).select("qid", "id", "page", "score", "rank").collect()} == want
    assert best.count() <= 4 * 6 * c.rdd.getNumPartitions()  # and not one row a candidate
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan.split("MapInArrow")[0]
    monkeypatch.setattr(scoring, "few", lambda *_: None)
    best = retrieval.best_chunks(q, kw, seed, anchors, e, c, 2, 6)
    assert {tuple(r) for r in retrieval.spread(best, 2, 6).select("qid", "id", "page", "score", "rank").collect()} == want


def test_mentions_without_short_names(spark):
    c, e, *_ = graph_of(spark)
    long_ = e.where("id = 'e3'")
    plan = retrieval.mentions(long_.selectExpr("id", "name", "array() aliases"), c, once=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Aggregate [id" not in plan.split("Join")[0]
    assert {r["id"] for r in retrieval.mentions(e, c, once=False).collect()} == {"e0", "e1", "e2", "e3"}


def test_chunk_context_by_links_arrays_and_joins(spark, monkeypatch):
    c, e, q, *_ = graph_of(spark)
    c = c.selectExpr("id as chunk_id", "text", "page as page_start", "page + 1 as page_end")
    e = e.selectExpr("id", "name", "name as canonical_name", "coalesce(aliases, array()) as aliases", "'' as description", "1L as frequency")
    links = retrieval.mentions(e, c.selectExpr("chunk_id as id", "text"), once=False).withColumnRenamed("chunk", "chunk_id")
    arrays = e.join(links.groupBy("id").agg({"chunk_id": "collect_set"}).toDF("id", "source_chunks"), "id", "left")
    got = [set(map(tuple, retrieval.chunk_context(q, e, c, links=links.union(links)).collect())), set(map(tuple, retrieval.chunk_context(q, arrays, c).collect()))]
    monkeypatch.setattr(scoring, "few", lambda *_: None)
    want = set(map(tuple, retrieval.chunk_context(q, arrays, c).collect()))
    assert len(want) >= 6 and got == [want, want]
