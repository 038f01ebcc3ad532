"""The registered queries and the pipeline over folders of odd tables and of empty ones."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import mixing, quality
from quarry.llm.queries import ORACLE_SQL, QUERIES
from tests.llm import brute, fixtures
from tests.llm.test_operators import PAGE
from tests.llm.test_similar import shingles, similar

COLUMNS = {
    1: {"page_id", "url", "text", "n_chars"},
    2: {"doc_id", "held_out", "score", "predicted"},
    3: {"vec_id", "n_links", "component_id", "kept"},
    4: {"doc_id", "size", "source_size", "target", "taken"},
    5: {"doc_id", "n_words", "n_removed", "kept_sha256"},
    6: {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    7: {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    8: {"page_id", "host", "path", "rule", "verdict"},
    9: {"doc_id", "fingerprint", "component_id"},
    10: {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
}


def write(spark, folder, empty):
    docs = fixtures.table(spark).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = fixtures.documents()
    labels = spark.createDataFrame([(r[0], int(k % 3 > 0), int(k % 4 == 0)) for k, r in enumerate(rows[:120])] + [(None, 1, 1), (3, None, None), (3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    pages = spark.createDataFrame([(k, f"http://h{k % 3}.example.com/en/{k}", PAGE) for k in range(9)] + [(None, None, None), (9, "", ""), (9, "", ""), (10, "x://é.ORG?q", "<p" * 99)], "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("n", F.lit(1))
    vectors = spark.createDataFrame([(k, [float(k % 5), 1.0, 0.0]) for k in range(20)] + [(None, [1.0, 1.0, 0.0]), (50, None), (50, [0.0, 0.0, 0.0]), (51, [float("nan"), 1.0, 1.0])], "vec_id long, embedding array<float>").withColumn("n", F.lit("x"))
    for name, df in (("documents", docs), ("labels", labels), ("pages", pages), ("embeddings", vectors)):
        (df.limit(0) if empty else df).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd"), False)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), True)


@pytest.mark.parametrize("name", sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])))
def test_query_gives_every_row(spark, odd, empty, name):
    n = int(name[2:].split("_")[0])
    table = {1: "pages", 8: "pages", 3: "embeddings"}.get(n, "documents")
    out = QUERIES[name](spark, odd)
    assert set(out.columns) == COLUMNS[n]
    if n == 10:
        assert out.select("doc_id").distinct().count() == spark.read.parquet(f"{odd}/documents.parquet").select("doc_id").distinct().count()
    else:
        assert out.count() == spark.read.parquet(f"{odd}/{table}.parquet").count()
    none = QUERIES[name](spark, empty)
    assert set(none.columns) == COLUMNS[n] and none.count() == 0


def test_oracles_name_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_pipeline_stages(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns = docs.columns
    outs = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, outs[-1], odd).write.mode("overwrite").parquet(f"{odd}/stage{k}")
        outs.append(spark.read.parquet(f"{odd}/stage{k}"))
    assert all(o.columns == columns for o in outs[:-1])
    got = [[(r["doc_id"], r["text"]) for r in o.select("doc_id", "text").collect()] for o in outs[:-1]]

    rules = quality.fit(docs, spark.read.parquet(f"{odd}/labels.parquet"))
    kept = Counter((r[0], r[1]) for r in quality.judge(docs, rules).where("kept").select("row.doc_id", "row.text").collect())
    assert Counter(got[1]) == kept
    assert all((s := brute.stats(t))[0] >= 50 and 100 * s[4] <= 50 * s[0] for _, t in got[1])

    label = brute.groups([shingles(t) for _, t in got[1]], similar)
    low = {}
    for (d, _), k in zip(got[1], label):
        low[k] = min(low.get(k, (True, 0)), (d is None, d or 0))
    assert Counter((d is None, d or 0) for d, _ in got[2]) == Counter(low.values())

    cut = brute.substring(got[2])
    want = Counter((d, n - gone) for d, n, gone, _ in cut)
    assert Counter((d, len(brute.words(t))) for d, t in got[3]) == want
    gone_of = {d: gone for d, _, gone, _ in cut}
    before = dict(got[2])
    assert all(t == before[d] for d, t in got[3] if not gone_of[d])

    size = {}
    for r in outs[3].select("source", mixing.word_count(F.col("text")).alias("n")).collect():
        size[r["source"]] = size.get(r["source"], 0) + r["n"]
    taken = {r["source"]: r["n"] for r in outs[4].groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert all(abs(taken.get(s, 0) - t) <= 64 for s, t in brute.targets(size).items())

    tokens = outs[5].agg(F.sum("length")).first()[0]
    assert tokens == outs[5].select("doc_id", "doc_tokens", "start", "length").where("start + length = doc_tokens").agg(F.sum("doc_tokens")).first()[0]


def test_pipeline_runs_on_nothing(spark, empty):
    out = corpus_pipeline.run(spark, empty)
    assert set(out.columns) == COLUMNS[10] and out.count() == 0
