"""Each operator against its plain version, on a small table of edge cases and on its empty table."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing, packing, quality, sharding, simhash, substring, toxicity, urls, vectors
from quarry.llm.html import extract, main_text
from tests.llm import brute, fixtures


@pytest.fixture(scope="module")
def docs(spark):
    return fixtures.table(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def rows():
    return fixtures.documents()


def test_substring_matches_brute_force(docs, rows):
    for block_rows in (500, 20):
        d = substring.dedup_substrings(docs, block_rows=block_rows)
        got = d.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
        assert Counter(map(tuple, got)) == Counter(brute.substring([(a, b) for a, b, *_ in rows]))
    assert d.select("row.*").columns == docs.columns
    for r in d.select("row.text", "kept_text", "spans").collect():
        w = brute.words(r["text"])
        for s in reversed(r["spans"]):
            assert s["end"] - s["first"] >= 13
            del w[s["first"] : s["end"]]
        assert " ".join(w) == r["kept_text"]


def test_substring_can_keep_white_space(docs):
    d = substring.dedup_substrings(docs, keep_space=True).select("row.text", "kept_text", "n_removed", "spans")
    seen = 0
    for r in d.collect():
        pieces = re.findall(r"[^ \t\n\v\f\r]+[ \t\n\v\f\r]*", r["text"] or "")
        lead = (r["text"] or "")[: len(r["text"] or "") - sum(map(len, pieces))]
        for s in reversed(r["spans"]):
            del pieces[s["first"] : s["end"]]
        assert r["kept_text"] == lead + "".join(pieces)
        seen += r["n_removed"] > 0 and "\n" in r["kept_text"]
    assert seen


def test_substring_groups_stream_hot_anchors():
    r = np.random.default_rng(8)

    def plain(rows, kind):
        low, of = {}, defaultdict(set)
        for a, s, _, lo, _ in rows:
            low[a, s] = min(low.get((a, s), lo), lo)
            of[a].add(s)
        more = {a: kind == 0 and len(x) > 1 for a, x in of.items()}
        return sorted((b, kind, a, s, low[a, s], more[a]) for a, s, b, lo, hi in rows if hi > low[a, s] or (more[a] and lo == low[a, s]))

    def fed(rows, kind, size):
        cols = [np.array(c, np.int64) for c in zip(*rows)]
        for k in range(0, len(rows), size):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + size]) for c in cols], names=["a", "s", "block", "lo", "hi"])

    for _ in range(200):
        n = int(r.integers(1, 40))
        rows = sorted((int(a), int(s), int(b), int(lo), int(lo + up)) for a, s, b, lo, up in zip(r.integers(0, 4, n), r.integers(0, 3, n), r.permutation(n), r.integers(0, 4, n), r.integers(0, 2, n)))
        rows.sort(key=lambda x: (x[0], x[1], x[3]))
        for kind in (0, 1):
            for size in (1, 3, 100):
                got = [tuple(x.values()) for b in substring._groups(kind)(fed(rows, kind, size)) for x in b.to_pylist()]
                want = plain(rows, kind)
                loose = lambda rs: sorted(x[:5] for x in rs)
                assert loose(got) == loose(want)
                # what a block asks of `more` is asked of the rows that hold the least document
                least = {(a, s, b) for a, s, b, lo, _ in rows if lo == min(x[3] for x in rows if x[:2] == (a, s))}
                assert sorted(x for x in got if (x[2], x[3], x[0]) in least) == sorted(x for x in want if (x[2], x[3], x[0]) in least)
    one = ((0, k, k, k, k) for k in range(500_000))
    out = list(substring._groups(0)(fed(list(one), 0, 10_000)))
    assert sum(b.num_rows for b in out) == 500_000 and max(b.num_rows for b in out) <= 10_000


def test_substring_empty(spark, docs):
    assert substring.dedup_substrings(docs.limit(0)).count() == 0


def test_quality_statistics(docs, rows):
    judged = quality.judge(docs, quality.DecisionList([[("upper_share", ">", 0.9)]]))
    got = judged.select("row.doc_id", *(F.col("s")[n] for n in quality.STATS[:5]), "base_failed", "kept").collect()
    want = []
    for d, text, *_ in rows:
        s = brute.stats(text)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        want.append((d, *s, failed, not failed))
    assert Counter(map(tuple, got)) == Counter(want)


def test_quality_learns_a_list():
    r = np.random.default_rng(1)
    x = r.random((900, 3))
    bad = (x[:, 0] > 0.8) | ((x[:, 1] < 0.2) & (x[:, 2] > 0.5))
    rules = quality.learn(x, bad, ["a", "b", "c"])
    hit = np.zeros(900, bool)
    for rule in rules.rules:
        hit |= quality._hits(x, ["a", "b", "c"], rule)
    assert (hit == bad).mean() > 0.97
    assert quality.learn(x, np.zeros(900, bool), ["a", "b", "c"]).rules == []


def test_quality_fit_on_tables(spark, docs):
    labels = spark.createDataFrame([(i * 3, i % 2, 0) for i in range(100)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rules = quality.fit(docs, labels)
    assert quality.judge(docs, rules).count() == docs.count()
    assert quality.fit(docs.limit(0), labels).rules == []


def test_simhash_matches_brute_force(docs, rows):
    got = simhash.near_duplicates(docs).select("doc_id", "fp", "component_id").collect()
    fps = [brute.fingerprint(t) for _, t, *_ in rows]
    label = brute.groups(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    low = defaultdict(lambda: None)
    for (d, *_), k in zip(rows, label):
        if d is not None:
            low[k] = d if low[k] is None else min(low[k], d)
    want = Counter((d, f, low[k]) for (d, *_), f, k in zip(rows, fps, label))
    assert Counter((d, f & (2**64 - 1), c) for d, f, c in got) == want
    kept = simhash.one_of_each(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns and kept.count() == len(set(label))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_wide_radius(docs, rows):
    fps = [brute.fingerprint(t) for _, t, *_ in rows]
    label = brute.groups(fps, lambda a, b: (a ^ b).bit_count() <= 7)
    got = simhash.near_duplicates(docs, radius=7)
    assert got.select("component").distinct().count() == len(set(label)) == simhash.one_of_each(docs, got).count()


def test_simhash_thresholds_lose_no_link(spark):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 300, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(i) for i in r.choice(64, r.integers(0, 5), replace=False)) for b in np.repeat(base, 8)]
    fps = sorted(set(near))
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f, f, 0) for f in signed], "fp long, node long, size long").repartition(4)
    parts = [list(range(0, 21)), list(range(21, 42)), list(range(42, 64))]
    for thresholds in ([1, 0, 0], [2, 0, -1], [0, -1, 2], [3, -1, -1]):
        masks = [m for p, t in zip(parts, thresholds) for m in simhash.masks_of(p, t)]
        edges = simhash.probe(df, masks, 3)
        comp = dict(simhash.components(edges).collect())
        label = brute.groups(fps, lambda a, b: (a ^ b).bit_count() <= 3)
        want, got = defaultdict(set), defaultdict(set)
        for f, s, k in zip(fps, signed, label):
            want[k].add(f)
            got[comp.get(s, s)].add(f)
        assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_allocation_is_the_cheapest():
    assert simhash.allocate([[0, 1, 50, 90, 99]] * 4, 4) == [0, 0, 0, 0]
    assert sorted(simhash.allocate([[0, 1, 2, 90, 99], [0, 80, 90, 95, 99], [0, 1, 2, 90, 99], [0, 3, 90, 99, 99]], 4)) == [-1, -1, 1, 1]


def test_sharding_is_jump_hash(docs, rows):
    got = sharding.shard(docs, bucket_rows=3).select("row.doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    want = Counter((d, len((t or "").encode()) + 8, brute.crc(t), "key", brute.jump(d or 0, 24), brute.jump(d or 0, 25)) for d, t, *_ in rows)
    assert Counter((g[0], g[1], g[2], g[3], g[4], g[6]) for g in got) == want
    slots = defaultdict(list)
    for g in got:
        slots[g[4]].append(g[5])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(docs.limit(0)).count() == 0


def test_jump_of_large_keys(spark):
    keys = [-1, 2**63 - 1, -(2**63), 12345678901234567, 7]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select(sharding.jump(F.col("k"), 24).alias("t")).select("t.*").collect()
    assert [tuple(g) for g in got] == [(brute.jump(k, 24), brute.jump(k, 25)) for k in keys]


def test_mixing_hits_targets(docs, rows):
    size = defaultdict(int)
    for _, t, _, s in rows:
        size[s] += len(brute.words(t))
    for how in ({}, {"shard_words": 500, "block": 8}):
        slim = mixing._sized(docs)
        got = mixing.allot(slim, slim, **how).select("id", "source", "size", "source_size", "target", "taken").collect()
        want = brute.targets(size)
        taken = defaultdict(int)
        for g in got:
            assert g["source_size"] == size[g["source"]] and math.isclose(g["target"], want[g["source"]])
            assert 0 <= g["taken"] <= 3 * g["size"]
            taken[g["source"]] += g["taken"]
        for s in size:
            assert abs(taken[s] - want[s]) <= 32 + 8 * (size[s] // 500 + 1), s
    assert Counter(g["id"] for g in got) == Counter(r[0] for r in rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == mixing.allot(slim, slim).agg(F.sum("taken")).first()[0]
    assert mixing.allot(slim.limit(0), slim.limit(0)).count() == 0


def test_apportionment_is_sainte_lague(spark):
    votes = [(1, 34.0, 9), (2, 17.5, 100), (3, 17.5, 2), (4, 3.0, 50), (5, 0.0, 0), (6, 28.0, 100)]
    df = spark.createDataFrame([(1, k, v, c, n) for n in (0, 1, 7, 20, 500) for k, v, c in votes], "g int, k int, v double, c long, n long").withColumn("g", F.col("n"))
    got = {(r["n"], r["k"]): r["quota"] for r in mixing.apportion(df, ["g"], "k", "v", "c", "n").collect()}
    for n in (0, 1, 7, 20, 500):
        seats = sorted(((-v / (2 * i + 1), k) for k, v, c in votes for i in range(c)))[:n]
        want = Counter(k for _, k in seats)
        assert {k: got[n, k] for k, *_ in votes} == {k: want[k] for k, *_ in votes}


def _tokens(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*c.ids, 2] for c in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_packing_round_trip(docs, rows):
    import public_tokenizers

    odd = [(5000, "a b c　d <|endoftext|> x <|start of> don't É É ﬁ 12345 ΑΣ Σ z", "en", "a")]
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    every = rows + odd
    got = packing.pack(fixtures.table(spark, every).coalesce(2), public_tokenizers.path("word_bpe_49k.json"), hold=9000).collect()
    ids = defaultdict(list)
    for (d, t, *_), x in zip(every, _tokens([t for _, t, *_ in every])):
        ids[d].append(x)
    pieces, seqs = defaultdict(list), defaultdict(list)
    for p in got:
        pieces[p["doc_id"]].append(p)
        seqs[p["sequence_id"]].append(p)
        assert any(p["doc_tokens"] == len(x) and zlib.crc32(np.array(x[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"] for x in ids[p["doc_id"]])
    for d, copies in ids.items():
        assert sum(p["length"] for p in pieces[d]) == sum(map(len, copies))
        if len(copies) == 1:
            at = sorted((p["start"], p["length"]) for p in pieces[d])
            assert [s for s, _ in at] == [sum(n for _, n in at[:k]) for k in range(len(at))]
    padding = total = 0
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.03 * total
    assert packing.pack(fixtures.table(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_cuts_are_optimal():
    r = np.random.default_rng(2)
    for _ in range(20):
        at = np.unique(np.concatenate([[0], r.integers(1, 300, 40), np.arange(0, 300, 16), [300]]))
        pen = r.choice([0.0, 2.0, 9.0], len(at))
        cuts = packing.best_cuts(at, pen, 64, 3)
        cost = lambda a, b: 0 if (n := int(at[b] - at[a])) & (n - 1) == 0 else 64 - n
        f = [0.0] + [math.inf] * (len(at) - 1)
        for b in range(1, len(at)):
            f[b] = min(f[a] + cost(a, b) + pen[b] + 3 for a in range(b) if at[b] - at[a] <= 64)
        got = sum(cost(a, b) + pen[b] + 3 for a, b in zip(cuts, cuts[1:]))
        assert math.isclose(got, f[-1])


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>A</a></li></ul></nav><div class="ad">Buy the thing now and then.</div>
<article><h1>The &amp; title</h1><p><b>Some  text &lt;here&gt;<br>more<p>Short.</p><div class="comments"><p>I like it, and the rest of it.</p></div></article>
<aside>Side</aside><footer>&copy; foot</footer></body></html>"""


def test_html_article():
    assert extract(PAGE) == "The & title\nSome text <here> more\nShort."
    assert extract(None) == extract("") == extract("<p") == ""
    assert extract("<div><p>" + "the cat and the dog are in it with us all of the time " * 2 + "</p><p>Yes.</p></div><ul><li><a href=x>Home page</a></li></ul>").endswith("time\nYes.")
    assert extract("<!-- unclosed <p>text</p>") == ""
    assert extract('<article><p class="x>a</p><p>b</p></article>') is not None


def test_html_column(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (1, PAGE)], "page_id long, html string")
    assert [r[0] for r in df.select(main_text("html")).collect()] == [extract(PAGE), "", extract(PAGE)]


def test_urls(spark):
    want = {
        "http://A.COM/x": ("a.com", "/x", "com/", "allow"),
        "http://a.com": ("a.com", "", None, "allow"),
        "https://Sub.Example.com/en/1?q#f": ("sub.example.com", "/en/1", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://x.net/fr/a": ("x.net", "/fr/a", "net/fr/", "block"),
        "http://x.net?/fr/": ("x.net", "", None, "allow"),
        "nothing": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://bad.org/1": ("bad.org", "/1", None, "block"),
        "http://good.org/1": ("good.org", "/1", None, "allow"),
    }
    pages = [(k, u) for k, u in enumerate(want)] + [(100 + k, "http://bad.org/" if k % 2 else "http://good.org/") for k in range(200)]
    labels = [(100 + k, 0 if k % 2 else 1, 0) for k in range(200)] + [(None, 1, 0), (0, None, None)]
    df, lb = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit(1)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(df, lb).collect()}
    assert {u: got[k] for k, u in enumerate(want)} == want
    assert urls.judge(df, lb.limit(0)).count() == len(pages)
    assert urls.judge(df.limit(0), lb).count() == 0


def test_vectors_match_brute_force(spark):
    r = np.random.default_rng(4)
    rows = []
    for k in range(60):
        c = r.standard_normal(16)
        for _ in range(int(r.choice([1, 1, 2, 40]))):
            rows.append((len(rows), (c + 0.05 * r.standard_normal(16)).astype(np.float32).tolist()))
    rows += [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] + [1.0] * 15), (9005, rows[0][1]), (9005, rows[0][1]), (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (9008, []), (9009, [float("inf")] * 16), (9010, [1e-30] * 16), (9011, [1e30] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1))
    got = Counter(map(tuple, vectors.near_duplicates(df.repartition(3)).collect()))

    def ok(v):
        return v and None not in v and np.isfinite(v).all() and any(v)

    def linked(a, b):
        a, b = a[1], b[1]
        if not ok(a) or not ok(b) or len(a) != len(b):
            return False
        x, y = (np.array(np.float32(v), float) / np.abs(np.float32(v)).max() for v in (a, b))
        return x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95

    n = [sum(linked(a, b) for b in rows if b is not a) for a in rows]
    label = brute.groups(rows, linked)
    low = {}
    for (i, _), k in zip(rows, label):
        low[k] = min(low.get(k, i), i)
    want = Counter((i, c, low[k], i == low[k]) for (i, _), c, k in zip(rows, n, label))
    assert got == want
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_toxicity_learns(spark, docs):
    base = [t for _, t, *_ in fixtures.documents(400, 9) if t and len(t) < 5000]
    rows = [(i, t + (" grobian schurke" if i % 3 == 0 else ""), int(i % 3 == 0)) for i, t in enumerate(base)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x"), (99999, None), (99998, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels)
    out = d.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h"), toxicity.score(F.col("text"), model).alias("p")).collect()
    truth = {i: y for i, _, y in rows}
    held = [(r["p"] >= 0.5) == truth[r["doc_id"]] for r in out if r["h"] and r["doc_id"] in truth]
    assert np.mean(held) > 0.95 and all(0 <= r["p"] <= 1 for r in out)
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    nothing = toxicity.fit(d.limit(0), labels)
    assert d.select(toxicity.score(F.col("text"), nothing)).count() == d.count()


def test_toxicity_scores_match_a_plain_version():
    import zstandard

    r = np.random.default_rng(6)
    vocabulary = ["the", "of", "and", "house", "river", "Straße", "été", "x" * 70_000, "word-mark!", "a"]
    texts = [" ".join(r.choice(vocabulary, r.integers(0, 40))) + t + str(r.choice(["", "vilewretch", "Vilewretch.", "scumword vilewretch"])) for t in (" ", "\n", "\t ", "") for _ in range(80)]
    label = [int("wretch" in t.lower()) for t in texts]
    model = toxicity.train(texts, label)

    def saved(word):
        out = []
        for content in (model.ordinary, model.toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(model.level, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS, min_match=4)
            out.append(len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(toxicity.LEAD + b" " + word + b" " + toxicity.TAIL)))
        return out[0] - out[1]

    known = {}
    want = []
    for t in [*texts, None, ""]:
        got = sorted((known.setdefault(w, saved(w.translate(brute.LOWER).encode())) for w in brute.words(t)), reverse=True)
        x = [1.0, min(got[0], 9) if got else 0, min(max(got[1], 0), 9) if len(got) > 1 else 0, math.log1p(sum(g >= model.threshold for g in got)), math.log1p(len(got))]
        want.append(1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights)))))
    x = toxicity.features_of(pa.array([*texts, None, ""]), toxicity.Savings(model), model.threshold)
    assert np.allclose(1 / (1 + np.exp(-x @ np.array(model.weights))), want)
    assert np.mean((np.array(want[:-2]) >= 0.5) == np.array(label)) > 0.95
