"""Chunking, merging, graphs, retrieval and vectors on hand-made cases, many against plain versions."""

from __future__ import annotations

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import chunking as C
from quarry.operators import evaluation, graph, keywords, merging, retrieval, vector
from quarry.operators.components import component_sizes, component_summary, connected
from quarry.operators.contains import contains_pairs


# --- chunking

def test_sections_drop_near_headings_and_preamble():
    text = "preamble that is lost\n1. First heading\n" + "a" * 60 + "\n1.1 Too\n2 near\n" + "b" * 80 + "\nSECTION THREE HERE\nshort"
    found = C.sections(text)
    assert found[0][1] == "1. First heading"
    assert all(b[0] - a[0] > 50 for a, b in zip(found, found[1:]))
    assert C.sections(text, keep_preamble=True)[0][2].startswith("preamble")
    assert C.sections("no heading here") == []


def test_page_lookup():
    text = "[PAGE 3]\nabc\n[PAGE 4]\ndef"
    marks = C.page_marks(text)
    assert marks == [(0, 3), (13, 4)] and [C.page_at(i, marks) for i in (0, 12, 13, 20)] == [3, 3, 4, 4]
    assert C.pages_of(5, 12, marks) == (3, 4) and C.page_at(4, []) == 1


def test_long_section_split_and_overlap():
    paras = ["p" * 40, "One sentence. " * 5, "w" * 150, "tail"]
    parts = C.split_section("\n\n".join(paras), 60, 0)
    assert max(map(len, parts)) == 150 and "".join("".join(parts).split()) == "".join("".join(paras).split())
    led = C.split_section("\n\n".join(paras), 60, 10)
    assert led[1] == parts[0][-10:] + "\n" + parts[1]


def test_recursive_split_loses_nothing():
    r = random.Random(1)
    for _ in range(50):
        text = "".join(r.choice(["ab", "c. ", "\n", "\n\n", " ", "longword"]) for _ in range(200))
        parts = C.split_recursive(text, 30)
        assert all(len(p) <= 30 for p in parts)
        keep = lambda s: "".join(s.replace(". ", "").split())
        assert keep("".join(p.replace(".", "") for p in parts)) == keep(text.replace(".", ""))


def test_section_batches(spark):
    body = lambda n: "word " * n
    text = "[PAGE 1]\n1. Intro part\n" + body(30) + "\n[PAGE 2]\n2. Second part\n" + body(30) + "\n3. Large part\n" + "Word is here. " * 300 + "\n4. Tiny\nx"
    got = C.by_sections(text, 1000, 50)
    assert got[0].title == "1. Intro part / 2. Second part" and (got[0].page_start, got[0].page_end) == (1, 2)
    assert all(c.title == "3. Large part" for c in got[1:]) and len(got) > 4
    df = spark.createDataFrame([(1, text), (2, None), (3, "  "), (4, "plain text")], "doc_id long, text string")
    rows = C.chunk(df, "unknown", 1000, 50).orderBy("doc_id", "chunk_id").collect()
    assert [r["text"] for r in rows if r["doc_id"] == 1] == [c.text for c in got] and {r["doc_id"] for r in rows} == {1, 4}
    assert all(r["char_count"] == len(r["text"]) for r in rows)
    chunks = C.chunk(df)
    assert C.differing_chunks(chunks, chunks).count() == 0
    assert C.page_chunks(chunks).count() > 0


# --- merging

ENT = "chunk_id int, canonical_name string, name string, type string, description string, aliases array<string>, attributes map<string,string>, confidence double, evidence string, page_start int, page_end int, ord long"


def raw_entities(spark):
    rows = [
        (0, "ISO 20022", "iso", "Scheme", "aa", [" x ", ""], {"k": "1", "j": "0"}, 0.4, "first line", 1, 2, 0),
        (1, "ISO 20022", None, "Standard", "bb", ["y"], {"k": "2"}, None, "line", 2, 3, 1),
        (2, "Bank", "Bank", None, None, None, None, 0.9, None, 0, 0, 2),
        (-1, "http://x", None, None, None, None, None, None, None, 1, 1, 3),
        (2, "bank", "Bank2", "Concept", "longer", ["b"], None, 0.1, "other", 4, 4, 4),
    ]
    return spark.createDataFrame(rows, ENT)


def test_entities_are_validated_and_merged(spark):
    e = merging.entities_of(raw_entities(spark))
    m = {r["id"]: r for r in merging.merge_entities(e).collect()}
    iso = m["iso-20022-standard"]
    assert (iso["aliases"], iso["source_pages"], iso["source_chunks"], iso["frequency"], iso["confidence"], iso["description"]) == (["x", "y"], [1, 2, 3], [0, 1], 2, 0.5, "aa")
    assert iso["evidence"] == "first line" and iso["attributes"] == {"k": "2", "j": "0"}
    assert m["bank-concept"]["source_pages"] == [4] and m["bank-concept"]["evidence"] == "other" and m["bank-concept"]["description"] == "longer"
    again = merging.merge_entities(merging.merge_entities(e)).select("id", "frequency", "source_pages").collect()
    assert sorted(map(tuple, again)) == sorted((r["id"], r["frequency"], r["source_pages"]) for r in m.values())


def test_merge_matches_a_plain_fold(spark):
    """Many records of one id, repeated evidence, attributes written again and ties in length."""
    r = random.Random(5)
    ev = [None, "", "a fact", "a fact and more", "more", "other"]
    rows = []
    for k in range(400):
        attrs = {a: str(k) for a in r.sample("pqrs", r.randrange(4))}
        rows.append(("hot" if k % 3 else f"id{k % 7}", f"N{k}", f"n{k}", "T", r.choice([None, "", "x", "yy", "zz"]), r.sample(["a", "b", "c"], r.randrange(4)), attrs, r.random(), r.choice(ev), r.sample(range(9), 2), [k % 11], 1, k))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, canonical_name string, name string, type string, description string, aliases array<string>, attributes map<string,string>, confidence double, evidence string, source_pages array<int>, source_chunks array<int>, frequency long, ord long").repartition(5)
    got = {x["id"]: x for x in merging.merge_entities(df).collect()}
    assert len(got) == len({x[0] for x in rows})
    for i, x in got.items():
        mine = sorted((y for y in rows if y[0] == i), key=lambda y: y[-1])
        text, attrs = "", {}
        for y in mine:
            if y[8] and y[8] not in text:
                text += ("\n" if text else "") + y[8]
            attrs.update(y[6])
        union = lambda c: sorted({v for y in mine for v in y[c]})
        longest = max(mine, key=lambda y: (len(y[4] or ""), -y[-1]))
        assert (x["evidence"] or "", x["attributes"], x["aliases"], x["source_pages"], x["source_chunks"]) == (text, attrs, union(5), union(9), union(10))
        assert (x["canonical_name"], x["description"], x["frequency"], x["confidence"], x["ord"]) == (mine[0][1], longest[4], len(mine), max(y[7] for y in mine), mine[0][-1])


def test_a_batch_comes_after_what_is_stored(spark):
    from quarry.streaming.ingest import merged_with

    shape = "id string, canonical_name string, name string, type string, description string, aliases array<string>, attributes map<string,string>, confidence double, evidence string, source_pages array<int>, source_chunks array<int>, frequency long, ord long"
    row = lambda value, e, o: ("i", value, value, "T", "", [], {"k": value}, 0.5, e, [1], [1], 1, o)
    stored = merged_with(None, spark.createDataFrame([row("old", "one", 7)], shape))
    x = merged_with(stored, spark.createDataFrame([row("new", "two", 0)], shape)).collect()
    assert [(y["canonical_name"], y["attributes"], y["evidence"], y["frequency"]) for y in x] == [("old", {"k": "new"}, "one\ntwo", 2)]


def test_relationship_ends(spark):
    e = merging.entities_of(raw_entities(spark))
    raw = spark.createDataFrame(
        [(0, "ISO 20022", "MIGRATES_TO", "iso 20022 x", "d", None, "e1", 1, 1, 0), (2, "BANK", "uses it", "Other Thing", None, 0.3, None, 1, 2, 1), (2, "Bank", "OWNS", "Bank", None, None, None, 1, 1, 2), (2, "", "OWNS", "Bank", None, None, None, 1, 1, 3)],
        "chunk_id int, source string, relation string, target string, description string, confidence double, evidence string, page_start int, page_end int, ord long",
    )
    r = merging.relationships_of(raw, e)
    assert sorted((x["source"], x["relation"], x["target"]) for x in r.collect()) == [("bank-concept", "USES_IT", "other-thing-cross-chunk"), ("iso-20022-standard", "USES", "iso-20022-x-cross-chunk")]
    merged = merging.merge_entities(e)
    extra = spark.createDataFrame([("iso-20022-cross-chunk", "R", "bank-cross-chunk", 9)], "source string, relation string, target string, ord long")
    assert tuple(merging.resolve_cross_chunk(extra, merged).select("source", "target").first()) == ("iso-20022-standard", "bank-concept")


def test_rewiring(spark):
    e = spark.createDataFrame([("a-x", "A-1", 3, "d", 0), ("a-y", "a 1", 3, "dd", 1), ("b", "B", 1, "", 2)], "id string, canonical_name string, frequency int, description string, ord long")
    ids = merging.merge_by_name(e)
    assert dict(map(tuple, ids.collect())) == {"a-x": "a-y", "a-y": "a-y", "b": "b"}
    r = spark.createDataFrame([("a-x", "R", "b"), ("a-y", "R", "b"), ("a-x", "R", "a-y"), ("b", "R", "a1-cross-chunk"), ("b", "R", "zzz")], "source string, relation string, target string")
    survivors = e.where("id <> 'a-x'")
    w = merging.rewire(r, survivors, ids)
    assert tuple(merging.rewire_counts(w).first()) == (1, 1, 1)
    assert {(x["source"], x["target"]) for x in w.where("fate = 'kept'").collect()} == {("a-y", "b"), ("b", "a-y")}


# --- graphs

def random_graph(spark, n=40, m=60, seed=2):
    r = random.Random(seed)
    e = sorted({(f"n{r.randrange(n)}", r.choice("RS"), f"n{r.randrange(n)}") for _ in range(m)})
    return e, spark.createDataFrame(e, "src string, rel string, dst string").repartition(3)


def test_paths_from_a_hub(spark):
    """The first chains in depth-first order, with far more edges at one node than chains are wanted."""
    r = random.Random(6)
    e = sorted({("hub", "R", f"n{r.randrange(300):03}") for _ in range(200)} | {(f"n{r.randrange(300):03}", "R", r.choice(["hub", f"n{r.randrange(300):03}"])) for _ in range(150)})
    df = spark.createDataFrame(e, "src string, rel string, dst string").repartition(4)
    seeds = spark.createDataFrame([(1, "hub", 1), (1, "n005", 2), (2, "n010", 1)], "qid long, id string, rank int")
    out: dict[str, list[str]] = {}
    for a, _, b in e:
        out.setdefault(a, []).append(b)

    def walk(chain, left):
        for b in sorted(out.get(chain[-1], [])) if left else ():
            yield [*chain, b]
            yield from walk([*chain, b], left - 1)

    for most in (7, 60):
        got: dict[int, list] = {}
        for x in sorted(graph.paths(df, seeds, 3, most).collect(), key=lambda x: (x["qid"], x["ordinals"])):
            got.setdefault(x["qid"], []).append(x["chain"])
        want = {1: [*walk(["hub"], 3), *walk(["n005"], 3)][:most], 2: list(walk(["n010"], 3))[:most]}
        assert got == {k: v for k, v in want.items() if v}


def test_components(spark):
    e, df = random_graph(spark, 60, 45)
    label = {x: x for a, _, b in e for x in (a, b)}
    for _ in label:
        for a, _, b in e:
            label[a] = label[b] = min(label[a], label[b])
    got = dict(connected(df.select(F.col("src").alias("u"), F.col("dst").alias("v"))).collect())
    loops = {a for a, _, b in e if a == b} - {x for a, _, b in e if a != b for x in (a, b)}
    assert got == {k: v for k, v in label.items() if k not in loops}
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(62)], "id string")
    s = component_summary(component_sizes(df.select(F.col("src").alias("u"), F.col("dst").alias("v")), nodes)).first()
    assert s["components"] == 62 - len(label) + len(set(label.values()))
    assert connected(df.limit(0).select(F.col("src").alias("u"), F.col("dst").alias("v"))).count() == 0


def test_reach_and_paths(spark):
    e, df = random_graph(spark)
    seeds = spark.createDataFrame([(1, "n0", 1), (1, "n5", 2), (2, "n7", 1), (3, "nowhere", 1)], "qid int, id string, rank int")
    seen, emitted = graph.reach(df, seeds, 3)
    got = {}
    for r in emitted.collect():
        got.setdefault(r["qid"], set()).add((r["src"], r["rel"], r["dst"]))
    order = {}
    for a, rel, b in sorted(e, key=lambda x: (x[0], x[2], x[1])):
        order.setdefault(a, []).append(b)
    chains = {}
    for r in graph.paths(df, seeds, 3, 20).collect():
        chains.setdefault(r["qid"], []).append(r["chain"])
    for q, starts in {1: ["n0", "n5"], 2: ["n7"], 3: ["nowhere"]}.items():
        known, front, want = set(starts), set(starts), set()
        for _ in range(3):
            step = [(a, rel, b) for a, rel, b in e if a in front] + [(a, rel, b) for a, rel, b in e if b in front and a not in known]
            want |= set(step)
            front = ({b for a, _, b in step if a in front} | {a for a, _, b in step if b in front}) - known
            known |= front
        assert got.get(q, set()) == want

        def walk(chain, left):
            for b in order.get(chain[-1], []) if left else []:
                yield [*chain, b]
                yield from walk([*chain, b], left - 1)

        first = list(itertools.islice((c for s in starts for c in walk([s], 3)), 20))
        assert sorted(chains.get(q, [])) == sorted(first)


def test_neighbours_are_paired_before_they_are_counted(spark):
    df = spark.createDataFrame([("a", "R", "b"), ("b", "S", "a"), ("a", "S", "b"), ("a", "R", "a"), ("b", "R", "c"), (None, "R", "c")], "src string, rel string, dst string")
    d = graph.neighbour_degrees(df)
    assert dict(map(tuple, d.collect())) == {"a": 1, "b": 2, "c": 1}
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Aggregate")  # pairs are made one below, not both their ends


def test_small_graph_statistics(spark):
    nodes = spark.createDataFrame([("a", "Alpha", "T", ["beta"]), ("b", "Beta", "T", []), ("c", "alpha", "U", []), ("d", "Lone", "U", [])], "id string, name string, type string, aliases array<string>")
    e = spark.createDataFrame([("a", "R", "b"), ("b", "S", "a"), ("a", "OWNS", "c"), ("c", "OWNED_BY", "a"), ("a", "R", "a")], "src string, rel string, dst string")
    assert {(r["a"], r["b"], r["rel_ab"]) for r in graph.reverse_edges(e).collect()} == {("a", "b", "R")}
    assert [tuple(r) for r in graph.alias_collisions(nodes).collect()] == [("a", "b")]
    assert [r["id"] for r in graph.isolated(nodes, e).collect()] == ["d"]
    assert tuple(graph.density(e, nodes).first()) == (4, 2, round(2 / 6, 6))
    assert graph.duplicate_names(nodes).collect()[0]["members"] == 2
    hop = {r["id"]: (r["hop1"], r["hop2"]) for r in graph.khop_counts(e, nodes.select("id")).collect()}
    assert hop == {"a": (2, 2), "b": (1, 2), "c": (1, 2), "d": (0, 0)}
    seeds = spark.createDataFrame([(1, "b")], "qid int, id string")
    assert graph.neighbourhood(e, seeds, 1).count() == 2


# --- keywords and retrieval

def test_keywords(spark):
    q = spark.createDataFrame([(1, 'What is "Group Header" in ISO 20022 and the ISO code?'), (2, "how do customers pay their bank"), (3, "the of and")], "qid int, question string")
    first = {(r["qid"], r["rank"]): r["keyword"] for r in keywords.first_keywords(q).collect()}
    assert first[1, 1] == "Group Header" and first[1, 2] == "ISO 20022" and first[2, 1] == "customers" and (3, 1) not in first
    texts = spark.createDataFrame([(1, "iso 20022 customers"), (2, "bank group header"), (3, "customers")], "id int, text string")
    ranked = {(r["qid"], r["rank"]): r["keyword"] for r in keywords.ranked_keywords(q, texts).collect()}
    assert ranked[1, 1] == "Group Header" and ranked[1, 2] == "ISO 20022" and ranked[2, 1] == "pay"
    kept = {r["keyword"] for r in keywords.graph_candidates(q).where("qid = 1").collect()}
    assert {"Group Header", "ISO 20022", "ISO"} <= kept and "Group" not in kept


def test_contains_pairs_both_ways(spark):
    texts = spark.createDataFrame([(1, "abcabc"), (2, "xbc"), (3, None), (4, "")], "id int, text string")
    terms = spark.createDataFrame([("abc",), ("bc",), ("c",), ("",), (None,), ("zz",)], "term string")
    want = {(1, "abc"), (1, "bc"), (1, "c"), (2, "bc"), (2, "c")}
    assert set(map(tuple, contains_pairs(texts, terms).collect())) == want
    assert set(map(tuple, contains_pairs(texts, terms, most=1).collect())) == want


def test_seeds_mentions_and_context(spark):
    e = spark.createDataFrame([("e1", "Charge Bearer", "T", ["cb"], "bears charges", 1), ("e2", "Bank", "T", [], "a bank pays", 2), ("e3", "SLEV", "T", [], "", 9)], "id string, name string, type string, aliases array<string>, source_text string, page long")
    ed = spark.createDataFrame([("e1", "USED_BY", "e2", "as said", 2)], "src string, rel string, dst string, source_text string, page long")
    ch = spark.createDataFrame([(10, 1, "The ChargeBearer is here"), (11, 2, "bank"), (12, 3, "nothing"), (13, 9, "slevin and SLEV")], "id long, page long, text string")
    kw = spark.createDataFrame([(1, "chargebearer"), (1, "pays")], "qid int, low string")
    got = {r["id"]: r["score"] for r in retrieval.seeds(kw, e).collect()}
    assert got == {"e1": 8, "e2": 1}
    assert set(map(tuple, retrieval.mentions(e, ch).collect())) == {("e1", 10), ("e2", 11), ("e3", 13)}
    q = spark.createDataFrame([(1, "What does ChargeBearer mean for a Bank")], "qid int, question string")
    lines = retrieval.graph_context(q, retrieval.Graph(e, ed, ch)).orderBy("ord").collect()
    text = [r["line"] for r in lines]
    assert text[0].startswith("[Entity | page 1] Charge Bearer (T)") and any(t.startswith("[Source chunk | page 1] The ChargeBearer") for t in text)
    assert "[Path] Charge Bearer -[USED_BY]-> Bank" in text and "   (page 2): as said" in text
    assert [r["kind"] for r in lines] == sorted((r["kind"] for r in lines), key=["entity", "chunk", "path", "triple"].index)


def test_spread_fill_budget(spark):
    d = spark.createDataFrame([(1, 5, 1, 9.0), (1, 5, 2, 8.0), (1, 5, 3, 7.0), (1, 8, 4, 1.0)], "qid int, page int, id int, score double")
    s = retrieval.spread(d, 2, 3)
    assert [r["id"] for r in s.orderBy("rank").collect()] == [1, 2, 4]
    chunks = spark.createDataFrame([(i, p) for i, p in ((1, 5), (2, 5), (3, 5), (4, 8), (6, 4), (7, 6), (8, 7), (9, 9))], "id int, page int")
    assert [r["id"] for r in retrieval.fill(s, chunks, 6).orderBy("rank").collect()] == [1, 2, 4, 6, 7, 8]
    lines = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "bb"), (1, 3, "aaaa"), (1, 4, "c")], "qid int, ord int, line string")
    assert [r["ord"] for r in retrieval.budget(retrieval.first_lines(lines), 6).orderBy("ord").collect()] == [1, 2]


# --- vectors and evaluation

def test_vectors(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((60, 8))
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)] + [(98, None), (99, [0.0] * 8)], "vec_id long, embedding array<double>").repartition(3)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = {}
    for t in vector.top_k(q, v, 4).orderBy("qid", "rank").collect():
        near.setdefault(t["qid"], []).append(t["vec_id"])
    for i in (0, 20, 40):
        cos = np.round(u @ u[i], 6)
        cos[i] = -9
        assert near[i] == np.lexsort((np.arange(60), -cos))[:4].tolist()
    picked = vector.mmr(q, v, 3, 10).where("qid = 0").orderBy("rank").collect()
    assert len(picked) == 3 and picked[0]["vec_id"] == near[0][0]


def test_nearest_a_few_queries_at_a_time(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = np.round(r.standard_normal((90, 3)))  # with many ties
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    q = v.select(F.col("vec_id").alias("qid"), "embedding")
    want = [tuple(t) for t in vector.top_k(q, v, 4).orderBy("qid", "rank").collect()]
    monkeypatch.setattr(vector, "SLICE", 7)
    assert [tuple(t) for t in vector.top_k(q, v, 4).orderBy("qid", "rank").collect()] == want
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    some = np.flatnonzero(np.any(x != 0, axis=1))
    cos = np.round(u[some] @ u[some].T, 6)
    np.fill_diagonal(cos, -np.inf)
    assert [(t[0], t[1]) for t in want] == [(a, some[j]) for a, row in zip(some, cos) for j in np.lexsort((some, -row))[:4]]
    cos[:, 3] = np.nan
    assert len(vector._nearest(cos, some, some, 2, False)[0]) == 2 * len(some)


def test_gate_and_ranks(spark):
    r = spark.createDataFrame([(True, False, True, False, 0.9, 0.2, 10), (False, False, True, True, 0.5, 0.5, 20)], "new_page_on boolean, old_page_on boolean, new_chunk_on boolean, old_chunk_on boolean, new_recall double, old_recall double, new_candidates int")
    g = evaluation.gate(r, 100).first()
    assert (g["verdict"], g["decision"]) == ("PASS", "PROCEED")
    assert evaluation.gate(r, 15).first()["verdict"] == "NOT APPROVED"
    cand = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 7, 1)], "qid int, id int, rank int")
    truth = spark.createDataFrame([(1, 6), (2, 9)], "qid int, id int")
    assert dict(map(tuple, evaluation.truth_rank(cand, truth).collect())) == {1: 2, 2: None}
