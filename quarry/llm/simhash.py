"""Operator 9, SimHash near-dedup by the generalised pigeonhole principle.

Each text gets a 64-bit SimHash. The 64 bits are grouped into partitions of correlated bits; a dynamic
programme gives partition i a threshold t_i >= -1 with sum(t_i + 1) = radius + 1, so that two
fingerprints within the radius are within t_i of each other in some partition. Candidates share a
bucket there (the partition's value with t_i bits masked) and are verified on all 64 bits, so no link is
lost whatever thresholds are chosen. Partitions and thresholds are those of the least cost, which is
made of the rows that the masks deal out and of the candidates that all fingerprints lead one to
expect; where one number of partitions gives way to the next, rows rise as candidates fall, so the cost
is continuous though the rows are not.

near_duplicates() links fingerprints of three-word shingles within the radius. similar() makes the same
search over fingerprints of the distinct words, which move less when a text is edited, with a wider
radius, for candidates only: within each group that it finds, the sets of five-word shingles of all
texts are compared, and those of a Jaccard similarity of at least 0.8 are linked. Groups of more than
GROUP texts are compared in pairs of blocks; links leave a task as spanning trees. The work is quadratic
in a group. Of the pairs of that similarity, those whose fingerprints differ in more than WORD_RADIUS bits
are missed unless others connect them (measured recall: README).

A bucket of more than HOT rows isn't compared where it lands: its rows are dealt out again over pairs
of blocks of at most about HOT rows each.

Defined cases: null and empty texts have fingerprint zero and link like any other; equal texts share
a class; rows that repeat appear as often as they came; a null doc_id belongs to its text's
component and is null's own component only if no row there has an id; a text of one to four words is
one shingle in similar(); very long texts and words are read whole; ties of rows in one_of_each() are
broken by all their columns; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import textvec as V
from quarry.llm.shared import components, cut, forest

RADIUS = 3
#: For similar(): differing bits of fingerprints of distinct words, and words of a shingle. 97 in 100 pairs of a
#: similarity of 0.8 or more lie within 7 bits (93 within 6).
WORD_RADIUS, SHINGLE = 7, 5
GROUP = 256  # texts of a block of a group
HOT = 4096  # rows of a bucket that are compared at once
ROW_COST = 64  # a row dealt out costs as much as so many comparisons
PARTITIONS = (2, 3, 4)
SMALL = 1 << 18  # rows that may be broadcast
LAST = 2**63 - 1
BITS_AT_ONCE = 1 << 15  # hashes whose bits are laid out at a time
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def majority(text: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """The bits set in over half of the hashes h of each of n texts, whose numbers `text` are sorted."""
    count = np.bincount(text, minlength=n)
    ones = np.zeros((n, 64), np.int64)
    for k in range(0, len(h), BITS_AT_ONCE):
        t = text[k : k + BITS_AT_ONCE]
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        bits = np.unpackbits(h[k : k + BITS_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[t[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprints_of(texts: pa.Array, shingle: int = 3) -> pa.Array:
    """SimHash of each text's shingles as signed 64-bit integers (the bits of the unsigned value)."""
    parts: list[np.ndarray] = []
    digest = xxhash.xxh64_intdigest
    for a, b, raw, offsets in V.chunks(texts):
        w = V.words(_LOWER[raw], offsets)
        body, text_at, stop = V.joined(w)
        flat = body.tobytes()
        lengths = w.end - w.start
        begin = stop - lengths
        at = V.starts_of_ngrams(w, shingle)
        short = np.flatnonzero((w.counts > 0) & (w.counts < shingle))
        text = np.concatenate([w.text[at], short])
        lo = np.concatenate([begin[at], text_at[short]]).tolist()
        hi = np.concatenate([stop[at + shingle - 1], text_at[short + 1]]).tolist()
        h = np.array([digest(flat[s:e], 42) for s, e in zip(lo, hi)], np.uint64)
        order = np.argsort(text, kind="stable")
        parts.append(majority(text[order], h[order], b - a))
    V.release()
    return pa.array((np.concatenate(parts) if parts else np.zeros(0, np.uint64)).view(np.int64))


@F.arrow_udf(T.LongType())
def fingerprint(t: pa.Array) -> pa.Array:
    return fingerprints_of(t)


def _moments(batches):
    """Of each task: how often bits i and j are both set."""
    both = np.zeros((64, 64), np.int64)
    for batch in batches:
        v = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
        for k in range(0, len(v), 1 << 16):
            x = np.unpackbits(v[k : k + (1 << 16)], axis=1, bitorder="little").astype(np.float32)
            both += np.rint(x.T @ x).astype(np.int64)
    i, j = np.indices((64, 64))
    yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (i, j, both)], names=["i", "j", "n"])


def group_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m partitions of near equal width, each gathering the bits most correlated with those it has."""
    p = np.diag(both) / max(1, n)
    var = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    cor = np.abs(both / max(1, n) - np.outer(p, p)) / np.outer(var, var)
    left, out = list(range(64)), []
    for k in range(m):
        width = (64 - sum(map(len, out))) // (m - k)
        part = [max(left, key=lambda i: (cor[i, left].sum(), -i))]
        left.remove(part[0])
        while len(part) < width:
            nxt = max(left, key=lambda i: (cor[i, part].sum(), -i))
            part.append(nxt)
            left.remove(nxt)
        out.append(sorted(part))
    return out


def masks_of(part: list[int], t: int) -> list[int]:
    """The partition's bits without t of them, for every choice of the t; none if t is -1."""
    full = sum(1 << i for i in part)
    return [full & ~sum(1 << i for i in c) for c in combinations(part, t)] if t >= 0 else []


def allocate(cost: list[list[float]], total: int) -> list[int]:
    """Thresholds t_i with sum(t_i + 1) = total and least sum of cost[i][t_i + 1], by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for step, x in enumerate(row):
                if used + step <= total and (used + step not in nxt or c + x < nxt[used + step][0]):
                    nxt[used + step] = (c + x, [*ts, step - 1])
        best = nxt
    return best[total][1]


def chosen(both: np.ndarray, n: int, parts_of: dict[int, list[list[int]]], equal: dict[tuple[int, int], float], radius: int) -> tuple[list[int], float]:
    """(masks, cost) of the least cost: `equal` has, for m partitions and each one's number, the ordered pairs that agree there.

    Pairs that agree in all but t bits of a partition are those that agree in it times the sum, over all
    choices of t bits, of 1 / (how often two fingerprints agree in each).
    """
    p = np.diag(both) / max(1, n)
    agree = p * p + (1 - p) * (1 - p)
    best: tuple[list[int], float] | None = None
    for m, parts in parts_of.items():
        cost = []
        for k, part in enumerate(parts):
            choices = [1.0] + [0.0] * radius  # elementary symmetric sums
            for b in part:
                for t in range(radius, 0, -1):
                    choices[t] += choices[t - 1] / agree[b]
            cost.append([0.0] + [equal.get((m, k), 0.0) * choices[t] / 2 + ROW_COST * float(max(1, n)) * comb(len(part), t) for t in range(radius + 1)])
        ts = allocate(cost, radius + 1)
        total = sum(c[t + 1] for c, t in zip(cost, ts))
        if best is None or total < best[1]:
            best = [x for part, t in zip(parts, ts) for x in masks_of(part, t)], total
    return best


def plan(classes: DataFrame, radius: int = RADIUS) -> list[int]:
    """The masks to probe with, from all fingerprints `fp`: their bits' correlations and how many agree in each partition."""
    got = classes.select("fp").mapInArrow(_moments, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((64, 64))
    for r in got:
        both[r["i"], r["j"]] = r["n"]
    n = classes.count()
    parts_of = {m: group_bits(both, n, m) for m in PARTITIONS}
    full = [F.struct(F.lit(m).alias("m"), F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << i for i in p)))).alias("v")) for m, parts in parts_of.items() for k, p in enumerate(parts)]
    values = classes.select(F.explode(F.array(*full)).alias("x")).groupBy("x.m", "x.k", "x.v").count()
    pairs = values.groupBy("m", "k").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("c")).collect()
    return chosen(both, n, parts_of, {(r["m"], r["k"]): r["c"] for r in pairs}, radius)[0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_ROWS = "m long, fp long, node long, size long"


def _near_pairs(bucket: np.ndarray, fp: np.ndarray, radius: int):
    """(i, j) of the rows of one bucket within the radius, some at a time; rows are sorted by bucket."""
    i, d = np.arange(len(fp)), 0
    while True:
        d += 1
        i = i[i + d < len(fp)]
        i = i[bucket[i + d] == bucket[i]]
        if not len(i):
            return
        hit = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
        if len(hit):
            yield hit, hit + d


def _links(bucket, fp, node, size, radius):
    """Edges that connect what is linked: stars around the smallest node of each component.

    Sizes that differ by more than a fifth of the larger one rule a pair out; 0 rules nothing out.
    """
    us, vs, held = [], [], 0
    for i, j in _near_pairs(bucket, fp, radius):
        ok = 5 * np.minimum(size[i], size[j]) >= 4 * np.maximum(size[i], size[j])
        us.append(node[i[ok]])
        vs.append(node[j[ok]])
        held += len(us[-1])
        if held > 500_000:
            x, y = forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [x], [y], len(x) // 2
    if us:
        yield forest(np.concatenate(us), np.concatenate(vs))


def _buckets(radius: int, keys: int, hot: int | None):
    """Streams rows sorted by bucket (m, fp & m and, with three keys, what block pair they are dealt to).

    Yields links as rows with m = 0, their ends in fp and node; rows of buckets of more than `hot` rows come
    out as they are. What is held at a time has 200,000 rows and, where hot is set, no more of a bucket.
    """

    def batch(cols):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["m", "fp", "node", "size"])

    def run(batches):
        held, rows = [], 0
        open_hot = None  # the bucket whose rows pass as they are

        def done(cols):
            key = cols[:1] + [cols[1] & cols[0]] + cols[4:]
            new = np.ones(len(cols[0]), bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
            bucket = np.cumsum(new) - 1
            keep = np.ones(len(bucket), bool) if hot is None else np.bincount(bucket)[bucket] <= hot
            if not keep.all():
                yield batch([c[~keep] for c in cols[:4]])
            m, fp, node, size = (c[keep] for c in cols[:4])
            for u, v in _links(bucket[keep], fp.view(np.uint64), node, size, radius):
                zero = np.zeros(len(u), np.int64)
                if len(u):
                    yield batch((zero, u, v, zero))

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2 + keys)]
            if open_hot is not None:
                same = (cols[0] == open_hot[0]) & ((cols[1] & cols[0]) == open_hot[1])
                if same.any():
                    yield batch([c[same] for c in cols[:4]])
                    cols = [c[~same] for c in cols]
                if not len(cols[0]):
                    continue
                open_hot = None
            held.append(cols)
            rows += len(cols[0])
            if rows < 200_000:
                continue
            cols = [np.concatenate(x) for x in zip(*held)]
            key = cols[:1] + [cols[1] & cols[0]] + cols[4:]
            last = np.all([k == k[-1] for k in key], axis=0)
            if hot is not None and last.sum() > hot:  # too many already: the rest of it passes as it comes
                open_hot = (cols[0][-1], cols[1][-1] & cols[0][-1])
                yield from done(cols)
                held, rows = [], 0
                continue
            end = len(last) - int(last.sum())
            if end:
                yield from done([c[:end] for c in cols])
            held, rows = [[c[end:] for c in cols]], int(last.sum())
        if rows:
            yield from done([np.concatenate(x) for x in zip(*held)])

    return run


def probe(rows: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """(u, v): edges that connect the nodes of rows (fp, node, size) that are within the radius."""
    m, key = F.col("m"), F.col("fp").bitwiseAND(F.col("m"))
    cols = ["m", "fp", "node", "size"]
    dealt = rows.select("fp", "node", "size", F.explode(F.array(*(F.lit(_signed(x)) for x in masks))).alias("m")).select(*cols)
    found = cut(dealt.repartition(m, key).sortWithinPartitions(m, key).mapInArrow(_buckets(radius, 2, HOT), _ROWS))
    edges = found.where("m = 0").select(F.col("fp").alias("u"), F.col("node").alias("v"))
    hot = found.where("m <> 0")
    if hot.isEmpty():
        return edges
    sizes = hot.groupBy(m.alias("_m"), key.alias("_key")).agg(F.ceil(2 * F.count("*") / HOT).cast("long").alias("k"))
    split = hot.join(sizes, (m == F.col("_m")) & (key == F.col("_key"))).select(*cols, *_block_pair(F.col("node"), F.col("k")))
    split = split.select(*cols, F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    dealt = split.repartition(m, key, F.col("i"), F.col("j")).sortWithinPartitions(m, key, "i", "j")
    more = dealt.mapInArrow(_buckets(radius, 4, None), _ROWS)
    return edges.unionByName(more.select(F.col("fp").alias("u"), F.col("node").alias("v")))


def _block_pair(node: Column, k: Column) -> tuple[Column, Column]:
    """(b, o): the node's block of k, and in a row each, every block that it meets."""
    return F.pmod(F.xxhash64(node, F.lit(3)), k).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), k - 1)).alias("o")


def _named(marked: DataFrame, classes: DataFrame, comp: DataFrame, by: str) -> DataFrame:
    """marked (doc_id, text_hash, `by` and others) with component and component_id; classes has `by` and its smallest id `doc`."""
    of = classes.join(comp, classes[by] == comp.id, "left").select(by, "doc", F.coalesce("component", by).alias("component"))
    names = of.groupBy("component").agg(F.min("doc").alias("low"))
    of = of.join(names, "component").select(by, "component", F.when(F.col("low") < LAST, F.col("low")).alias("component_id"))
    return marked.join(of, by)


def near_duplicates(docs: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component, component_id, text_hash) for every row of docs (doc_id, text).

    component is a number of the group, component_id its smallest doc_id.
    """
    marked = cut(docs.select("doc_id", fingerprint("text").alias("fp"), F.xxhash64("text").alias("text_hash")))
    classes = cut(marked.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(LAST)).alias("doc")))
    # nodes are fingerprints, as one id can have several texts; ids name the components afterwards
    rows = classes.select("fp", F.col("fp").alias("node"), F.lit(0).cast("long").alias("size"))
    comp = components(probe(rows, plan(classes, radius), radius))
    return _named(marked, classes, comp, "fp").select("doc_id", "fp", "component", "component_id", "text_hash")


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, offsets): the sorted distinct hashes of the five-word shingles of each text."""
    parts, sizes = [], []
    for a, b, raw, offsets in V.chunks(texts):
        w = V.words(_LOWER[raw], offsets)
        words = V.word_hashes(w)
        at = V.starts_of_ngrams(w, SHINGLE)
        text, h = [w.text[at]], [V.ngram_hashes(words, SHINGLE)[at]]
        for n in range(1, SHINGLE):
            short = np.flatnonzero(w.counts == n)
            text.append(short)
            h.append(V.ngram_hashes(words, n, 1)[w.first[short]])
        text, h = _distinct(np.concatenate(text), np.concatenate(h))
        parts.append(h)
        sizes.append(np.bincount(text, minlength=b - a))
    flat = np.concatenate([np.zeros(0, np.uint64), *parts])
    return flat, np.cumsum(np.concatenate([np.zeros(1, np.int64), *sizes]))


def _distinct(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return text[new], h[new]


def word_fingerprints(texts: pa.Array) -> np.ndarray:
    """SimHash of each text's distinct words."""
    parts = [np.zeros(0, np.uint64)]
    for a, b, raw, offsets in V.chunks(texts):
        w = V.words(_LOWER[raw], offsets)
        text, h = _distinct(w.text, V.word_hashes(w))
        parts.append(majority(text, V.mix(h), b - a))
    return np.concatenate(parts)


MARKS = T.StructType([T.StructField(n, T.LongType()) for n in ("node", "size", "fp")])


@F.arrow_udf(MARKS)
def shingle_marks(t: pa.Array) -> pa.Array:
    """A number of each text's shingle set, the set's size and the fingerprint of its words."""
    got = [(np.zeros(0, np.int64),) * 3]
    for k in range(0, len(t), 1024):
        part = t.slice(k, 1024)
        flat, offsets = shingle_sets(part)
        size = np.diff(offsets)
        total = V.sums(V.mix(flat ^ np.uint64(0x9E3779B97F4A7C15)).view(np.int64), offsets)
        node = V.mix(total.view(np.uint64) + size.astype(np.uint64)).view(np.int64)
        got.append((node, size, word_fingerprints(part).view(np.int64)))
    V.release()
    return pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got)], ["node", "size", "fp"])


def linked(sets: list[np.ndarray], columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the sets x, y of a Jaccard similarity of at least 0.8, which is 9 |x and y| >= 4 (|x| + |y|)."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(n), size)
    _, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # of the shingles that two sets have
    shared = times[which] > 1
    row, which = row[shared], number[which[shared]]
    order = np.argsort(which, kind="stable")
    row, which = row[order], which[order]
    both = np.zeros((n, n), np.float32)
    for k in range(0, int(number[-1]) + 1, columns):
        a, b = np.searchsorted(which, (k, k + columns))
        x = np.zeros((n, columns), np.float32)
        x[row[a:b], which[a:b] - k] = 1
        both += x @ x.T
    i, j = np.nonzero(9 * both >= 4 * (size[:, None] + size[None, :]))
    return i[i < j], j[i < j]


def _compare(batches):
    """Of rows (group, i, j, node, text) sorted by the first four: links of each group and pair of blocks, as spanning trees."""
    at, nodes, sets = None, [], []

    def done():
        if len(nodes) > 1:
            i, j = linked(sets)
            if len(i):
                number = np.array(nodes)
                u, v = forest(number[i], number[j])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            flat, offsets = shingle_sets(part.column(4))
            for r, (*now, node) in enumerate(zip(*(part.column(c).to_pylist() for c in range(4)))):
                if now != at:
                    yield from done()
                    at, nodes, sets = now, [], []
                if not nodes or nodes[-1] != node:  # a row of docs that repeats comes as often as it does
                    nodes.append(node)
                    sets.append(flat[offsets[r] : offsets[r + 1]].copy())
        V.release()
    yield from done()


def similar(docs: DataFrame, *, radius: int = WORD_RADIUS) -> DataFrame:
    """(doc_id, component, component_id, text_hash) for every row of docs (doc_id, text), by five-word similarity."""
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d")
    marked = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), shingle_marks("text").alias("x"))
    marked = cut(marked.select("doc_id", "text_hash", "x.node", "x.size", "x.fp"))
    one = F.min(F.struct("text_hash", d)).alias("one")
    classes = cut(marked.groupBy("node").agg(F.min("fp").alias("fp"), F.min("size").alias("size"), F.coalesce(F.min("doc_id").cast("long"), F.lit(LAST)).alias("doc"), one))
    group = components(probe(classes.select("fp", "node", "size"), plan(classes, radius), radius)).select(F.col("id").alias("node"), F.col("component").alias("group"))
    group = cut(group)
    blocks = group.groupBy("group").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("k"))
    members = cut(group.join(blocks, "group").join(classes, "node").select("group", "k", "node", "one.text_hash", "one.d"))
    if members.count() <= SMALL:
        members = F.broadcast(members)
    texts = docs.select(d, "text", F.xxhash64("text").alias("text_hash")).join(members, ["text_hash", "d"])
    texts = texts.select("group", "node", "text", *_block_pair(F.col("node"), F.col("k")))
    texts = texts.select("group", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "node", "text")
    links = texts.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "node").mapInArrow(_compare, "u long, v long")
    return _named(marked, classes, cut(components(links)), "node").select("doc_id", "component", "component_id", "text_hash")


def keep_one(docs: DataFrame, *, radius: int = WORD_RADIUS) -> DataFrame:
    """docs' columns of one document of each group of similar(): the one of the smallest doc_id, null last."""
    return one_of_each(docs, similar(docs.select("doc_id", "text"), radius=radius))


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs' columns of the document of the smallest doc_id, null last, of each component of groups (doc_id, component, text_hash)."""
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one"))
    first = first.select(F.coalesce("one.doc_id", F.lit(LAST)).alias("_d"), F.col("one.text_hash").alias("_h"))
    d = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("_d"), F.xxhash64(docs["text"]).alias("_h"))
    once = Window.partitionBy("_d", "_h").orderBy(F.to_json("row"))
    d = d.join(first.distinct(), ["_d", "_h"]).withColumn("_n", F.row_number().over(once)).where("_n = 1")
    return d.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
