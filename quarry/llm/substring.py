"""Operator 5, substring dedup by relative Lempel-Ziv parsing against an index of every text.

Texts are dealt to blocks by hash; each block is both a reference block and a set of texts to parse.
The index of a block holds, for each content-defined anchor (the least 4-word hash of some 13-word
window, so equal windows have equal anchors), the hash of the anchor's factor: the words of all
windows whose anchor it is. Every text is factored against the index of all blocks:

1. A factor that also starts in a text with a smaller id is a duplicate span as a whole.
2. A factor that doesn't, though its anchor has other factors elsewhere, lies at a factor boundary;
   there each 13-word window is checked by a 128-bit hash against those of the other boundaries.

Together this finds exactly the windows whose word sequence starts in a text with a smaller id. What
is dealt over the network is one row per block and distinct factor, so a passage in a third of all
texts costs a row per block, not per text, but its first and last factors, which reach into what differs
around it, a row per text. The rows of one anchor go through one task, which streams them sorted and
holds none but those that wait for an anchor's second factor.

Factors are longest where nothing is compared word by word: their bounds follow from the content, so that
a factor can be looked up by its hash in all blocks at once. A greedy parse, which extends each factor
word by word in one block's index, has to send each text to every block (figures: README).

Defined cases: null and empty texts have no words; very long texts are read whole; of equal passages in
one document, or in documents of one doc_id, none goes; rows that share a doc_id count as one document and
remove nothing from each other; a null doc_id is taken as larger than all others and removes nothing;
texts of under 13 words stay whole; extra columns of any name are kept by dedup_substrings().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import textvec as V

WINDOW, GRAM = 13, 4
LAST = 2**63 - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
SPANS = T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])))
_INDEX = "a long, s long, block long, lo long, hi long"
_VERDICT = "block long, kind int, a long, s long, low long, more boolean"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(_BASE), -1, 1 << 64)
    out = []
    for b in (int(_BASE), inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Factors:
    """Anchored factors of a run of texts: per factor its anchor, hash, text and range of windows."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.words = w = V.words(raw, offsets)
        self.hashes = h = V.word_hashes(w)
        s = V.starts_of_ngrams(w, WINDOW)
        grams = V.ngram_hashes(h, GRAM)
        if len(s):
            least, at = grams[s], s.copy()
            for d in range(1, WINDOW - GRAM + 1):
                g = grams[s + d]
                less = g < least
                least[less] = g[less]
                at[less] = s[less] + d
            text = w.text[s]
            new = np.ones(len(s), bool)
            new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
            i = np.flatnonzero(new)
            self.first = s[i]
            self.count = np.diff(np.append(i, len(s)))
            self.text = text[i]
            self.anchor = least[i].view(np.int64)
            up, down = _powers(len(h) + 1)
            total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * up[:-1], out=total[1:])
            end = self.first + self.count - 1 + WINDOW
            span = (total[end] - total[self.first]) * down[self.first]
            self.span = V.mix(span ^ V.mix(self.count.astype(np.uint64))).view(np.int64)
        else:
            self.first = self.count = self.text = np.zeros(0, np.int64)
            self.anchor = self.span = np.zeros(0, np.int64)

    def windows(self, which: np.ndarray) -> np.ndarray:
        """Starts of the windows of the chosen factors."""
        n = self.count[which]
        return np.repeat(self.first[which] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else n

    def window_hashes(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for which in (0, 1):
            x = np.zeros(len(starts), np.uint64)
            for j in range(WINDOW):
                x += self.hashes[starts + j] * V._NGRAM[which, j + 16]
            out.append(V.mix(x).view(np.int64))
        return out[0], out[1]


def _least(a, s, block, lo, hi):
    """One row for each (a, s): least lo and greatest hi."""
    order = np.lexsort((lo, s, a))
    a, s, lo, hi = a[order], s[order], lo[order], hi[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    i = np.flatnonzero(new)
    return [a[i], s[i], np.full(len(i), block, np.int64), lo[i], np.maximum.reduceat(hi, i) if len(i) else hi]


def _table(cols, schema: str) -> pa.Table:
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({n: pa.array(c, types[t]) for (n, t), c in zip(fields, cols)})


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("id").combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False)


def _index(table: pa.Table) -> pa.Table:
    ids = _ids(table)
    got = []
    for a, b, raw, offsets in V.chunks(table.column("text")):
        f = Factors(raw, offsets)
        d = ids[a:b][f.text]
        got.append((f.anchor, f.span, d))
    a, s, d = (np.concatenate(x) for x in zip(*got))
    V.release()
    return _table(_least(a, s, table.column("block")[0].as_py(), d, d), _INDEX)


def _groups(kind: int):
    """Streams rows sorted by (a, s, lo); yields what concerns each block, with the least lo of the pair (a, s).

    kind 0 also says whether `a` has more than one s, kind 1 leaves that out. Of earlier batches only the
    last pair, its least lo and the rows that wait for that answer are held: those of the first s of `a`
    that have its least lo, one for each block that holds that document.
    """

    def out(block, a, s, low, more) -> list[pa.RecordBatch]:
        return _table([block, np.full(len(a), kind, np.int32), a, s, low, more], _VERDICT).combine_chunks().to_batches()

    def waiting(wait: list, more: bool) -> list[pa.RecordBatch]:
        cols = [np.concatenate(c) for c in zip(*wait)]
        if not more:  # alone, a row concerns its block only if later documents there have the pair too
            cols = [c[cols[4] > cols[3]] for c in cols]
        return out(*cols[:4], np.full(len(cols[0]), more)) if len(cols[0]) else []

    def run(batches):
        at = pair = None  # the anchor and the s of the last row
        low0 = 0
        several = False  # whether the anchor is known to have more than one s
        wait: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            a, s, block, lo, hi = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            n = len(a)
            new_a = np.ones(n, bool)
            new_a[1:] = a[1:] != a[:-1]
            new_s = new_a.copy()
            new_s[1:] |= s[1:] != s[:-1]
            new_a[0] = at is None or a[0] != at
            new_s[0] = new_a[0] or s[0] != pair
            # anchors and pairs of this batch; number 0 goes on from the last batch
            anchor, which = np.cumsum(new_a), np.cumsum(new_s)
            first = np.flatnonzero(new_s)
            low = np.concatenate([[low0], lo[first]])[which]
            changes = np.bincount(anchor, weights=new_s & ~new_a, minlength=int(anchor[-1]) + 1) > 0
            changes[0] |= several
            more = changes[anchor]
            if wait and (changes[0] or new_a.any()):
                yield from waiting(wait, bool(changes[0]))
                wait = []
            open_ = (anchor == anchor[-1]) & ~more & (lo == low) if kind == 0 else np.zeros(n, bool)
            use = ~open_ & ((hi > low) | (more & (lo == low) if kind == 0 else False))
            if use.any():
                yield from out(block[use], a[use], s[use], low[use], more[use] & (kind == 0))
            if open_.any():
                wait.append((block[open_], a[open_], s[open_], low[open_], hi[open_]))
            at, pair, low0, several = a[-1], s[-1], low[-1], bool(more[-1])
        if wait:
            yield from waiting(wait, False)

    return run


class Verdicts:
    """Lookup of a block's verdicts of one kind by (a, s)."""

    def __init__(self, table: pa.Table, kind: int):
        cols = [table.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in ("kind", "a", "s", "low", "more")]
        mine = cols[0] == kind
        a, s, self.low, self.more = (c[mine] for c in cols[1:])
        self.key = V.mix(a.view(np.uint64)) + s.view(np.uint64)
        order = np.argsort(self.key)
        self.key, self.a, self.s, self.low, self.more = self.key[order], a[order], s[order], self.low[order], self.more[order]

    def find(self, a: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(smallest id with it or LAST, whether its anchor has other factors)"""
        low, more = np.full(len(a), LAST, np.int64), np.zeros(len(a), bool)
        if len(self.key) and len(a):
            at = np.minimum(np.searchsorted(self.key, V.mix(a.view(np.uint64)) + s.view(np.uint64)), len(self.key) - 1)
            hit = (self.a[at] == a) & (self.s[at] == s)
            low[hit], more[hit] = self.low[at[hit]], self.more[at[hit]]
        return low, more


def _boundaries(table: pa.Table, verdicts: pa.Table) -> pa.Table:
    """Windows to check one by one: those of factors first seen here whose anchor has other factors."""
    empty = np.zeros(0, np.int64)
    got = [(empty, empty, empty)]
    if table.num_rows and verdicts.num_rows:
        ids, known = _ids(table), Verdicts(verdicts, 0)
        for a, b, raw, offsets in V.chunks(table.column("text")):
            f = Factors(raw, offsets)
            low, more = known.find(f.anchor, f.span)
            which = np.flatnonzero(more & (low == ids[a:b][f.text]))
            starts = f.windows(which)
            got.append((*f.window_hashes(starts), np.repeat(ids[a:b][f.text[which]], f.count[which])))
    a, s, d = (np.concatenate(x) for x in zip(*got))
    return _table(_least(a, s, table.column("block")[0].as_py() if table.num_rows else -1, d, d), _INDEX)


def _without(raw: np.ndarray, offsets: np.ndarray, w: V.Words, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, text offsets) without the words from `begin` on, before `end`, and the white space after them."""
    delta = np.zeros(len(raw) + 1, np.int64)
    text = w.text[begin]
    inner = end < w.first[text + 1]
    stop = np.where(inner, w.start[np.minimum(end, len(w.start) - 1)], offsets[text + 1])
    np.add.at(delta, w.start[begin], 1)
    np.add.at(delta, stop, -1)
    keep = np.cumsum(delta[:-1]) == 0
    return raw[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def _strip(table: pa.Table, verdicts: pa.Table, keep_space: bool) -> pa.Table:
    ids = _ids(table)
    spans, single = Verdicts(verdicts, 0), Verdicts(verdicts, 1)
    n_words, n_removed, kept, spans_at, first, last = [], [], [], [np.zeros(1, np.int64)], [], []
    for a, b, raw, offsets in V.chunks(table.column("text")):
        f = Factors(raw, offsets)
        own = ids[a:b][f.text]
        low, more = spans.find(f.anchor, f.span)
        starts = [f.windows(np.flatnonzero(low < own))]
        edge = np.flatnonzero(more & (low == own))
        w = f.windows(edge)
        starts.append(w[single.find(*f.window_hashes(w))[0] < np.repeat(own[edge], f.count[edge])])
        gone = V.covered(np.concatenate(starts).astype(np.int64), WINDOW, len(f.words.start))
        n_words.append(f.words.counts)
        n_removed.append(V.sums(gone, f.words.first))
        text = f.words.text
        edge = np.append(True, (gone[1:] != gone[:-1]) | (text[1:] != text[:-1])) if len(gone) else np.zeros(0, bool)
        begin = np.flatnonzero(edge & gone)
        end = np.append(np.flatnonzero(edge), len(gone))
        end = end[np.searchsorted(end, begin, "right")]
        body, at = _without(raw, offsets, f.words, begin, end) if keep_space else V.joined(f.words, ~gone)[:2]
        kept.append(V.strings(body, at).cast(pa.string()))
        first.append(begin - f.words.first[text[begin]])
        last.append(end - f.words.first[text[begin]])
        spans_at.append(spans_at[-1][-1] + np.cumsum(np.bincount(text[begin], minlength=b - a)))
    runs = pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (first, last)], ["first", "end"])
    offsets = np.concatenate(spans_at).astype(np.int32)
    add = {"n_words": pa.array(np.concatenate(n_words)), "n_removed": pa.array(np.concatenate(n_removed)), "kept_text": pa.chunked_array(kept), "spans": pa.ListArray.from_arrays(pa.array(offsets), runs)}
    return pa.table({"row": table.column("row"), **add})


def dedup_substrings(docs: DataFrame, *, block_rows: int = 500, keep_space: bool = False) -> DataFrame:
    """docs' columns (doc_id and text among them) in a struct `row`, with n_words, n_removed, kept_text
    and spans, the runs of removed words (from `first` on, before `end`).

    kept_text is the kept words joined by one space or, with keep_space, the text itself without the runs
    and the white space after each. block_rows: texts in a block, on average; a block is what one task
    holds at a time.
    """
    n = max(1, -(-docs.count() // block_rows))
    deal = F.pmod(F.xxhash64(docs["doc_id"], docs["text"]), F.lit(n))
    rest = [docs[c] for c in docs.columns if c != "text"]
    d = docs.select(deal.alias("block"), docs["doc_id"].cast("long").alias("id"), docs["text"].alias("text"), F.struct(*rest).alias("row"))
    parts = max(1, min(n, max(_parts(docs), n // 16)))  # a task has 16 blocks at most on average
    d = d.repartition(parts, "block")
    # all three passes take the same columns, so that one exchange of the texts serves them all
    index = d.groupBy("block").applyInArrow(_index, _INDEX)
    spans = index.repartition(parts, "a").sortWithinPartitions("a", "s", "lo").mapInArrow(_groups(0), _VERDICT)
    windows = d.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_boundaries, _INDEX)
    single = windows.repartition(parts, "a", "s").sortWithinPartitions("a", "s", "lo").mapInArrow(_groups(1), _VERDICT)
    schema = T.StructType([d.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), SPANS, T.StructField("text", T.StringType())])
    out = d.groupBy("block").cogroup(spans.unionByName(single).groupBy("block")).applyInArrow(lambda t, v: _with_text(t, v, keep_space), schema)
    order = [F.col("text") if c == "text" else F.col("row")[c] for c in docs.columns]
    return out.select(F.struct(*(c.alias(n) for c, n in zip(order, docs.columns))).alias("row"), "n_words", "n_removed", "kept_text", "spans")


def _with_text(table: pa.Table, verdicts: pa.Table, keep_space: bool) -> pa.Table:
    if not table.num_rows:
        return pa.table({"row": table.column("row"), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string()), "spans": pa.array([], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), "text": table.column("text")})
    return _strip(table, verdicts, keep_space).append_column("text", table.column("text"))


def _parts(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
