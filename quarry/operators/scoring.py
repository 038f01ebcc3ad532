"""Best chunks of many questions by what the chunks hold, scored where the chunks are (inventory R10, R11, R15).

What questions ask for goes to the tasks when it is little enough (`few`); each task reads a text once, scores
it for all questions and returns only those of its chunks that can be chosen. No pair of a question and a
chunk, and no copy of a text, is shuffled, however common a name is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quarry.operators.contains import BROADCAST_TERMS
from quarry.operators.postings import CELLS, MOST

PENDING, ROWS = 1 << 18, 1024


def few(*tables: DataFrame, terms: int = BROADCAST_TERMS, most: int = MOST) -> list[pa.Table] | None:
    """The tables collected, if each has at most `most` rows and those with a column `t` at most `terms` of its values in all."""
    got, seen = [], set()
    for d in tables:
        got.append(d.limit(most + 1).toArrow().combine_chunks())
        if got[-1].num_rows > most:
            return None
        if "t" in d.columns:
            seen.update(got[-1].column("t").to_pylist())
    return got if len(seen) <= terms else None


class Links:
    """The numbers that each number stands for: `of[start[i]:start[i + 1]]` for i; pairs with a -1 count for nothing."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: int):
        a, b = a[(a >= 0) & (b >= 0)], b[(a >= 0) & (b >= 0)]
        self.of = b[np.argsort(a, kind="stable")]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]).astype(np.int64)

    def __call__(self, row: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, count = self.start[a], self.start[a + 1] - self.start[a]
        at = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
        return np.repeat(row, count), self.of[at]


def numbers(values: pa.ChunkedArray | pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each value among the known ones, -1 for others."""
    return pc.fill_null(pc.index_in(values, value_set=known), -1).to_numpy().astype(np.int64)


class Wanted:
    """The questions (numbers into qids) that ask for each term of a table (qid, t)."""

    def __init__(self, table: pa.Table, qids: pa.Array):
        self.terms = pc.unique(table.column("t"))
        self.links = Links(numbers(table.column("t"), self.terms), numbers(table.column("qid"), qids), len(self.terms))


def occurring(automaton, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of each of the automaton's terms (numbered) in each text, once."""
    found = [{x for _, x in automaton.iter(t)} if t else () for t in texts] if len(automaton) else [()] * len(texts)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.repeat(np.arange(len(found)), sizes), np.fromiter((x for f in found for x in f), np.int64, int(sizes.sum()))


def numbered(terms: list[str]):
    """An automaton that finds the terms' numbers; empty terms are never found."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        if t:
            a.add_word(t, i)
    a.make_automaton()
    return a


def dense(rows: int, n: int, row: np.ndarray, q: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row * n + q, weight, rows * n).reshape(rows, n)


class Best:
    """Of (question, page, id, score), what can be among the `most` best of a question with at most `per_page` of a page.

    Of each page the per_page best are kept and of these the `most` best, so that what is left over after any
    number of steps has all that the whole would choose: what pushes a row out here is either chosen itself or
    stands behind better rows of its page. Ties go to the smaller id.
    """

    def __init__(self, n: int, most: int, per_page: int | None, pending: int):
        self.most, self.per_page = most, per_page
        self.held: list[pa.Table] = []
        self.most_pending = pending
        self.pending, self.floor = 0, np.full(n, -np.inf)

    def add(self, q: np.ndarray, score: np.ndarray, rows: np.ndarray, ids: pa.Array, pages: pa.Array) -> None:
        ok = score >= self.floor[q]
        at = pa.array(rows[ok])
        self.held.append(pa.table({"q": pa.array(q[ok]), "score": pa.array(score[ok]), "id": ids.take(at), "page": pages.take(at)}))
        self.pending += int(ok.sum())
        if self.pending > self.most_pending:
            self.pending = min(self.squeeze().num_rows, self.most_pending // 2)

    def squeeze(self) -> pa.Table:
        t = pa.concat_tables(self.held).combine_chunks()
        t = t.append_column("p", t.column("page").combine_chunks().dictionary_encode(null_encoding="encode").indices)
        if self.per_page is not None:
            t = self._first(t, ["q", "p"], self.per_page)
        t = self._first(t, ["q"], self.most)
        q, score = t.column("q").to_numpy(), t.column("score").to_numpy()
        last = np.arange(len(q)) - np.searchsorted(q, q) == self.most - 1
        self.floor[q[last]] = score[last]
        self.held = [t.drop_columns(["p"])]
        return self.held[0]

    @staticmethod
    def _first(t: pa.Table, by: list[str], n: int) -> pa.Table:
        order = pc.sort_indices(t, sort_keys=[*((c, "ascending") for c in by), ("score", "descending"), ("id", "ascending")], null_placement="at_start")
        t = t.take(order)
        new = np.ones(t.num_rows, bool)
        new[1:] = np.any([(c := t.column(b).to_numpy())[1:] != c[:-1] for b in by], axis=0) if t.num_rows else new[1:]
        first = np.flatnonzero(new)
        place = np.arange(t.num_rows) - np.repeat(first, np.diff(np.append(first, t.num_rows)))
        return t.filter(pa.array(place < n))


def best(df: DataFrame, told, scores, most: int, per_page: int | None = None) -> DataFrame:
    """(qid, id, page, score): what each task's rows of df (id, page, ...) leave of `Best`, by scores.

    `told` is broadcast and has qids; scores(told, cells) gives a function of a batch of df that yields (first row,
    score, chosen), the latter two of rows by questions.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    qkind = told.value.kind

    pending, rows, cells = PENDING, ROWS, CELLS

    def run(batches):
        of = scores(told.value, cells)
        out = Best(len(told.value.qids), most, per_page, pending)
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                for first, score, chosen in of(batch):
                    row, q = np.nonzero(chosen)
                    out.add(q, score[row, q], row + first, batch.column("id"), batch.column("page"))
        if out.held:
            t = out.squeeze()
            q = told.value.qids.take(t.column("q").combine_chunks())
            yield pa.RecordBatch.from_arrays([q, *(t.column(c).combine_chunks() for c in ("id", "page", "score"))], names=["qid", "id", "page", "score"])

    return df.mapInArrow(run, f"qid {qkind}, id {kinds['id']}, page {kinds['page']}, score double")


def steps(rows: int, n: int, cells: int):
    """(first, end) of runs of rows whose pairs with n questions are at most `cells`, or single rows."""
    step = max(1, cells // max(1, n))
    for first in range(0, rows, step):
        yield first, min(rows, first + step)


def between(row: np.ndarray, what: np.ndarray, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs ordered by row those of rows first to end, counted from first."""
    s, e = np.searchsorted(row, [first, end])
    return row[s:e] - first, what[s:e]


# --- R10 ------------------------------------------------------------------------------------------

class Anchored:
    """What R10 looks for: names of seeds (t, id), seeds (qid, id), anchors (qid, page, s), keywords and tokens (qid, t)."""

    def __init__(self, kind: str, qids: pa.Array, names: pa.Table, seed: pa.Table, anchors: pa.Table, kws: pa.Table, asked: pa.Table, whole: int):
        self.kind, self.qids, n = kind, qids, len(qids)
        keys = pc.unique(names.column("t"))
        ids = pc.unique(names.column("id"))
        self.long = [k if len(k) >= whole else "" for k in keys.to_pylist()]
        self.short = {k: i for i, k in enumerate(keys.to_pylist()) if len(k) < whole}
        self.entities = Links(numbers(names.column("t"), keys), numbers(names.column("id"), ids), len(keys))
        self.n_entities = len(ids)
        self.seeds = Links(numbers(seed.column("id"), ids), numbers(seed.column("qid"), qids), len(ids))
        self.pages = pc.unique(anchors.column("page"))
        self.anchor_q, self.anchor_s = numbers(anchors.column("qid"), qids), anchors.column("s").to_numpy().astype(float)
        self.anchors = Links(numbers(anchors.column("page"), self.pages), np.where(self.anchor_q < 0, -1, np.arange(anchors.num_rows)), len(self.pages))
        self.kws, self.asked, self.n = Wanted(kws, qids), Wanted(asked, qids), n


def anchored_scores(w: Anchored, cells: int):
    """R10's scores of batches (id, page, c: letters and digits of the text, short: its short tokens)."""
    sets = (w.long, w.kws.terms.to_pylist(), w.asked.terms.to_pylist())
    code: dict[str, int] = {}
    for t in (t for s in sets for t in s):
        code.setdefault(t, len(code))
    numbers_of = [np.full(len(code), -1) for _ in sets]
    for to, s in zip(numbers_of, sets, strict=True):
        to[[code[t] for t in s]] = np.arange(len(s))
    if "" in code:
        for to in numbers_of:
            to[code[""]] = -1
    automaton = numbered(list(code))

    def of(batch: pa.RecordBatch):
        row, term = occurring(automaton, batch.column("c").to_pylist())
        name, kw, word = ((row[(x := to[term]) >= 0], x[x >= 0]) for to in numbers_of)
        if w.short:
            lists = batch.column("short")
            at = [(i, w.short[t]) for i, ts in enumerate(lists.to_pylist()) for t in set(ts or ()) if t in w.short]
            name = tuple(np.concatenate([a, np.array(b, np.int64)]) for a, b in zip(name, zip(*at) if at else ((), ()), strict=True))
        r, e = w.entities(*name)
        key = np.unique(r * max(1, w.n_entities) + e)
        seeds = w.seeds(key // max(1, w.n_entities), key % max(1, w.n_entities))
        page = numbers(batch.column("page"), w.pages)
        anchors = w.anchors(np.flatnonzero(page >= 0), page[page >= 0])
        kws, words = w.kws.links(*kw), w.asked.links(*word)
        for first, end in steps(batch.num_rows, w.n, cells):
            count = lambda x: dense(end - first, w.n, *between(*x, first, end))  # noqa: B023, E731
            hits = count(seeds)
            r, a = between(*anchors, first, end)
            near = dense(end - first, w.n, r, w.anchor_q[a], w.anchor_s[a])
            yield first, np.minimum(hits * 5.0, 10.0) + near + 1.5 * np.minimum(count(kws), 4) + 0.25 * np.minimum(count(words), 8), (hits > 0) | (near > 0)

    return of


# --- R15 ------------------------------------------------------------------------------------------

class Matched:
    """What R15 looks for: kept entities (qid, id), keywords and tokens (qid, t)."""

    def __init__(self, kind: str, qids: pa.Array, kept: pa.Table, kws: pa.Table, asked: pa.Table):
        self.kind, self.qids, self.n = kind, qids, len(qids)
        self.ids = pc.unique(kept.column("id"))
        self.kept = Links(numbers(kept.column("id"), self.ids), numbers(kept.column("qid"), qids), len(self.ids))
        self.kws, self.asked = Wanted(kws, qids), Wanted(asked, qids)


def matched_scores(w: Matched, cells: int):
    """R15's scores of batches (id, page, ids: its entities, words: its distinct tokens, low: the text in lower case)."""
    automaton = numbered(w.kws.terms.to_pylist())

    def of(batch: pa.RecordBatch):
        def hits(column: str, known: pa.Array):
            lists = batch.column(column)
            row, x = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), numbers(lists.flatten(), known)
            return row[x >= 0], x[x >= 0]

        kept, words = w.kept(*hits("ids", w.ids)), w.asked.links(*hits("words", w.asked.terms))
        kws = w.kws.links(*occurring(automaton, batch.column("low").to_pylist()))
        for first, end in steps(batch.num_rows, w.n, cells):
            count = lambda x: dense(end - first, w.n, *between(*x, first, end))  # noqa: B023, E731
            yield first, (count(words) + 2 * count(kws)).astype(float), count(kept) > 0

    return of
