"""Best documents of many questions by shared tokens, ranked where the documents are (inventory R15, C5, W2).

Questions' tokens, when there are at most MOST of them, go to the tasks as an inverted index; each task scores
its documents a few at a time (WORDS words, PENDING scores) and returns the k best a question, so that no pair of a question and a
document is shuffled however common its tokens are. `fits` says whether that is possible.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST, CELLS, PENDING, WORDS = 2_000_000, 1 << 17, 1 << 18, 1 << 18


def pieces(batch: pa.RecordBatch, column: int, words: int):
    """The batch in runs of rows whose lists have at most `words` elements together, or single rows."""
    ends = batch.column(column).offsets.to_numpy()
    first = 0
    while first < batch.num_rows:
        end = max(first + 1, int(np.searchsorted(ends, ends[first] + words, "right")) - 1)
        yield batch.slice(first, end - first)
        first = end


def fits(asked: DataFrame, most: int = MOST) -> bool:
    """Whether the rows of asked (qid, t) are few enough to go to the tasks."""
    return asked.limit(most + 1).count() <= most


class Index:
    """The questions of each token: `of[start[i]:start[i + 1]]` are those of tokens[i], numbers into qids."""

    def __init__(self, asked: DataFrame):
        table = asked.select("qid", "t").toArrow().combine_chunks()
        q, t = (table.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("qid", "t"))
        self.qids, self.tokens = q.dictionary, t.dictionary
        qn, tn = (x.indices.to_numpy().astype(np.int64) for x in (q, t))
        self.of = qn[np.argsort(tn, kind="stable")]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(tn, minlength=len(self.tokens)))]).astype(np.int64)

    def hits(self, words: pa.Array) -> tuple[np.ndarray, ...]:
        """(row, token, times, length of each row) of the known tokens in an array of token lists, by row."""
        sizes = np.diff(words.offsets.to_numpy())
        code = pc.fill_null(pc.index_in(words.flatten(), value_set=self.tokens), -1).to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)[code >= 0]
        key, times = np.unique(row * max(1, len(self.tokens)) + code[code >= 0], return_counts=True)
        return key // max(1, len(self.tokens)), key % max(1, len(self.tokens)), times, sizes

    def sums(self, row: np.ndarray, token: np.ndarray, weight: np.ndarray, rows: int):
        """Yields (row, question, sum) of all pairs that share a token, for a few rows at a time."""
        n = len(self.qids)
        step = max(1, CELLS // max(1, n))
        for first in range(0, rows, step):
            s, e = np.searchsorted(row, [first, first + step])
            if s == e:
                continue
            begin, count = self.start[token[s:e]], self.start[token[s:e] + 1] - self.start[token[s:e]]
            at = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
            cell = np.repeat(row[s:e] - first, count) * n + self.of[at]
            total = np.bincount(cell, np.repeat(weight[s:e], count), step * n)
            found = np.flatnonzero(np.bincount(cell, minlength=step * n))
            yield first + found // n, found % n, total[found]


def counts(docs: DataFrame, index) -> tuple[int, float, np.ndarray]:
    """(documents, mean length, documents with each token) of docs (id, w), summed in the tasks first."""

    words = WORDS

    def run(batches):
        n = length = 0
        df = np.zeros(len(index.value.tokens), np.int64)
        for batch in (piece for whole in batches for piece in pieces(whole, 0, words)):
            _, token, _, sizes = index.value.hits(batch.column(0))
            n, length = n + len(sizes), length + int(sizes.sum())
            df += np.bincount(token, minlength=len(df))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *seen.tolist()], pa.int64()), pa.array([n, length, *df[seen].tolist()], pa.int64())], names=["t", "n"])

    got = {r["t"]: r["n"] for r in docs.select("w").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}
    n = got.get(-1, 0)
    df = np.array([got.get(i, 0) for i in range(len(index.value.tokens))], np.float64)
    return n, got.get(-2, 0) / n if n else 0.0, df


def best(docs: DataFrame, index, k: int, weigh, kind: str) -> DataFrame:
    """(qid, id, score): the k best of each task's docs (id, w) for each question of the broadcast index.

    A document's score is the sum of weigh(token, times, length) over the tokens shared, rounded to 6
    places; ties go to the smaller id. `kind` is the type of qid.
    """

    def pick(q, score, ids) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        t = pa.table({"q": pa.array(q), "s": pa.array(score), "id": ids})
        t = t.take(pc.sort_indices(t, sort_keys=[("q", "ascending"), ("s", "descending"), ("id", "ascending")], null_placement="at_start"))
        q, score = t.column("q").to_numpy(), t.column("s").to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = np.flatnonzero(place < k)
        floor = np.full(len(index.value.qids), -np.inf)
        last = place == k - 1
        floor[q[last]] = score[last]
        return q[keep], score[keep], t.column("id").combine_chunks().take(pa.array(keep)), floor

    most, words = PENDING, WORDS

    def run(batches):
        held: list[tuple] = []
        pending, floor = 0, np.full(len(index.value.qids), -np.inf)

        def squeezed():
            q, score, ids, low = pick(*(np.concatenate(c) for c in list(zip(*held))[:2]), pa.concat_arrays([h[2] for h in held]))
            return [(q, score, ids)], len(q), low

        for batch in (piece for whole in batches for piece in pieces(whole, 1, words)):
            row, token, times, sizes = index.value.hits(batch.column(1))
            for at, q, total in index.value.sums(row, token, weigh(token, times, sizes[row]), len(sizes)):
                score = np.round(total, 6)
                ok = score >= floor[q]
                held.append((q[ok], score[ok], batch.column(0).take(pa.array(at[ok]))))
                pending += int(ok.sum())
                if pending > most:
                    held, kept, floor = squeezed()
                    pending = min(kept, most // 2)  # where k a question are many, squeeze after as many again
        if held:
            held, _, _ = squeezed()
            q, score, ids = held[0]
            yield pa.RecordBatch.from_arrays([index.value.qids.take(pa.array(q)), ids, pa.array(score)], names=["qid", "id", "score"])

    return docs.select("id", "w").mapInArrow(run, f"qid {kind}, id {docs.schema['id'].dataType.simpleString()}, score double")
