"""Operator 2, toxicity by compression distance between two zstandard dictionaries.

A bounded sample of labelled rows trains one dictionary on ordinary text and one on toxic text: both
hold the ordinary sample's most frequent words, and the toxic one, in place of the rarer of these,
the passages that toxic rows have far more often than ordinary ones. Every word of every whole text,
set between a fixed lead and tail, is a window; what the toxic dictionary saves of its compressed
length says how toxic it is. A document's largest savings and how many windows pass the threshold
are turned into a probability whose weights are calibrated on labelled rows the dictionaries haven't
seen. Lower-cased words recur, so each task compresses a word once. Windows of several words and
dictionaries made by the library's trainer find fewer toxic texts (figures: README).

The bounds of the sample are parameters of fit(): rows of each label, and bytes of a training text.

Defined cases: very long texts and words are read whole when they are scored; null and empty texts have no windows and get the score of a text without savings; rows
that repeat score alike; a null doc_id is never a training row and is held out as its text form "";
null labels are left out; without labelled rows of both kinds every score is 0.01; other columns,
labels, language and source are never inputs of a score.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import textvec as V

FOLDS = 5
LEAD = bytes([*range(1, 9), 11, 12, 14, 15, 16, 17, 18, 19])
TAIL = bytes(range(20, 29))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    threshold: int
    level: int = 6


def _compressor(content: bytes, level: int):
    import zstandard as Z

    d = Z.ZstdCompressionDict(content, dict_type=Z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    p = Z.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False, format=Z.FORMAT_ZSTD1_MAGICLESS, min_match=4)
    return Z.ZstdCompressor(dict_data=d, compression_params=p)


class Savings:
    """Bytes the toxic dictionary saves on each word, with a bounded cache."""

    def __init__(self, model: Model, most: int = 200_000):
        self.plain, self.toxic = _compressor(model.ordinary, model.level), _compressor(model.toxic, model.level)
        self.most = most
        self.cache: dict[int, int] = {}

    def of(self, word: bytes) -> int:
        window = LEAD + b" " + word + b" " + TAIL
        return len(self.plain.compress(window)) - len(self.toxic.compress(window))

    def words(self, w: V.Words) -> np.ndarray:
        if not len(w.start):
            return np.zeros(0, np.int64)
        coded = pa.array(V.word_hashes(w)).dictionary_encode()
        which = coded.indices.to_numpy()
        keys = coded.dictionary.to_pylist()
        if len(self.cache) + len(keys) > self.most:
            self.cache.clear()
        first = np.zeros(len(keys), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        raw = w.raw.tobytes()
        for k, j in zip(keys, first.tolist()):
            if k not in self.cache:
                self.cache[k] = self.of(raw[w.start[j] : w.end[j]])
        return np.array([self.cache[k] for k in keys], np.int64)[which]


def features_of(texts: pa.Array, savings: Savings, threshold: int) -> np.ndarray:
    """Of each text: constant, largest saving, second largest, log of windows past the threshold, log of windows."""
    out = []
    for a, b, raw, offsets in V.chunks(texts):
        w = V.words(_LOWER[raw], offsets)
        got = savings.words(w)
        x = np.zeros((b - a, 5))
        x[:, 0] = 1
        has = np.flatnonzero(w.counts)
        if len(has):
            top = np.maximum.reduceat(got, w.first[has])
            x[has, 1] = np.minimum(top, 9)
            rest = got.copy()
            order = np.lexsort((-got, w.text))
            rest[order[w.first[has]]] = -99  # one largest of each text
            second = np.maximum.reduceat(rest, w.first[has])
            x[has, 2] = np.clip(second, 0, 9)
            x[has, 3] = np.log1p(V.sums(got >= threshold, w.first)[has])
            x[has, 4] = np.log1p(w.counts[has])
        out.append(x)
    V.release()
    return np.concatenate(out) if out else np.zeros((0, 5))


def _passages(text: bytes, n: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(the words, single spaces around each; starts of n-byte passages inside one word and its spaces; their hashes)"""
    padded = b" " + b" ".join(text.split()) + b" "
    raw = np.frombuffer(padded, np.uint8)
    m = len(raw) - n + 1
    if m <= 0:
        return padded, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    spaces = np.concatenate([[0], np.cumsum(raw == 32)])
    at = np.flatnonzero(spaces[n - 1 : m + n - 1] == spaces[1 : m + 1])
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        h += raw[at + j].astype(np.uint64) * V._PLACE[j]
    return padded, at, V.mix(h)


def _spans(text: bytes, telling: np.ndarray, n: int) -> set[bytes]:
    """Maximal runs of telling n-byte passages."""
    padded, at, h = _passages(text, n)
    at = at[np.isin(h, telling)]
    if not len(at):
        return set()
    first = np.flatnonzero(np.append(True, np.diff(at) != 1))
    last = np.append(first[1:], len(at)) - 1
    return {padded[i : j + n] for i, j in zip(at[first].tolist(), at[last].tolist())}


def dictionaries(toxic: list[bytes], plain: list[bytes], *, size: int = 8192, grams: tuple[int, ...] = (5, 7, 9), ratio: float = 8.0, share: float = 0.02) -> tuple[bytes, bytes]:
    """Contents of the ordinary and of the toxic dictionary.

    A passage of `grams` bytes tells if at least `share` of the toxic texts (and 4) have it, `ratio`
    times as often as ordinary ones; the runs of telling passages inside words make the toxic part.
    """
    nt, no = len(toxic), len(plain)
    least = max(min(4, nt), share * nt)
    spans: Counter[bytes] = Counter()
    for n in grams:
        seen, times = np.unique(np.concatenate([np.unique(_passages(x, n)[2]) for x in toxic]), return_counts=True)
        seen, times = seen[times >= least], times[times >= least]
        other = np.zeros(len(seen), np.int64)
        for x in plain:
            other += np.isin(seen, _passages(x, n)[2])
        telling = seen[times / nt >= ratio * (other + 1) / no]
        for x in toxic:
            spans.update(_spans(x, telling, n))
    keep = [s for s, c in sorted(spans.items(), key=lambda p: (-p[1], p[0]))[:300] if c >= least / 2]
    own = b"".join(reversed(keep))[-size // 2 :]
    freq: Counter[bytes] = Counter()
    for x in plain:
        freq.update(x.split())
    common = [b" " + w + b" " for w, _ in sorted(freq.items(), key=lambda p: (-p[1], p[0]))[:size]]
    base = b"".join(reversed(common[: size // 6]))[-size:]
    rarer = b"".join(common[size // 6 :])[: len(own)]
    return rarer + base + LEAD, base + own + LEAD


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: list[str], toxic: list[int]) -> Model:
    """Dictionaries from two thirds of the rows, thresholds and weights from the last third."""
    lowered = [_LOWER[np.frombuffer((t or "").encode(), np.uint8)].tobytes() for t in texts]
    y = np.array(toxic)
    part = np.zeros(len(y), int)
    for label in (0, 1):
        at = np.flatnonzero(y == label)
        part[at] = np.arange(len(at)) % 3
    build, hold = part < 2, part == 2
    if not (y[build] == 1).any() or not (y[build] == 0).any():
        return Model(LEAD, LEAD, (-4.6, 0.0, 0.0, 0.0, 0.0), 4)
    plain, own = dictionaries([lowered[i] for i in np.flatnonzero(build & (y == 1))], [lowered[i] for i in np.flatnonzero(build & (y == 0))])
    best = None
    rows = np.flatnonzero(hold) if len(set(y[hold])) == 2 else np.arange(len(y))
    table = pa.array([texts[i] for i in rows], pa.string())
    savings = Savings(Model(plain, own, (), 0))
    for threshold in (3, 4, 5, 6):
        x = features_of(table, savings, threshold)
        w = _logistic(x, y[rows])
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-6, 1 - 1e-6)
        loss = -(y[rows] * np.log(p) + (1 - y[rows]) * np.log(1 - p)).sum()
        if best is None or loss < best[0] - 1e-9:
            best = (loss, threshold, w)
    return Model(plain, own, tuple(float(v) for v in best[2]), best[1])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, *, per_label: tuple[int, int] = (4500, 2500), most_bytes: int = 20_000) -> Model:
    """Train on at most per_label[k] rows of label k that aren't held out and have at most most_bytes bytes,
    in the order of a hash of doc_id."""
    some = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("_y")).distinct()
    some = some.join(docs.where(F.octet_length("text") <= most_bytes).select("doc_id").distinct(), "doc_id", "left_semi")  # labels without a usable text take no place
    picked = None
    for k in (0, 1):
        part = some.where(F.col("_y") == k).orderBy(F.xxhash64("doc_id")).limit(per_label[k] * 2)
        picked = part if picked is None else picked.unionByName(part)
    d = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where(F.octet_length("text") <= most_bytes)
    texts, y = [], []
    for k in (0, 1):
        for r in d.where(F.col("_y") == k).orderBy(F.xxhash64("doc_id"), "text").limit(per_label[k]).select("text").collect():
            texts.append(r[0])
            y.append(k)
    return train(texts, y)


def score(text: Column, model: Model) -> Column:
    held: list[Savings] = []

    @F.arrow_udf(T.DoubleType())
    def toxicity(t: pa.Array) -> pa.Array:
        if not held:
            held.append(Savings(model))
        x = features_of(t, held[0], model.threshold)
        return pa.array(1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30))))

    return toxicity(text)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
