"""Operator 7, quality rules: a decision list learned by sequential covering.

Text statistics are computed from whole texts, a bounded sample of labelled rows trains an ordered
list of threshold conjunctions (each rule grown on two thirds and pruned on one third of what no
earlier rule covers), and the list is applied as one Spark CASE expression over the statistics.

Defined cases: a null or empty text has no words, so the base rule rejects it; rows that repeat get
the same verdict each; a null doc_id matches no label but is judged like any other row; without
labelled rows of both kinds no rule is learned and the base rule alone decides; other columns,
whatever their names, are kept and never read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import textvec as V

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits", "n_lines")
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?"


def _table(members: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


_SYMBOL, _MARK = _table(SYMBOLS), _table(MARKS)
_UPPER, _DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(48, 58)))
_HEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)])


def _duplicate_lines(text: str) -> tuple[int, int]:
    """(lines with a word that equal an earlier line, lines with a word)"""
    seen: set[str] = set()
    again = n = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            n += 1
            if line in seen:
                again += 1
            else:
                seen.add(line)
    return again, n


def stats_of(texts: pa.Array) -> pa.Array:
    """STATS of each text as an array of structs."""
    parts: list[np.ndarray] = []
    for a, b, raw, offsets in V.chunks(texts):
        w = V.words(raw, offsets)
        out = np.zeros((b - a, len(STATS)), np.int64)
        out[:, 0] = w.counts
        out[:, 1] = V.sums(_HEAD[raw] & ~V.SPACE[raw], offsets)
        for k, table in ((2, _SYMBOL), (5, _UPPER), (6, _MARK), (7, _DIGIT)):
            out[:, k] = V.sums(table[raw], offsets)
        at = V.starts_of_ngrams(w, 3)
        if len(at):
            h = V.ngram_hashes(V.word_hashes(w), 3)[at] ^ V.mix(w.text[at].astype(np.uint64))
            order = np.sort(h)
            twice = np.unique(order[1:][order[1:] == order[:-1]])
            if len(twice):
                near = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
                out[:, 4] = V.sums(V.covered(at[twice[near] == h], 3, len(w.start)), w.first)
        body = raw.tobytes()
        for i in range(b - a):
            out[i, 3], out[i, 8] = _duplicate_lines(body[offsets[i] : offsets[i + 1]].decode("utf-8", "replace"))
        parts.append(out)
    V.release()
    all_ = np.concatenate(parts) if parts else np.zeros((0, len(STATS)), np.int64)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(all_[:, k])) for k in range(len(STATS))], list(STATS))


STATS_TYPE = T.StructType([T.StructField(n, T.LongType()) for n in STATS])


def stats(text: Column) -> Column:
    """A struct column of STATS of the whole text."""

    @F.arrow_udf(STATS_TYPE)
    def text_stats(t: pa.Array) -> pa.Array:
        return stats_of(t)

    return text_stats.asNondeterministic()(text)


def features(s: Column) -> dict[str, Column]:
    """What rules may test: shares that depend neither on the length of the text nor on its language. No text: 0."""
    words = F.greatest(s["n_words"], F.lit(1)).cast("double")
    chars = F.greatest(s["word_chars"], F.lit(1)).cast("double")
    return {
        "symbols_per_word": s["n_symbols"] / words,
        "repeat_share": s["n_repeat_words"] / words,
        "duplicate_line_share": s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1)).cast("double"),
        "upper_share": s["n_upper"] / chars,
        "marks_per_word": s["n_marks"] / words,
        "digit_share": s["n_digits"] / chars,
    }


@dataclass
class DecisionList:
    """Rules in order; each is a conjunction of (feature, '<=' or '>', threshold) that rejects."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)

    def keep(self, cols: dict[str, Column]) -> Column:
        """CASE WHEN rule 1 THEN false WHEN rule 2 THEN false ... ELSE true."""
        verdict: Column | None = None
        for rule in self.rules:
            hit = F.lit(True)
            for name, op, x in rule:
                hit = hit & (cols[name] <= F.lit(x) if op == "<=" else cols[name] > F.lit(x))
            verdict = F.when(hit, False) if verdict is None else verdict.when(hit, False)
        return F.lit(True) if verdict is None else verdict.otherwise(True)


def base_failed(s: Column) -> Column:
    """Under 50 words, or over half of them in repeated three-word windows."""
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def tidy(rule: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """The rule with one bound for each feature and side, the tightest."""
    out: dict[tuple[str, str], float] = {}
    for name, op, t in rule:
        out[name, op] = (min if op == "<=" else max)(out.get((name, op), t), t)
    return [(name, op, t) for (name, op), t in out.items()]


def _hits(x: np.ndarray, names: list[str], rule) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for name, op, t in rule:
        v = x[:, names.index(name)]
        ok &= v <= t if op == "<=" else v > t
    return ok


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], cuts: int, most: int) -> list[tuple[str, str, float]]:
    rule: list[tuple[str, str, float]] = []
    live = np.ones(len(x), bool)
    while len(rule) < most and (live & ~bad).any():
        p, n = (live & bad).sum(), (live & ~bad).sum()
        base, best = np.log2(p / (p + n)), (0.0, None)
        for k, name in enumerate(names):
            v = x[live, k]
            points = np.unique(np.quantile(v, np.linspace(0, 1, cuts + 1), method="lower"))[:-1]
            above = np.unique(v)
            for t in points:
                up = above[np.searchsorted(above, t, "right")] if t < above[-1] else t
                mid = float((t + up) / 2)
                low = v <= mid
                for op, hit in (("<=", low), (">", ~low)):
                    ph, nh = (bad[live] & hit).sum(), (~bad[live] & hit).sum()
                    if ph and (gain := ph * (np.log2(ph / (ph + nh)) - base)) > best[0] + 1e-9:
                        best = (gain, (name, op, mid))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= _hits(x, names, rule[-1:])
    return rule


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], *, precision: float = 0.95, support: int = 5, cuts: int = 48, most: int = 4) -> DecisionList:
    """Sequential covering: grow a rule, prune its tail on the held third, keep it while it is precise."""
    out = DecisionList()
    left = np.ones(len(x), bool)
    third = np.arange(len(x)) % 3 == 2
    for _ in range(40):
        grow, prune = left & ~third, left & third
        if (grow & bad).sum() < support or not (grow & ~bad).any():
            break
        rule = _grow(x[grow], bad[grow], names, cuts, most)
        if not rule:
            break

        def worth(r):
            hit = _hits(x, names, r) & prune
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            return (p - n) / max(1, p + n)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = _hits(x, names, rule) & left
        if (hit & bad).sum() < support or (hit & bad).sum() < precision * hit.sum():
            break
        out.rules.append(tidy(rule))
        left &= ~hit
    return out


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 12_000, **how) -> DecisionList:
    """Learn from at most `sample` labelled rows that pass the base rule, in the order of a hash of their doc_id.

    The sample's bound lets its labels be broadcast and its statistics come to the driver.
    """
    some = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").alias("_label")).orderBy(F.xxhash64("doc_id"), "_label").limit(sample)
    d = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "_label", stats(F.col("text")).alias("s"))
    cols = features(F.col("s"))
    d = d.where(~base_failed(F.col("s")))
    rows = d.select("doc_id", "_label", *(c.alias(n) for n, c in cols.items())).orderBy(F.xxhash64("doc_id"), "_label", *cols).limit(sample).collect()
    names = list(cols)
    x = np.array([[r[n] for n in names] for r in rows], float).reshape(len(rows), len(names))
    return learn(x, np.array([r["_label"] == 0 for r in rows], bool), names, **how)


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """docs' columns in a struct `row`, the statistics `s`, base_failed and kept."""
    s = F.col("s")
    base = base_failed(s)
    d = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), stats(docs["text"]).alias("s"))
    return d.select("row", "s", base.alias("base_failed"), (~base & rules.keep(features(s))).alias("kept"))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    s = F.col("s")
    return judge(docs, fit(docs, labels)).select(F.col("row.doc_id").alias("doc_id"), *(s[n].alias(n) for n in STATS[:5]), "base_failed", "kept")
