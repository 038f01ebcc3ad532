"""Substring joins (inventory J7, J8, A26): which terms occur in which texts.

A `contains` join has no equality key. Terms are compiled to an automaton that reads each text once.
A set of at most BROADCAST_TERMS terms is collected (its size is checked first) and sent to the tasks;
a larger one is cut into blocks that are joined with parts of the texts by an equality on the block.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_TERMS = 50_000


def _automaton(terms: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for t in terms:
        if t:
            a.add_word(t, t)
    a.make_automaton()
    return a


def _found(a, texts: list[str | None]) -> tuple[list[int], list[str]]:
    at, term = [], []
    if len(a):
        for i, t in enumerate(texts):
            for x in {x for _, x in a.iter(t)} if t else ():
                at.append(i)
                term.append(x)
    return at, term


def contains_pairs(texts: DataFrame, terms: DataFrame, *, most: int = BROADCAST_TERMS) -> DataFrame:
    """(id, term), once each, where texts (id, text) contains terms (term). Null and empty terms match nothing."""
    terms = terms.select("term").where("term <> ''").distinct()
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, term string"
    few = terms.limit(most + 1).collect()
    if len(few) <= most:
        words = [r["term"] for r in few]

        def run(batches):
            a = _automaton(words)
            for b in batches:
                at, term = _found(a, b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(term, pa.string())], names=["id", "term"])

        return texts.select("id", "text").mapInArrow(run, schema)
    n_blocks = -(-terms.count() // most)
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(parts))
    left = texts.select("id", "text", part.alias("p")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    right = terms.withColumn("b", F.pmod(F.xxhash64("term"), F.lit(n_blocks))).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def both(t: pa.Table, w: pa.Table) -> pa.Table:
        at, term = _found(_automaton(w.column("term").to_pylist()), t.column("text").to_pylist()) if t.num_rows and w.num_rows else ([], [])
        return pa.table({"id": t.column("id").take(pa.array(at, pa.int64())), "term": pa.array(term, pa.string())})

    return left.groupBy("p", "b").cogroup(right.groupBy("p", "b")).applyInArrow(both, schema)
