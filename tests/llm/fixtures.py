"""A small table of documents with the cases that the operators must handle."""

from __future__ import annotations

import random


def documents(n=160, seed=3):
    r = random.Random(seed)
    vocab = [a + b for a in ("ka", "lo", "mi", "tu", "ré", "so", "vë") for b in ("na", "ri", "sto", "", "x", "ße")]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared = [say(60), say(14), say(13), say(12), say(200)]
    rows = []
    for i in range(n):
        text = say(r.choice([1, 2, 5, 12, 13, 14, 40, 150]))
        for _ in range(r.choice([0, 0, 1, 2])):
            p = r.choice(shared).split()
            a = r.randrange(max(1, len(p) - 20))
            text += r.choice([" ", "\n", "\t", "  "]) + " ".join(p[a : a + r.choice([13, 20, 100])]) + " " + say(r.choice([0, 1, 6]))
        if i % 17 == 0 and rows:
            text = rows[r.randrange(len(rows))][1]
        if i % 19 == 0 and rows and rows[-1][1]:
            text = rows[-1][1] + " ende"
        rows.append((i * 3, text, r.choice(["en", "fr"]), r.choice(["b", "a", "ä", None, "src0"])))
    rows += [(1001, None, "en", "a"), (1002, "", "en", "a"), (1003, " \n\t ", None, None), (None, shared[0] + " " + say(30), "en", "b"), (1004, say(30_000), "en", "src0")]
    rows += [(1005, shared[0], "en", "a"), (1005, shared[0], "en", "a"), (1006, "LO### ka*** " * 40, "en", "b"), (1007, "Same line here\n" * 30, "en", "b"), (2, shared[4], "en", "b")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


def table(spark, rows=None):
    """documents() with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    for name in ("row", "id", "size", "block", "s", "kept", "n_words", "shard", "fp", "component", "z", "rank", "key"):
        df = df.withColumn(name, F.lit("other"))
    return df
