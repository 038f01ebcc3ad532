"""Vector retrieval (inventory V1-V5, T1, S12): exact cosine top-k in blocks, MMR, filters.

Queries are a stated set. Both sides are cut into blocks that meet by an equality on the block pair;
each pair gives only its k best a query, so what is shuffled back is k rows a query and block. A task holds
the cosines of SLICE queries to one block at a time, however many there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, SLICE = 4096, 256


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    x = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def _nearest(cos: np.ndarray, ids: np.ndarray, vec: np.ndarray, k: int, with_self: bool) -> tuple[np.ndarray, ...]:
    """(query, vector, cosine) of the k best of each row of cos; ties go to the smaller vec_id."""
    if not with_self:
        cos[ids[:, None] == vec[None, :]] = -np.inf
    cos[np.isnan(cos)] = -np.inf
    take = []
    for row in cos:
        some = np.flatnonzero(row >= np.partition(row, -k)[-k]) if k < len(row) else np.arange(len(row))
        take.append(some[np.lexsort((vec[some], -row[some]))[:k]])
    at = np.concatenate(take)
    rows = np.repeat(np.arange(len(ids)), [len(t) for t in take])
    ok = np.isfinite(cos[rows, at])
    return ids[rows][ok], vec[at][ok], cos[rows, at][ok]


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, *, with_self: bool = False) -> DataFrame:
    """(qid, vec_id, cosine, rank) of the k nearest of vectors (vec_id, embedding) to queries (qid, embedding).

    Cosine in double precision, rounded to 6 places before ranking; ties go to the smaller vec_id.
    Null and zero vectors are not compared; all others must have one dimension.
    """
    usable = F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)
    q, v = queries.where(usable), vectors.where(usable)
    nq, nv = (max(1, -(-d.count() // BLOCK)) for d in (q, v))
    q = q.select("qid", "embedding", F.pmod(F.xxhash64("qid"), F.lit(nq)).alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nv - 1).cast("long"))).alias("b"))
    v = v.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(nv)).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("a"))

    at = SLICE

    def block(ql: pa.Table, vl: pa.Table) -> pa.Table:
        empty = ([], [], [])
        if ql.num_rows and vl.num_rows:
            dim = len(ql.column("embedding")[0])
            ids, vec = ql.column("qid").to_numpy(), vl.column("vec_id").to_numpy()
            x, y = _matrix(ql.column("embedding"), dim), _matrix(vl.column("embedding"), dim).T
            got = [_nearest(np.round(x[i : i + at] @ y, 6), ids[i : i + at], vec, k, with_self) for i in range(0, len(ids), at)]
            empty = tuple(map(np.concatenate, zip(*got, strict=True)))
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("qid", "vec_id", "cosine"), empty, (pa.int64(), pa.int64(), pa.float64()))})

    near = q.groupBy("a", "b").cogroup(v.groupBy("a", "b")).applyInArrow(block, "qid long, vec_id long, cosine double")
    w = Window.partitionBy("qid").orderBy(F.desc("cosine"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def filtered_top_k(queries: DataFrame, vectors: DataFrame, condition, k: int = 5) -> DataFrame:
    """V3: top_k among the vectors that meet a condition on their metadata."""
    return top_k(queries, vectors.where(condition), k)


def mmr(queries: DataFrame, vectors: DataFrame, k: int = 5, fetch: int = 20, balance: float = 0.5) -> DataFrame:
    """V2: (qid, vec_id, rank): of the `fetch` nearest, k picked greedily by balance * closeness - (1 - balance) * likeness to those picked."""
    near = top_k(queries, vectors, fetch).join(vectors.select("vec_id", F.col("embedding").alias("e")), "vec_id")

    def pick(table: pa.Table) -> pa.Table:
        t = table.sort_by([("rank", "ascending")])
        x = _matrix(t.column("e"), len(t.column("e")[0]))
        close, like = t.column("cosine").to_numpy(), x @ x.T
        chosen: list[int] = []
        while len(chosen) < min(k, len(close)):
            worth = balance * close - (1 - balance) * (like[:, chosen].max(axis=1) if chosen else 0.0)
            worth[chosen] = -np.inf
            chosen.append(int(np.argmax(worth)))
        return pa.table({"qid": t.column("qid").take(chosen), "vec_id": t.column("vec_id").take(chosen), "rank": pa.array(np.arange(1, len(chosen) + 1), pa.int32())})

    return near.groupBy("qid").applyInArrow(pick, "qid long, vec_id long, rank int")


def formatted(results: DataFrame, texts: DataFrame) -> DataFrame:
    """V5: (qid, context): the texts (vec_id, page, text) of results in rank order, each led by its page."""
    line = F.format_string("[Page %s]\n%s", F.col("page").cast("string"), F.col("text"))
    d = results.join(texts, "vec_id").select("qid", F.struct("rank", line.alias("l")).alias("x"))
    return d.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "\n\n").alias("context"))
