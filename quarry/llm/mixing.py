"""Operator 4 [native], mixing sources to target weights by Sainte-Lague apportionment.

Sources weigh 5, 2, 1 in turn by code point and share all words; a target stops at `epochs` times its
source's size and the rest is shared again. Targets are apportioned in blocks of equal words by the
highest quotients target / (2k + 1); a source's blocks are apportioned again over its shards (hash
shards of bounded size, so a hot source is many shards). In a shard the documents stand in a seeded
order; whole passes and then a run of blocks from a seeded block on are taken, so that a document's
taken words follow from its position alone, without a row for each block.

The quotients needn't be listed: the divisor between the last seat and the next is bisected over the
votes of one apportionment, and only the seats at that divisor are ranked.

Defined cases: null texts have size 0 and nothing of them is taken; the null source is the last; rows
that repeat are documents of their own; if there are no words, all targets are 0; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.portable import hash31, hash31_sql
from quarry.llm.shared import cut

WEIGHTS, EPOCHS, BLOCK, SHARD_WORDS, MOST_SHARDS = (5, 2, 1), 3, 32, 250_000, 2**18
WORD, SPACES = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]*"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """rank and target of each row of sizes (source, s): one row per source, null last."""
    n = len(weights)
    dec = lambda c: c.cast("decimal(38,0)")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("rank", F.row_number().over(by_name).cast("long"))
    t = t.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % n + 1).cast("int")).cast("long"))
    tight = Window.orderBy((F.col("s") * epochs).cast("double") / F.col("w"), "rank")
    every = Window.partitionBy()
    before, after = tight.rowsBetween(Window.unboundedPreceding, -1), tight.rowsBetween(0, Window.unboundedFollowing)
    t = t.select("*", F.sum("s").over(every).alias("total"), F.coalesce(F.sum(F.col("s") * epochs).over(before), F.lit(0)).alias("gone"), F.sum("w").over(after).alias("rest_w"))
    full = dec(F.col("s") * epochs) * F.col("rest_w") <= dec(F.col("w")) * (F.col("total") - F.col("gone"))
    t = t.withColumn("full", full)
    t = t.withColumn("c", F.sum(F.when(F.col("full"), F.col("s") * epochs).otherwise(0)).over(every)).withColumn("free_w", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(every))
    share = dec(F.col("w") * (F.col("total") - F.col("c"))).cast("double") / F.col("free_w")
    return t.select("source", "s", "rank", "total", F.when(F.col("full"), (F.col("s") * epochs).cast("double")).otherwise(share).alias("target"))


def apportion(df: DataFrame, group: list[str], key: str, votes: str, cap: str, seats: str) -> DataFrame:
    """df with `quota`: in each group, `seats` given by highest quotients votes / (2k + 1), at most
    `cap` to a row; ties go to the smaller key. Groups with fewer seats in all caps fill every cap."""
    v, c = F.col(votes), F.col(cap)
    g = df.groupBy(*group).agg(F.collect_list(F.struct(v.alias("v"), c.alias("c"))).alias("a"), F.least(F.max(seats), F.sum(c)).alias("n"), (2 * F.max(v) + 1).alias("top"))
    got = lambda x, d: F.least(x["c"], F.ceil(x["v"] / d - 0.5))
    given = lambda d: F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + got(x, d))

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        return F.when(given(mid) <= F.col("n"), F.struct(acc["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct(mid.alias("lo"), acc["hi"].alias("hi")))

    start = F.struct(F.lit(1e-9).alias("lo"), F.col("top").alias("hi"))
    g = g.withColumn("d", F.aggregate(F.sequence(F.lit(1), F.lit(100)), start, halve)["hi"])
    g = g.select(*group, "d", (F.col("n") - given(F.col("d"))).alias("rest"))
    out = df.join(g, group).withColumn("base", F.least(c, F.ceil(v / F.col("d") - 0.5)))
    order = Window.partitionBy(*group).orderBy((F.col("base") < c).desc(), (v / (2 * F.col("base") + 1)).desc(), key)
    more = (F.col("base") < c) & (F.row_number().over(order) <= F.col("rest"))
    return out.withColumn("quota", F.col("base") + F.when(more, 1).otherwise(0)).drop("base", "d", "rest")


def allot(d: DataFrame, slim: DataFrame, *, weights=WEIGHTS, epochs: int = EPOCHS, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = 11) -> DataFrame:
    """d (id, source, size and others) with source_size, target, taken, full, a1, b1, a2, b2.

    Of the document, words [a1, b1) and [a2, b2) are taken once more than its `full` whole passes.
    slim has the same rows' id, source and size, to be read several times.
    """
    src = targets(slim.groupBy("source").agg(F.sum("size").alias("s")), weights, epochs)
    src = src.withColumn("g", F.lit(1)).withColumn("cap", F.floor(F.col("s") * epochs / block)).withColumn("seats", F.floor(F.col("total") / block))
    src = apportion(src, ["g"], "rank", "target", "cap", "seats")
    shards = F.ceil(F.col("s") / F.greatest(F.lit(float(shard_words)), F.col("total") / MOST_SHARDS))
    src = src.select(F.col("source").alias("_source"), F.col("s").alias("source_size"), "target", "rank", F.col("quota").alias("_seats"), F.greatest(shards, F.lit(1)).cast("long").alias("_n"))

    def placed(x: DataFrame) -> DataFrame:
        x = x.join(src, x["source"].eqNullSafe(F.col("_source")))
        return x.withColumn("shard", F.pmod(hash31(F.col("id"), seed), F.col("_n"))).drop("_source", "_n")

    cells = placed(slim).groupBy("rank", "shard").agg(F.sum("size").alias("z"), F.first("_seats").alias("_seats"))
    cells = cells.withColumn("_votes", F.col("z").cast("double")).withColumn("_cap", F.floor(F.col("z") * epochs / block))
    cells = apportion(cells, ["rank"], "shard", "_votes", "_cap", "_seats").select("rank", "shard", "z", (F.col("quota") * block).alias("words"))
    d = placed(d).drop("_seats").join(cells, ["rank", "shard"])
    order = Window.partitionBy("rank", "shard").orderBy(hash31(F.col("id"), seed + 1), "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("end", F.sum("size").over(order)).withColumn("begin", F.col("end") - F.col("size"))
    z = F.greatest(F.col("z"), F.lit(1))
    d = d.withColumn("full", F.floor(F.col("words") / z)).withColumn("part", F.col("words") - F.col("full") * z)
    d = d.withColumn("at", F.pmod(hash31(F.col("rank") * 1000003 + F.col("shard"), seed + 2), F.greatest(F.floor(F.col("z") / block), F.lit(1))) * block)

    def within(lo: Column, hi: Column) -> tuple[Column, Column]:
        a = F.least(F.greatest(lo - F.col("begin"), F.lit(0)), F.col("size"))
        return a, F.greatest(a, F.least(hi - F.col("begin"), F.col("size")))

    a1, b1 = within(F.col("at"), F.least(F.col("at") + F.col("part"), F.col("z")))
    a2, b2 = within(F.lit(0), F.greatest(F.col("at") + F.col("part") - F.col("z"), F.lit(0)))
    d = d.withColumns({"a1": a1, "b1": b1, "a2": a2, "b2": b2}).drop("rank", "shard", "z", "words", "end", "begin", "part", "at")
    return d.withColumn("taken", F.col("full") * F.col("size") + F.col("b1") - F.col("a1") + F.col("b2") - F.col("a2"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("id"), docs["source"].alias("source"), word_count(docs["text"]).alias("size"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: docs' columns, a row for each pass over a document and one for each part of it.

    A part's text is the text from its first word to its last; n_chars, where there is one, follows the text.
    """
    slim = cut(_sized(docs))
    d = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("id"), docs["source"].alias("source"), word_count(docs["text"]).alias("size"))
    d = allot(d, slim, **how).where("taken > 0")
    whole = F.lit(None).cast("string")
    listed = F.regexp_extract_all(F.col("row")["text"], F.lit(WORD + SPACES), F.lit(0))
    slice_ = lambda a, b: F.rtrim(F.array_join(F.slice(listed, (F.col(a) + 1).cast("int"), (F.col(b) - F.col(a)).cast("int")), ""), F.lit(" \t\n\v\f\r"))
    part = lambda a, b: F.when(F.col(b) - F.col(a) == F.col("size"), F.array(F.col("row")["text"])).when(F.col(b) > F.col(a), F.array(slice_(a, b))).otherwise(F.array(whole).cast("array<string>"))
    texts = F.concat(F.array_repeat(F.col("row")["text"], F.col("full").cast("int")), part("a1", "b1"), part("a2", "b2"))
    d = d.select("row", F.explode(F.filter(texts, lambda t: t.isNotNull())).alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("long")}
    return d.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    slim = cut(_sized(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return allot(slim, slim).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_sql(*, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = 11) -> str:
    """DuckDB SQL for op4's rows, with every quotient of every seat listed and ranked."""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id AS id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
src0 AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source),
src1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, sum(s) OVER ()::BIGINT AS total FROM src0),
src2 AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1]::BIGINT AS w FROM src1),
cap(step, rank, s, w, total, fixed) AS (
  SELECT 0, rank, s, w, total, false FROM src2
  UNION ALL
  SELECT step + 1, rank, s, w, total, fixed OR 3 * s * (sum(CASE WHEN fixed THEN 0 ELSE w END) OVER ()) <= w * (total - sum(CASE WHEN fixed THEN 3 * s ELSE 0 END) OVER ())
  FROM cap WHERE step < 200 AND step < (SELECT count(*) FROM src2)),
src3 AS (SELECT * FROM cap WHERE step = (SELECT max(step) FROM cap)),
src4 AS (SELECT rank, s, total, CASE WHEN fixed THEN (3 * s)::DOUBLE ELSE (w * (total - sum(CASE WHEN fixed THEN 3 * s ELSE 0 END) OVER ()))::DOUBLE / sum(CASE WHEN fixed THEN 0 ELSE w END) OVER () END AS target FROM src3),
q1 AS (SELECT rank, target / (2 * k + 1) AS q, total FROM src4, unnest(range(3 * s // {block})) AS t(k)),
q2 AS (SELECT rank, count(*) AS seats FROM (SELECT rank, total, row_number() OVER (ORDER BY q DESC, rank) AS n FROM q1) WHERE n <= total // {block} GROUP BY rank),
src AS (SELECT src2.source, src4.*, coalesce(seats, 0) AS seats, greatest(1, ceil(src4.s / greatest({shard_words}.0, src4.total / {MOST_SHARDS})))::BIGINT AS n FROM src4 JOIN src2 USING (rank) LEFT JOIN q2 USING (rank)),
p AS (SELECT d.id, d.size, src.*, {hash31_sql("d.id", seed)} % src.n AS shard, {hash31_sql("d.id", seed + 1)} AS ord FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
cell AS (SELECT rank, shard, sum(size)::BIGINT AS z, any_value(seats) AS seats FROM p GROUP BY rank, shard),
c1 AS (SELECT rank, shard, seats, z::DOUBLE / (2 * k + 1) AS q FROM cell, unnest(range(3 * z // {block})) AS t(k)),
c2 AS (SELECT rank, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY q DESC, shard) AS n FROM c1) WHERE n <= seats GROUP BY rank, shard),
c3 AS (SELECT rank, shard, z, coalesce(quota, 0) * {block} AS words, {hash31_sql("(rank * 1000003 + shard)", seed + 2)} % greatest(z // {block}, 1) * {block} AS lo FROM cell LEFT JOIN c2 USING (rank, shard)),
c4 AS (SELECT *, words // greatest(z, 1) AS passes, words % greatest(z, 1) AS part FROM c3),
e AS (SELECT p.*, c4.z, c4.lo, c4.passes, c4.part, sum(size) OVER (PARTITION BY p.rank, p.shard ORDER BY ord, id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS hi FROM p JOIN c4 ON p.rank = c4.rank AND p.shard = c4.shard)
SELECT id AS doc_id, size, s AS source_size, target,
  (passes * size + greatest(0, least(hi, least(lo + part, z)) - greatest(hi - size, lo)) + greatest(0, least(hi, lo + part - z) - (hi - size)))::BIGINT AS taken
FROM e"""
