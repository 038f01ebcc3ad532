"""Operator 6 [native], sharding by jump consistent hashing under the law `key`.

A row's shard follows from its doc_id and the number of shards alone, with no ring table; with one
more shard, rows move only into the new one. The generator's 64-bit steps are done in 32-bit halves,
as a product of longs may not wrap, and one fold gives the shard for n and for n + 1 shards. Slots
number a shard's rows without a gap: rows are counted by (shard, bucket), the counts are summed, and
each bucket is numbered by itself, so that no task holds a whole shard.

Defined cases: a null doc_id counts as 0; a null text is empty (8 bytes, CRC 0); rows that repeat have
slots of their own in one shard; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.portable import hash31

SHARDS, BUCKET_ROWS, MOST_BUCKETS = 24, 1000, 2**16
# 2862933555777941757, the generator's factor, in 16-bit limbs from the least
_FACTOR = [(2862933555777941757 >> (16 * k)) & 0xFFFF for k in range(4)]


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The halves of (hi:lo) * factor + 1 modulo 2^64; every product has under 49 bits."""
    c = [F.lit(x).cast("long") for x in _FACTOR]
    p0, p1, p2, p3, q0, q1 = lo * c[0], lo * c[1], lo * c[2], lo * c[3], hi * c[0], hi * c[1]
    low = lambda x: F.shiftleft(x.bitwiseAND(F.lit(0xFFFF).cast("long")), 16)
    t = p0 + low(p1) + 1
    word = F.lit(0xFFFFFFFF)
    up = F.shiftright(t, 32) + F.shiftright(p1, 16) + p2 + low(p3) + q0 + low(q1)
    return up.bitwiseAND(word), t.bitwiseAND(word)


def jump(key: Column, n: int) -> Column:
    """Struct (shard, grown): the jump consistent hash of a long among n and among n + 1 shards."""
    k = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    word = F.lit(0xFFFFFFFF)
    zero = F.lit(0).cast("long")
    start = F.struct(F.shiftrightunsigned(k, 32).bitwiseAND(word).alias("hi"), k.bitwiseAND(word).alias("lo"), zero.alias("j"), zero.alias("shard"), zero.alias("grown"))

    def fold(a: Column, _: Column) -> Column:
        hi, lo = _step(a["hi"], a["lo"])
        jumped = F.floor((a["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1).cast("double")))
        j = F.when(a["j"] > n, a["j"]).otherwise(jumped)
        live = a["j"] <= n
        shard = F.when(live & (a["j"] < n), a["j"]).otherwise(a["shard"])
        grown = F.when(live, a["j"]).otherwise(a["grown"])
        return F.struct(hi.alias("hi"), lo.alias("lo"), j.alias("j"), shard.alias("shard"), grown.alias("grown"))

    out = F.aggregate(F.sequence(F.lit(0), F.lit(n)), start, fold)
    return F.struct(out["shard"].cast("int").alias("shard"), out["grown"].cast("int").alias("grown"))


def shard(docs: DataFrame, n: int = SHARDS, *, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs' columns in a struct `row` with size, text_crc32, law, shard, slot and grown_shard."""
    rows = docs.count()
    buckets = min(MOST_BUCKETS, max(1, -(-rows // (n * bucket_rows))))
    text = F.coalesce(docs["text"], F.lit(""))
    bucket = F.pmod(hash31(F.col("id"), 5), F.lit(buckets))
    d = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("id"), text.alias("t"))
    d = d.select("row", "id", (F.octet_length("t") + 8).cast("long").alias("size"), F.crc32(F.col("t").cast("binary")).alias("text_crc32"), jump(F.col("id"), n).alias("to"), bucket.alias("bucket"))
    d = d.select("row", "id", "size", "text_crc32", "bucket", F.col("to.shard").alias("shard"), F.col("to.grown").alias("grown_shard"))
    counts = d.groupBy("shard", "bucket").count()
    upto = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size")
    d = d.withColumn("n", F.row_number().over(within)).join(counts, ["shard", "bucket"])
    return d.select("row", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("n") - 1).alias("slot"), "grown_shard")


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs).select("row.doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
