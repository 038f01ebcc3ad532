"""Incremental ingest of extractions, an extension: the reference has no streams.

New files of entity records are merged into the stored entities batch by batch. A batch that is run
again after a failure replaces the version it had begun, so that nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.merging import merge_entities


def merged_with(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The stored entities and a batch as one, with the batch's records after all stored ones."""
    if stored is None:
        return merge_entities(batch)
    last = stored.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("_last"))  # one row
    late = batch.crossJoin(F.broadcast(last)).withColumn("ord", (F.col("ord") + F.col("_last")).cast(stored.schema["ord"].dataType))
    return merge_entities(stored.unionByName(late.select(stored.columns)))


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema) -> StreamingQuery:
    """Start merging new parquet files of `source` into versions `target`/N, one for each batch."""

    def step(batch: DataFrame, n: int) -> None:
        stored = spark.read.parquet(f"{target}/{n - 1}") if n else None
        merged_with(stored, batch).write.mode("overwrite").parquet(f"{target}/{n}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
