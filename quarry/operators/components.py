"""Connected components without a driver-side graph (inventory A11)."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder where none is set and all runs in one process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="quarry-")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) of the ends of edges (u, v) of any one orderable type; component is the least id reachable.

    Large-star and small-star rounds until the edges stay the same. Minima are combinable aggregates
    that return by a join whose large side the adaptive planner can split.
    """
    e = cut(edges.select("u", "v").where("u <> v").distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u > v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(low.select("u", F.col("m").alias("v")).unionByName(small).distinct())
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def component_sizes(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(component, size); with nodes (id), isolated ones are components of their own."""
    c = connected(edges)
    if nodes is not None:
        c = nodes.select("id").distinct().join(c, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return c.groupBy("component").agg(F.count("*").alias("size"))


def component_summary(sizes: DataFrame) -> DataFrame:
    """components, largest, singletons"""
    return sizes.agg(F.count("*").alias("components"), F.max("size").alias("largest"), F.count_if(F.col("size") == 1).alias("singletons"))
