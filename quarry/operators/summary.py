"""Construction statistics and lookups (inventory A6, A13, A15, A16, A23, J16, J18, C4, C11, S6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import tokens


def construction(raw: DataFrame, merged: DataFrame) -> DataFrame:
    """Raw and merged entities and how many have aliases, a description, attributes; mean confidence."""
    some = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    m = merged.agg(
        F.count("*").alias("merged"), some(F.size("aliases") > 0).alias("with_aliases"), some(F.col("description") != "").alias("with_description"),
        some(F.size("attributes") > 0).alias("with_attributes"), F.round(F.avg("confidence"), 3).alias("mean_confidence"),
    )
    return m.withColumn("raw", F.lit(raw.count()))


def name_frequency(nodes: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent names."""
    return nodes.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)


def linked_pages(entities: DataFrame) -> DataFrame:
    """How many pages any entity is linked to."""
    return entities.select(F.explode("source_pages").alias("page")).agg(F.count_distinct("page").alias("pages"))


def chunk_starts(chunks: DataFrame) -> DataFrame:
    """(page_start, chunks, markerless): chunks that begin on each page, and those without a section title."""
    return chunks.groupBy("page_start").agg(F.count("*").alias("chunks"), F.count_if(F.col("section_title").isNull()).alias("markerless"))


def path_statistics(paths: DataFrame, total_nodes: int) -> DataFrame:
    """Mean edges of chains, share of those with more than one edge, share of all nodes they touch, in percent."""
    hops = F.size("chain") - 1
    d = paths.agg(F.round(F.avg(hops), 6).alias("mean_hops"), F.round(F.avg((hops > 1).cast("double")), 6).alias("multi_hop_share"))
    touched = paths.select(F.explode("chain").alias("id")).agg(F.count_distinct("id").alias("n")).first()["n"]
    return d.withColumn("coverage", F.round(F.lit(100.0 * touched / max(1, total_nodes)), 4))


def question_entities(questions: DataFrame, entities: DataFrame, least: int = 3) -> DataFrame:
    """(qid, id, shared): entities (id, name, aliases) whose name or alias tokens a question has."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    e = entities.select("id", F.explode(F.array_distinct(tokens(F.array_join(names, " "), least))).alias("t"))
    q = questions.select("qid", F.explode(F.array_distinct(tokens("question", least))).alias("t"))
    return q.join(e, "t").groupBy("qid", "id").agg(F.count("*").alias("shared"))


def holders(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, id) of the entities linked to each of pages (page)."""
    return entities.select("id", F.explode("source_pages").alias("page")).join(pages.select("page").distinct(), "page").distinct()


def of_category(questions: DataFrame, category: Column | str) -> DataFrame:
    """The questions of a category."""
    return questions.where(F.col("category") == category)


def categories(questions: DataFrame) -> DataFrame:
    """The distinct categories in order."""
    return questions.select("category").distinct().orderBy("category")
