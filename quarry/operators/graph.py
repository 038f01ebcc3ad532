"""Graph statistics and bounded traversal (inventory A5-A17, A25, J13-J15, R7, R8, C6, C7).

Nodes: id (and name, type, ...). Edges: src, rel, dst. Tables, never a driver-side graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import norm
from quarry.operators.components import cut

# Relation pairs that may stand between the same nodes in opposite directions.
INVERSE_PAIRS = (
    ("CREATED", "CREATED_BY"), ("OWNS", "OWNED_BY"), ("PUBLISHES", "PUBLISHED_BY"), ("DEVELOPS", "DEVELOPED_BY"), ("USES", "USED_BY"),
    ("IMPLEMENTS", "IMPLEMENTED_BY"), ("SUPPORTS", "SUPPORTED_BY"), ("ENABLES", "ENABLED_BY"), ("PROVIDES", "PROVIDED_BY"), ("REQUIRES", "REQUIRED_BY"),
    ("REGULATES", "REGULATED_BY"), ("VALIDATES", "APPROVED_BY"), ("HAS_VERSION", "VERSION_OF"), ("REPLACES", "REPLACED_BY"), ("PRECEDED_BY", "SUCCEEDS"),
    ("BASED_ON", "DERIVED_FROM"), ("COVERS", "COVERED_BY"), ("APPLIES_TO", "APPLIED_BY"), ("CONTAINS", "PART_OF"), ("HAS_COMPONENT", "PART_OF"),
)


def ends(edges: DataFrame) -> DataFrame:
    """(id, other) of every edge from both sides."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))).alias("e")).select("e.*")


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, degree), counting edge ends; with nodes, isolated ones have 0."""
    d = ends(edges).groupBy("id").agg(F.count("*").alias("degree"))
    return d if nodes is None else nodes.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def neighbour_degrees(edges: DataFrame) -> DataFrame:
    """(id, degree), counting distinct neighbours.

    Each pair is made one before it is counted from both sides, so that half as many rows are told apart.
    """
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return ends(pairs).groupBy("id").agg(F.count("*").alias("degree"))


def histogram(degree: DataFrame) -> DataFrame:
    """(degree, nodes)"""
    return degree.groupBy("degree").agg(F.count("*").alias("nodes"))


def density(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes, edges, density of distinct unordered pairs."""
    pairs_of = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    both = pairs_of.select(F.lit(0).alias("n"), F.lit(1).alias("e")).unionByName(nodes.select("id").distinct().select(F.lit(1).alias("n"), F.lit(0).alias("e")))
    both = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("e"), F.lit(0)).alias("edges"))
    pairs = F.col("nodes").cast("double") * (F.col("nodes") - 1) / 2
    return both.select("nodes", "edges", F.round(F.when(pairs > 0, F.col("edges") / pairs).otherwise(0.0), 6).alias("density"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes on no edge."""
    return nodes.join(ends(edges).select("id").distinct(), "id", "left_anti")


def counts_by(df: DataFrame, key: str) -> DataFrame:
    """A5: (key, n), most common first."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)


def duplicate_names(nodes: DataFrame) -> DataFrame:
    """(name_key, members) of normalised names that several nodes share."""
    return nodes.groupBy(norm("name").alias("name_key")).agg(F.count("*").alias("members")).where("members > 1")


def reverse_edges(edges: DataFrame, inverse=INVERSE_PAIRS) -> DataFrame:
    """(a, b, rel_ab, rel_ba) once for each pair of nodes with edges both ways, but known inverses."""
    a = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("rel").alias("rel_ab")).distinct()
    b = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("rel").alias("rel_ba")).distinct()
    both = a.where("a < b").join(b, ["a", "b"])
    known = F.array(*(F.lit(f"{x}|{y}") for p in inverse for x, y in (p, p[::-1])))
    return both.where(~F.array_contains(known, F.concat_ws("|", "rel_ab", "rel_ba")))


def alias_collisions(nodes: DataFrame) -> DataFrame:
    """(a, b) unordered pairs of nodes where one's name is an alias of the other."""
    names = nodes.select(F.col("id").alias("x"), norm("name").alias("k")).where("k <> ''")
    aliases = nodes.select(F.col("id").alias("y"), F.explode("aliases").alias("al")).select("y", norm("al").alias("k")).where("k <> ''").distinct()
    return names.join(aliases, "k").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def schema_triples(edges: DataFrame, nodes: DataFrame, top: int = 40) -> DataFrame:
    """The most common (src_type, rel, dst_type)."""
    a, b = (nodes.select(F.col("id").alias(e), F.col("type").alias(e + "_type")) for e in ("src", "dst"))
    t = edges.join(a, "src").join(b, "dst").groupBy("src_type", "rel", "dst_type").agg(F.count("*").alias("n"))
    return t.orderBy(F.desc("n"), "src_type", "rel", "dst_type").limit(top)


def pattern(edges: DataFrame, nodes: DataFrame, src_type: str | None = None, rel: str | None = None, dst_type: str | None = None) -> DataFrame:
    """(src, rel, dst) by name of the edges of one typed step; None stands for any type or relation."""
    typed = lambda t, end: (nodes if t is None else nodes.where(F.col("type") == t)).select(F.col("id").alias(end), F.col("name").alias(end + "_name"))
    e = edges if rel is None else edges.where(F.col("rel") == rel)
    return e.join(typed(src_type, "src"), "src").join(typed(dst_type, "dst"), "dst").select(F.col("src_name").alias("src"), "rel", F.col("dst_name").alias("dst"))


def per_page(entities: DataFrame) -> DataFrame:
    """(page, entities)"""
    return entities.select("id", F.explode("source_pages").alias("page")).groupBy("page").agg(F.count_distinct("id").alias("entities"))


def page_status(entities: Column, relationships: Column, nodes: Column, chunks: Column) -> Column:
    """D3: LINKED; H1 no chunk covers the page; H2 nothing was extracted from it; H3 extracted but not loaded."""
    return F.when(nodes > 0, "LINKED").when(chunks == 0, "H1").when((entities == 0) & (relationships == 0), "H2").otherwise("H3")


def coverage(pages: DataFrame, chunks: DataFrame, entities: DataFrame, relationships: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each page its text length, counts of what covers it, and its status.

    pages (page, text_len); the others have `page`, one row for each thing on it.
    """
    out = pages
    for name, df in (("chunks", chunks), ("entities", entities), ("relationships", relationships), ("nodes", nodes)):
        out = out.join(df.groupBy("page").agg(F.count("*").alias(name)), "page", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("status", page_status(*(F.col(c) for c in ("entities", "relationships", "nodes", "chunks"))))


def reach(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """R7, level by level: (qid, id, level) reached from seeds (qid, id), and (qid, src, rel, dst, level) emitted.

    Every out-edge of the frontier is emitted; an in-edge only if its source was not reached by an
    earlier level. Within a level all nodes are alike, whatever their order.
    """
    seen = cut(seeds.select("qid", "id").distinct().withColumn("level", F.lit(0)))
    front, emitted = seen, None
    for level in range(1, depth + 1):
        f = front.select("qid", F.col("id").alias("at"))
        out = f.join(edges, f["at"] == edges["src"]).select("qid", "src", "rel", "dst", F.col("dst").alias("id"), F.lit(True).alias("out"))
        back = f.join(edges, f["at"] == edges["dst"]).select("qid", "src", "rel", "dst", F.col("src").alias("id"), F.lit(False).alias("out"))
        new_in = back.join(seen.select("qid", "id"), ["qid", "id"], "left_anti").select(out.columns)
        stepped = cut(out.unionByName(new_in).distinct())
        now = stepped.select("qid", "src", "rel", "dst").distinct().withColumn("level", F.lit(level))
        emitted = now if emitted is None else emitted.unionByName(now)
        front = stepped.select("qid", "id").distinct().join(seen.select("qid", "id"), ["qid", "id"], "left_anti").withColumn("level", F.lit(level))
        seen = cut(seen.unionByName(front))
    emitted = emitted.groupBy("qid", "src", "rel", "dst").agg(F.min("level").alias("level"))
    return seen, emitted


def paths(edges: DataFrame, seeds: DataFrame, depth: int = 3, most: int = 60) -> DataFrame:
    """(qid, chain, ordinals): the first `most` chains in depth-first order from seeds (qid, id, rank).

    Depth-first order is the lexicographic order of (seed rank, edge ordinals), a chain before those it
    begins. A chain behind `most` others of its own length can't be among the first, so each level
    keeps no more than that, and no node needs more than its first `most` edges, to which tasks cut
    a hub before it is gathered.
    """
    o = Window.partitionBy("src").orderBy("dst", "rel")
    e = edges.select("src", "dst", F.row_number().over(o).alias("k")).where(F.col("k") <= most)
    w = Window.partitionBy("qid").orderBy("ordinals")
    level = seeds.select("qid", F.array("id").alias("chain"), F.array("rank").alias("ordinals"))
    every = None
    for _ in range(depth):
        step = level.join(e, F.element_at(level["chain"], -1) == e["src"])
        step = step.select("qid", F.concat("chain", F.array("dst")).alias("chain"), F.concat("ordinals", F.array("k")).alias("ordinals"))
        level = cut(step.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n"))
        every = level if every is None else every.unionByName(level)
    return every.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def khop_counts(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, hop1, hop2): distinct nodes within one and within two undirected steps of each root."""
    e = ends(edges)  # joined from the few roots on, so that only touched edges are made distinct
    one = roots.select(F.col("id").alias("root")).join(e, F.col("root") == e["id"]).select("root", F.col("other").alias("x")).distinct()
    two = one.join(e, F.col("x") == e["id"]).select("root", F.col("other").alias("x")).distinct()
    n1 = one.where("x <> root").groupBy("root").agg(F.count("*").alias("hop1"))
    n2 = one.unionByName(two).distinct().where("x <> root").groupBy("root").agg(F.count("*").alias("hop2"))
    return roots.select(F.col("id").alias("root")).join(n1, "root", "left").join(n2, "root", "left").select(F.col("root").alias("id"), F.coalesce("hop1", F.lit(0)).alias("hop1"), F.coalesce("hop2", F.lit(0)).alias("hop2"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2, most: int = 50) -> DataFrame:
    """(qid, chain): undirected trails of 1 to hops (at most 3) edges, none used twice, first `most` by chain."""
    e = edges.select("src", "rel", "dst").distinct().withColumn("eid", F.concat_ws("\x01", "src", "rel", "dst"))
    both = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "eid").unionByName(e.where("src <> dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), "eid"))
    level = seeds.select("qid", F.array("id").alias("chain"), F.array().cast("array<string>").alias("used"))
    every = None
    for _ in range(min(max(hops, 1), 3)):
        step = level.join(both, F.element_at(level["chain"], -1) == both["a"]).where(~F.array_contains("used", F.col("eid")))
        level = step.select("qid", F.concat("chain", F.array("b")).alias("chain"), F.concat("used", F.array("eid")).alias("used"))
        every = level if every is None else every.unionByName(level)
    w = Window.partitionBy("qid").orderBy("chain", "used")
    return every.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("qid", "chain")
