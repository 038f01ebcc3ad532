"""Entity and relationship normalisation, merging and resolution (inventory P12-P14, P18, A1-A4, J1-J6, D7, D8).

Entities: id, canonical_name, name, type, description, aliases, attributes (map), confidence, evidence,
source_pages, source_chunks, frequency, ord. Relationships: source, relation, target, description,
confidence, evidence, source_pages, source_chunks, frequency, ord. `ord` is the order of ingestion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import alnum, entity_type, is_rejected, norm, relation, slug

CROSS = "-cross-chunk"


def _union(c: str) -> Column:
    """All elements of arrays; equal arrays are one before they are dealt out."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))


def _longest(c: str) -> Column:
    """The longest value; of equally long ones the first."""
    return F.max_by(c, F.struct(F.char_length(F.coalesce(c, F.lit(""))), -F.col("ord")))


def _evidence() -> Column:
    """Values in order, each appended on a line of its own unless what is there has it as a substring."""
    rows = F.array_sort(F.collect_list(F.struct("ord", F.col("evidence").alias("e"))))
    add = lambda s, r: F.when(s == "", r["e"]).when(F.contains(s, r["e"]), s).otherwise(F.concat(s, F.lit("\n"), r["e"]))
    return F.nullif(F.aggregate(F.filter(rows, lambda r: r["e"] != ""), F.lit(""), add), F.lit(""))


def _attributes(e: DataFrame) -> DataFrame:
    """(id, attributes): maps merged in order, a later value of a key replacing an earlier one; keys as last written."""
    flat = e.select("id", "ord", F.posexplode(F.map_entries("attributes")).alias("k", "m")).select("id", F.col("m.key").alias("key"), F.col("m.value").alias("value"), F.struct("ord", "k").alias("at"))
    last = flat.groupBy("id", "key").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("at", "key", "value"))), lambda x: F.struct(x["key"], x["value"]))
    return last.groupBy("id").agg(F.map_from_entries(entries).alias("attributes"))


def entities_of(raw: DataFrame) -> DataFrame:
    """Valid entities of raw records (canonical_name, name, type, description, aliases, attributes,
    confidence, evidence, chunk_id, page_start, page_end, ord)."""
    canonical = F.trim(F.coalesce("canonical_name", "name", F.lit("")))
    kind = entity_type(F.col("type"))
    aliases = F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a != "")
    d = raw.withColumn("canonical_name", canonical).where((F.col("canonical_name") != "") & ~is_rejected(F.col("canonical_name")))
    return d.select(
        F.concat_ws("-", slug("canonical_name"), slug(kind)).alias("id"), "canonical_name", F.trim(F.coalesce("name", "canonical_name")).alias("name"), kind.alias("type"),
        F.coalesce("description", F.lit("")).alias("description"), aliases.alias("aliases"), F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"),
        F.coalesce("confidence", F.lit(0.5)).alias("confidence"), "evidence",
        F.when(F.coalesce("page_start", F.lit(0)) > 0, F.sequence("page_start", "page_end")).otherwise(F.array().cast("array<int>")).alias("source_pages"),
        F.when(F.col("chunk_id") != -1, F.array("chunk_id")).otherwise(F.array().cast("array<int>")).alias("source_chunks"), F.lit(1).cast("long").alias("frequency"), "ord",
    )


def relationships_of(raw: DataFrame, entities: DataFrame) -> DataFrame:
    """Valid relationships of raw records (chunk_id, source, relation, target, ...), with the ends
    resolved inside the chunk: a name as written, then in any case (first inserted), then SLUG-cross-chunk."""
    e = entities.select(F.explode("source_chunks").alias("chunk_id"), "id", "ord", F.explode(F.array_distinct(F.array("canonical_name", "name"))).alias("n"))
    exact = e.groupBy("chunk_id", "n").agg(F.max_by("id", "ord").alias("x"))
    loose = e.groupBy("chunk_id", F.lower("n").alias("n")).agg(F.min_by("id", "ord").alias("y"))
    d = raw.select("*", F.trim("source").alias("_source"), F.trim("target").alias("_target"), relation(F.trim("relation")).alias("_relation"))
    d = d.where("_source <> '' and _target <> '' and _relation <> ''")
    for end in ("_source", "_target"):
        a = exact.select("chunk_id", F.col("n").alias(end), F.col("x").alias(end + "x"))
        b = loose.select("chunk_id", F.col("n").alias("_l"), F.col("y").alias(end + "y"))
        d = d.join(a, ["chunk_id", end], "left").withColumn("_l", F.lower(end)).join(b, ["chunk_id", "_l"], "left").drop("_l")
        d = d.withColumn(end, F.coalesce(end + "x", end + "y", F.concat(slug(end), F.lit(CROSS)))).drop(end + "x", end + "y")
    pages = F.when(F.coalesce("page_start", F.lit(0)) > 0, F.sequence("page_start", "page_end")).otherwise(F.array().cast("array<int>"))
    chunks = F.when(F.col("chunk_id") != -1, F.array("chunk_id")).otherwise(F.array().cast("array<int>"))
    return d.where("_source <> _target").select(
        F.col("_source").alias("source"), F.col("_relation").alias("relation"), F.col("_target").alias("target"), F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("confidence", F.lit(0.5)).alias("confidence"), "evidence", pages.alias("source_pages"), chunks.alias("source_chunks"), F.lit(1).cast("long").alias("frequency"), "ord",
    )


def _provenance() -> list[Column]:
    return [_union("source_pages").alias("source_pages"), _union("source_chunks").alias("source_chunks"), F.sum("frequency").alias("frequency"), F.max("confidence").alias("confidence")]


def _merged(d: DataFrame, keys: list[str], first: list[str] = (), arrays: list[str] = ()) -> DataFrame:
    """One row for each of the keys, in two steps: records of equal evidence first, so that a key with very
    many records is dealt out by its evidence and the last step folds every text once."""
    best = F.struct(F.char_length(F.coalesce("description", F.lit(""))).alias("n"), (-F.col("ord")).alias("o"), F.col("description").alias("d"))
    own = [F.struct("ord", *(F.col(c) for c in first)).alias("_first")] if first else []
    p = d.select("*", best.alias("_best"), *own)
    lists = [_union(c).alias(c) for c in arrays]
    ends = [F.max("_best").alias("_best"), *([F.min("_first").alias("_first")] if first else [])]
    p = p.groupBy(*keys, F.nullif("evidence", F.lit("")).alias("evidence")).agg(*lists, *_provenance(), *ends, F.min("ord").alias("ord"))
    g = p.groupBy(*keys).agg(*lists, *_provenance(), *ends, _evidence().alias("evidence"), F.min("ord").alias("ord"))
    return g.select(*keys, *(F.col("_first")[c].alias(c) for c in first), *arrays, "source_pages", "source_chunks", "frequency", "confidence", F.col("_best.d").alias("description"), "evidence", "ord")


def merge_entities(e: DataFrame) -> DataFrame:
    """A1: one entity per id."""
    g = _merged(e, ["id"], ["canonical_name", "name", "type"], ["aliases"])
    d = g.join(_attributes(e), "id", "left").withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>")))
    return d.select("id", "canonical_name", "name", "type", "aliases", "attributes", "source_pages", "source_chunks", "frequency", "confidence", "description", "evidence", "ord")


def merge_relationships(r: DataFrame) -> DataFrame:
    """A2: one relationship per (source, relation, target)."""
    return _merged(r, ["source", "relation", "target"])


def resolve_cross_chunk(r: DataFrame, e: DataFrame) -> DataFrame:
    """Ends that were left SLUG-cross-chunk, looked up by the slug of a name, with and without its
    last part; of entities that share a slug the last one is meant."""
    s = slug("canonical_name")
    bare = F.when(F.contains(s, F.lit("-")), F.regexp_replace(s, "-[^-]*$", "")).otherwise(s)
    keys = e.select("id", F.posexplode(F.array(s, bare)).alias("k", "slug"), "ord").groupBy("slug").agg(F.max_by("id", F.struct("ord", "k")).alias("to"))
    for end in ("source", "target"):
        wanted = F.when(F.col(end).endswith(CROSS), F.replace(F.col(end), F.lit(CROSS), F.lit("")))
        r = r.withColumn("_k", wanted).join(keys.withColumnRenamed("slug", "_k"), "_k", "left").withColumn(end, F.coalesce("to", end)).drop("_k", "to")
    return r


def merge_by_name(e: DataFrame) -> DataFrame:
    """A3: (id, survivor) of every entity: in each group of one normalised name the most frequent
    survives, then the one of the longest description, then the first."""
    key = norm("canonical_name").alias("_k")
    worth = F.struct("frequency", F.char_length(F.coalesce("description", F.lit(""))).alias("n"), (-F.col("ord")).alias("o"))
    best = e.groupBy(key).agg(F.max_by("id", worth).alias("survivor"))
    return e.select("id", key).join(best, "_k").select("id", "survivor")


def collapse(e: DataFrame) -> DataFrame:
    """A3: the entities that survive merge_by_name, with what the others knew."""
    ids = merge_by_name(e)
    d = e.join(ids, "id")
    own = d.where("id = survivor").select("id", "canonical_name", "name", "type")
    first_seen = F.transform(F.array_sort(F.collect_list(F.struct("ord", "aliases"))), lambda x: x["aliases"])
    ev = F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("ord", "evidence"))), lambda x: x["evidence"]), lambda x: x.isNotNull() & (x != "")))
    g = d.groupBy(F.col("survivor").alias("id")).agg(
        F.array_distinct(F.filter(F.flatten(first_seen), lambda a: a != "")).alias("aliases"), _union("source_pages").alias("source_pages"), _union("source_chunks").alias("source_chunks"),
        F.sum("frequency").alias("frequency"), F.max("confidence").alias("confidence"), _longest("description").alias("description"), F.nullif(F.array_join(ev, "\n"), F.lit("")).alias("evidence"), F.min("ord").alias("ord"),
    )
    return own.join(g, "id")


def rewire(r: DataFrame, e: DataFrame, ids: DataFrame) -> DataFrame:
    """Relationships with ends moved to survivors (ids: id, survivor), dangling ones matched by
    their letters and digits to the least id. Adds `fate`: kept, unresolvable, self_loop."""
    known = e.select("id", alnum("canonical_name").alias("_a"))
    by_letters = known.groupBy("_a").agg(F.min("id").alias("_near"))
    for end in ("source", "target"):
        r = r.join(ids.select(F.col("id").alias(end), F.col("survivor").alias("_s")), end, "left").withColumn(end, F.coalesce("_s", end)).drop("_s")
        r = r.join(known.select(F.col("id").alias(end), F.lit(True).alias("_in")), end, "left")
        r = r.withColumn("_a", alnum(F.replace(F.col(end), F.lit(CROSS), F.lit("")))).join(by_letters, "_a", "left")
        r = r.withColumn(end, F.when(F.col("_in"), F.col(end)).otherwise(F.col("_near"))).drop("_in", "_a", "_near")
    fate = F.when(F.col("source").isNull() | F.col("target").isNull(), "unresolvable").when(F.col("source") == F.col("target"), "self_loop").otherwise("kept")
    return r.withColumn("fate", fate)


def rewire_counts(rewired: DataFrame) -> DataFrame:
    """A4 counters: unresolvable, self_loop, duplicate."""
    kept = F.col("fate") == "kept"
    return rewired.agg(
        F.count_if(F.col("fate") == "unresolvable").alias("unresolvable"), F.count_if(F.col("fate") == "self_loop").alias("self_loop"),
        (F.count_if(kept) - F.count_distinct(F.when(kept, F.struct("source", "relation", "target")))).alias("duplicate"),
    )


def load_edges(r: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes (id), one per (source, relation, target)."""
    n = nodes.select("id").distinct()
    both = r.join(n.select(F.col("id").alias("source")), "source", "left_semi").join(n.select(F.col("id").alias("target")), "target", "left_semi")
    return both.dropDuplicates(["source", "relation", "target"])


def with_names(r: DataFrame, nodes: DataFrame) -> DataFrame:
    """Src and dst names of relationships by id; a relationship with an unknown end goes."""
    a = nodes.select(F.col("id").alias("source"), F.col("name").alias("src"))
    b = nodes.select(F.col("id").alias("target"), F.col("name").alias("dst"))
    return r.join(a, "source").join(b, "target")


def attributes_long(e: DataFrame) -> DataFrame:
    """(id, key, value) of scalar attributes, with keys attr_K."""
    return e.select("id", F.explode("attributes").alias("k", "value")).select("id", F.concat(F.lit("attr_"), "k").alias("key"), "value")


def restamp_pages(e: DataFrame, chunks: DataFrame) -> DataFrame:
    """source_pages renewed from the page ranges of the entity's chunks (chunk_id, page_start, page_end)."""
    p = e.select("id", F.explode("source_chunks").alias("chunk_id")).join(chunks, "chunk_id").select("id", F.explode(F.sequence("page_start", "page_end")).alias("p"))
    return e.drop("source_pages").join(p.groupBy("id").agg(F.array_sort(F.collect_set("p")).alias("source_pages")), "id", "left")


def extractable(chunks: DataFrame, least: int = 30) -> DataFrame:
    """Chunks with at least so many characters besides the white space around them."""
    return chunks.where(F.char_length(F.btrim("text", F.lit(" \t\n\v\f\r"))) >= least)


def repeated(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of values that a uniqueness constraint on the column would reject."""
    return df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def detach_delete(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the nodes of ids (id) and without any edge at one of them."""
    left = nodes.join(ids, "id", "left_anti")
    for end in ("src", "dst"):
        edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_anti")
    return left, edges


def check(df: DataFrame, **conditions: Column) -> DataFrame:
    """(name, failures) of row conditions that must hold."""
    counts = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("failures")) for n in conditions))).alias("x")).select("x.*")
