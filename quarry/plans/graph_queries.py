"""Queries over entities, graphs and vectors, each with the SQL that gives the same rows.

The driver tables hold no extracted graph. Stand-ins made of them: parts by name are entities, lineitems
are edges between parts and suppliers, and capitalised words of benchmark passages are the entities of
the flagship query, joined where one follows another, with documents as chunks and pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import chunking, evaluation, graph, keywords, merging, retrieval, summary, vector
from quarry.operators.components import component_sizes, component_summary
from quarry.operators.contains import contains_pairs
from quarry.plans import sql as Q
from quarry.plans.text_queries import questions, texts
from quarry.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def _list(c: str) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


# --- entities -----------------------------------------------------------------------------------

def part_records(spark, d) -> DataFrame:
    """Parts as raw extraction records: the name, the type as description, the brand as alias, the size as chunk and page."""
    p = table(spark, d, "part")
    return p.select(
        F.col("p_name").alias("canonical_name"), F.upper("p_name").alias("name"), F.lit("Tool").alias("type"), F.col("p_type").alias("description"), F.array(F.concat(F.lit(" "), "p_brand")).alias("aliases"),
        F.create_map(F.lit("price"), F.col("p_retailprice").cast("string")).alias("attributes"), (F.col("p_retailprice") / 10000).alias("confidence"), F.concat_ws(" ", "p_brand", "p_type").alias("evidence"),
        F.col("p_size").cast("int").alias("chunk_id"), F.col("p_size").cast("int").alias("page_start"), (F.col("p_size") + 1).cast("int").alias("page_end"), F.col("p_partkey").alias("ord"),
    )


_RECORDS = f"""
raw AS (SELECT {Q.slug('p_name')} || '-technology' AS id, p_name AS canonical_name, trim(p_brand) AS alias, p_type AS description, p_retailprice / 10000 AS confidence,
  p_brand || ' ' || p_type AS evidence, p_retailprice, p_size::INTEGER AS page, p_partkey AS ord FROM part)"""


@query(f"""WITH {_RECORDS}, pg AS (SELECT id, unnest([page, page + 1]) AS p FROM raw)
SELECT id, arg_min(canonical_name, ord) AS canonical_name, string_agg(DISTINCT alias, ',' ORDER BY alias) AS aliases, count(*) AS frequency, round(max(confidence), 6) AS confidence,
  arg_max(description, length(description) * 100000000 - ord) AS description,
  (SELECT string_agg(x, ',' ORDER BY x::INTEGER) FROM (SELECT DISTINCT p::VARCHAR AS x FROM pg WHERE pg.id = raw.id)) AS source_pages,
  string_agg(DISTINCT page::VARCHAR, ',' ORDER BY page::VARCHAR) AS chunk_keys FROM raw GROUP BY id""")
def entity_merge(spark, d) -> DataFrame:
    """P12, A1"""
    e = merging.merge_entities(merging.entities_of(part_records(spark, d)))
    keys = F.array_join(F.array_sort(F.transform("source_chunks", lambda x: x.cast("string"))), ",").alias("chunk_keys")
    return e.select("id", "canonical_name", _list("aliases"), "frequency", F.round("confidence", 6).alias("confidence"), "description", _list("source_pages"), keys)


@query(f"""WITH {_RECORDS} SELECT id, list_reduce(list(evidence ORDER BY ord), lambda s, e: CASE WHEN contains(s, e) THEN s ELSE s || chr(10) || e END) AS evidence,
  '{{"price":"' || arg_max(p_retailprice, ord)::VARCHAR || '"}}' AS attributes FROM raw GROUP BY id""")
def entity_evidence(spark, d) -> DataFrame:
    """A1's evidence fold and attribute maps"""
    e = merging.merge_entities(merging.entities_of(part_records(spark, d)))
    return e.select("id", "evidence", F.to_json("attributes").alias("attributes"))


@query(f"""WITH {_RECORDS}, e AS (SELECT p_partkey::VARCHAR AS id, {Q.norm('p_name')} AS k, p_size AS frequency, length(p_type) AS n, p_partkey AS ord FROM part)
SELECT id, first_value(id) OVER (PARTITION BY k ORDER BY frequency DESC, n DESC, ord) AS survivor FROM e""")
def name_merge_survivor(spark, d) -> DataFrame:
    """A3"""
    e = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("canonical_name"), F.col("p_size").alias("frequency"), F.col("p_type").alias("description"), F.col("p_partkey").alias("ord"))
    return merging.merge_by_name(e)


def line_relations(spark, d) -> DataFrame:
    """Lineitems as relationships from supplier to part, some with ends that don't exist."""
    l = table(spark, d, "lineitem")
    return l.select(
        F.concat(F.lit("s"), F.when(F.col("l_linenumber") == 7, F.col("l_suppkey") + 1000000).otherwise(F.col("l_suppkey"))).alias("source"), F.col("l_returnflag").alias("relation"), F.concat(F.lit("p"), "l_partkey").alias("target"),
        F.lit("").alias("description"), (F.col("l_discount")).alias("confidence"), F.lit(None).cast("string").alias("evidence"), F.array(F.col("l_linenumber").cast("int")).alias("source_pages"), F.array(F.col("l_linenumber").cast("int")).alias("source_chunks"),
        F.lit(1).cast("long").alias("frequency"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )


_LINES = "l AS (SELECT 's' || (CASE WHEN l_linenumber = 7 THEN l_suppkey + 1000000 ELSE l_suppkey END) AS source, l_returnflag AS relation, 'p' || l_partkey AS target, l_discount, l_linenumber FROM lineitem)"
_EDGES = f"{_LINES}, e AS (SELECT DISTINCT source AS src, relation AS rel, target AS dst FROM l WHERE source IN (SELECT 's' || s_suppkey FROM supplier) AND target IN (SELECT 'p' || p_partkey FROM part))"


@query(f"WITH {_LINES} SELECT source, relation, target, count(*) AS frequency, round(max(l_discount), 6) AS confidence, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS source_pages FROM l GROUP BY ALL")
def relationship_merge(spark, d) -> DataFrame:
    """A2"""
    return merging.merge_relationships(line_relations(spark, d)).select("source", "relation", "target", "frequency", F.round("confidence", 6).alias("confidence"), _list("source_pages"))


def nodes(spark, d) -> DataFrame:
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("Supplier").alias("type"))
    return s.unionByName(table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type")))


def edges(spark, d) -> DataFrame:
    e = merging.load_edges(line_relations(spark, d).select("source", "relation", "target"), nodes(spark, d))
    return e.select(F.col("source").alias("src"), F.col("relation").alias("rel"), F.col("target").alias("dst"))


@query(f"WITH {_EDGES} SELECT src, rel, dst FROM e")
def edge_upsert(spark, d) -> DataFrame:
    """J1, C8"""
    return edges(spark, d)


@query(f"WITH {_LINES} SELECT source, relation, count(*) AS n FROM l WHERE source NOT IN (SELECT 's' || s_suppkey FROM supplier) GROUP BY ALL")
def edge_dangling(spark, d) -> DataFrame:
    """J1's losses"""
    lost = line_relations(spark, d).join(nodes(spark, d).select(F.col("id").alias("source")), "source", "left_anti")
    return lost.groupBy("source", "relation").agg(F.count("*").alias("n"))


_NODES = "n AS (SELECT 's' || s_suppkey AS id, 'Supplier' AS type, s_name AS name FROM supplier UNION ALL SELECT 'p' || p_partkey, p_type, p_name FROM part)"
_DEG = f"{_EDGES}, {_NODES}, en AS (SELECT src AS id FROM e UNION ALL SELECT dst FROM e), dg AS (SELECT n.id, count(en.id) AS degree FROM n LEFT JOIN en USING (id) GROUP BY n.id)"


@query(f"WITH {_DEG} SELECT id, degree FROM dg")
def degree(spark, d) -> DataFrame:
    """A7, A10"""
    return graph.degrees(edges(spark, d), nodes(spark, d))


@query(f"WITH {_DEG} SELECT degree, count(*) AS nodes FROM dg GROUP BY degree")
def degree_hist(spark, d) -> DataFrame:
    """A8, A10"""
    return graph.histogram(graph.degrees(edges(spark, d), nodes(spark, d)))


@query(f"WITH {_EDGES}, t AS (SELECT DISTINCT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e) SELECT a AS id, count(*) AS degree FROM t GROUP BY a")
def neighbour_degree(spark, d) -> DataFrame:
    """A8"""
    return graph.neighbour_degrees(edges(spark, d))


@query(f"WITH {_EDGES}, {_NODES}, p AS (SELECT count(*)::BIGINT AS edges FROM (SELECT DISTINCT least(src, dst), greatest(src, dst) FROM e)), c AS (SELECT count(*)::BIGINT AS nodes FROM n) SELECT nodes, edges, round(edges / (nodes * (nodes - 1) / 2.0), 6)::DOUBLE AS density FROM p, c")
def density(spark, d) -> DataFrame:
    """A9"""
    return graph.density(edges(spark, d), nodes(spark, d)).select(F.col("nodes").cast("long"), F.col("edges").cast("long"), "density")


@query(f"WITH {_EDGES}, n AS (SELECT 's' || s_suppkey AS id FROM supplier UNION ALL SELECT 'c' || c_custkey FROM customer) SELECT id FROM n WHERE id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)")
def isolated(spark, d) -> DataFrame:
    """Suppliers and customers that no supply edge touches"""
    n = nodes(spark, d).where("type = 'Supplier'").select("id").unionByName(table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id")))
    return graph.isolated(n, edges(spark, d)).select("id")


@query("SELECT p_type AS type, count(*) AS n FROM part GROUP BY p_type")
def type_counts(spark, d) -> DataFrame:
    """A5"""
    return graph.counts_by(table(spark, d, "part").select(F.col("p_type").alias("type")), "type")


@query(f"SELECT {Q.norm('p_name')} AS name_key, count(*) AS members FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, d) -> DataFrame:
    """A12"""
    return graph.duplicate_names(table(spark, d, "part").select(F.col("p_name").alias("name")))


def _line_edges(spark, d) -> DataFrame:
    """(u, v): documents and the least document that holds one of their lines, by hash; lines of one document make none."""
    t = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).where("line <> ''")
    t = t.select("doc_id", F.unhex(F.md5("line")).alias("line"))
    first = t.groupBy("line").agg(F.min("doc_id").alias("v"), F.max("doc_id").alias("last")).where("v < last").select("line", "v")
    return t.join(first, "line").where("doc_id <> v").select(F.col("doc_id").alias("u"), "v")


def _doc_components(spark, d) -> DataFrame:
    """(component, size) counting documents, components without a line included"""
    from quarry.operators.components import connected

    c = connected(_line_edges(spark, d))
    every = table(spark, d, "documents").select(F.col("doc_id").alias("id")).distinct()
    return every.join(c, "id", "left").groupBy(F.coalesce("component", "id").alias("component")).agg(F.count("*").alias("size"))


@query("""WITH RECURSIVE l AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
s AS (SELECT line, min(doc_id) AS m FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT doc_id) > 1),
e AS (SELECT DISTINCT l.doc_id AS a, s.m AS b FROM l JOIN s USING (line) WHERE l.doc_id <> s.m), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS x FROM documents UNION SELECT r.id, b.b FROM r JOIN b ON b.a = r.x),
c AS (SELECT id, min(x) AS comp FROM r GROUP BY id)
SELECT size, count(*) AS components FROM (SELECT comp, count(*) AS size FROM c GROUP BY comp) GROUP BY size""")
def wcc_sizes(spark, d) -> DataFrame:
    """How many components of documents sharing an exact line have each size"""
    return _doc_components(spark, d).groupBy("size").agg(F.count("*").alias("components"))


def _number(c: str) -> F.Column:
    """Ids of suppliers and parts as numbers, even and odd ones: their minima need no sorting."""
    return F.substring(c, 2, 1 << 20).cast("long") * 2 + F.startswith(c, F.lit("p")).cast("long")


@query(f"WITH RECURSIVE {_EDGES}, {_NODES}, b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), s AS (SELECT DISTINCT a FROM b), r AS (SELECT (SELECT min(a) FROM s) AS x UNION SELECT b.b FROM r JOIN b ON b.a = r.x), big AS (SELECT count(*)::BIGINT AS k FROM r), i AS (SELECT count(*)::BIGINT AS k FROM n WHERE id NOT IN (SELECT a FROM s)) SELECT CASE WHEN big.k = (SELECT count(*) FROM s) THEN 1 + i.k END AS components, big.k AS largest, i.k AS singletons FROM big, i")
def component_stats(spark, d) -> DataFrame:
    """A11 (a)"""
    e = edges(spark, d).select(_number("src").alias("u"), _number("dst").alias("v"))
    return component_summary(component_sizes(e, nodes(spark, d).select(_number("id").alias("id"))))


_TRADE = "t AS (SELECT DISTINCT c.c_nationkey AS src, substr(o.o_orderpriority, 3) AS rel, s.s_nationkey AS dst FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey)"


@query(f"WITH {_TRADE} SELECT x.src AS a, x.dst AS b, x.rel AS rel_ab, y.rel AS rel_ba FROM t x JOIN t y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst")
def reverse_edges(spark, d) -> DataFrame:
    """Nations that buy from each other"""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    e = j.select(F.col("c_nationkey").alias("src"), F.expr("substring(o_orderpriority, 3)").alias("rel"), F.col("s_nationkey").alias("dst")).distinct()
    return graph.reverse_edges(e)


@query(f"WITH {_EDGES}, b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r AS (SELECT 's' || s_suppkey AS id FROM supplier ORDER BY s_suppkey LIMIT 10), h1 AS (SELECT DISTINCT r.id, b.b AS x FROM r JOIN b ON b.a = r.id), h2 AS (SELECT id, x FROM h1 UNION SELECT h1.id, b.b FROM h1 JOIN b ON b.a = h1.x) SELECT r.id, (SELECT count(*) FROM h1 WHERE h1.id = r.id AND x <> r.id)::BIGINT AS hop1, (SELECT count(*) FROM h2 WHERE h2.id = r.id AND x <> r.id)::BIGINT AS hop2 FROM r")
def khop_counts(spark, d) -> DataFrame:
    """C7 from ten roots, as the reference takes at most ten"""
    roots = table(spark, d, "supplier").orderBy("s_suppkey").limit(10).select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    return graph.khop_counts(edges(spark, d), roots)


def tree(spark, d) -> DataFrame:
    """Edges region to nation to customer and nation to supplier."""
    n, c, s = (table(spark, d, t) for t in ("nation", "customer", "supplier"))
    e = lambda df, a, x, r, b, y: df.select(F.concat(F.lit(a), x).alias("src"), F.lit(r).alias("rel"), F.concat(F.lit(b), y).alias("dst"))
    return e(n, "r", "n_regionkey", "HAS_NATION", "n", "n_nationkey").unionByName(e(c, "n", "c_nationkey", "HAS_CUSTOMER", "c", "c_custkey")).unionByName(e(s, "n", "s_nationkey", "HAS_SUPPLIER", "s", "s_suppkey"))


_TREE = "t AS (SELECT 'r' || n_regionkey AS src, 'HAS_NATION' AS rel, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'HAS_CUSTOMER', 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 'HAS_SUPPLIER', 's' || s_suppkey FROM supplier)"


@query(f"""WITH {_TREE}, l1 AS (SELECT n_nationkey AS qid, 'n' || n_nationkey AS id FROM nation),
s1 AS (SELECT qid, src, rel, dst, dst AS id FROM l1 JOIN t ON t.src = l1.id UNION SELECT qid, src, rel, dst, src FROM l1 JOIN t ON t.dst = l1.id),
l2 AS (SELECT DISTINCT qid, id FROM s1 WHERE (qid, id) NOT IN (SELECT qid, id FROM l1)),
s2 AS (SELECT qid, src, rel, dst FROM l2 JOIN t ON t.src = l2.id UNION SELECT qid, src, rel, dst FROM l2 JOIN t ON t.dst = l2.id WHERE (qid, src) NOT IN (SELECT qid, id FROM l1 UNION SELECT qid, id FROM l2))
SELECT qid, min(level)::INTEGER AS level, src, rel, dst FROM (SELECT qid, src, rel, dst, 1 AS level FROM s1 UNION ALL SELECT qid, src, rel, dst, 2 FROM s2) GROUP BY qid, src, rel, dst""")
def bfs_reach(spark, d) -> DataFrame:
    """R7 over two levels from each nation"""
    seeds = table(spark, d, "nation").select(F.col("n_nationkey").alias("qid"), F.concat(F.lit("n"), "n_nationkey").alias("id"))
    return graph.reach(tree(spark, d), seeds, 2)[1].select("qid", "level", "src", "rel", "dst")


@query(f"""WITH {_TREE}, o AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst, rel) AS k FROM t), s AS (SELECT r_regionkey AS qid, 'r' || r_regionkey AS id FROM region),
p1 AS (SELECT qid, [id, dst] AS chain, [1, k] AS o FROM s JOIN o ON o.src = s.id), p2 AS (SELECT qid, chain || [dst] AS chain, o || [k] AS o FROM p1 JOIN o t ON t.src = chain[-1]),
p AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2) SELECT qid, array_to_string(chain, '>') AS chain FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o) AS n FROM p) WHERE n <= 60""")
def path_chains(spark, d) -> DataFrame:
    """The first sixty chains from each region"""
    seeds = table(spark, d, "region").select(F.col("r_regionkey").alias("qid"), F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(1).alias("rank"))
    return graph.paths(tree(spark, d), seeds).select("qid", F.array_join("chain", ">").alias("chain"))


@query(f"WITH {_EDGES}, {_NODES} SELECT a.type AS src_type, rel, b.type AS dst_type, count(*) AS n FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst GROUP BY ALL ORDER BY n DESC, 1, 2, 3 LIMIT 40")
def triple_schema_top40(spark, d) -> DataFrame:
    """A25"""
    return graph.schema_triples(edges(spark, d), nodes(spark, d))


@query("SELECT page, count(DISTINCT p_partkey) AS entities FROM (SELECT p_partkey, unnest([p_size, p_size + 1])::INTEGER AS page FROM part) GROUP BY page")
def pages_per_entity(spark, d) -> DataFrame:
    """A14"""
    e = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("int"), (F.col("p_size") + 1).cast("int")).alias("source_pages"))
    return graph.per_page(e)


@query("""WITH p AS (SELECT doc_id AS page, n_chars AS text_len FROM documents), c AS (SELECT doc_id AS page, count(*) AS n FROM labels GROUP BY 1), e AS (SELECT conv_id AS page, count(*) AS n FROM conversations GROUP BY 1),
r AS (SELECT item_id AS page, count(*) AS n FROM benchmark GROUP BY 1), v AS (SELECT vec_id AS page, count(*) AS n FROM embeddings GROUP BY 1),
j AS (SELECT page, text_len, coalesce(c.n, 0) AS chunks, coalesce(e.n, 0) AS entities, coalesce(r.n, 0) AS relationships, coalesce(v.n, 0) AS nodes FROM p LEFT JOIN c USING (page) LEFT JOIN e USING (page) LEFT JOIN r USING (page) LEFT JOIN v USING (page))
SELECT *, CASE WHEN nodes > 0 THEN 'LINKED' WHEN chunks = 0 THEN 'H1' WHEN entities = 0 AND relationships = 0 THEN 'H2' ELSE 'H3' END AS status FROM j""")
def coverage_status(spark, d) -> DataFrame:
    """A17, D3, with other tables' ids standing in for what covers a page"""
    p = table(spark, d, "documents").select(F.col("doc_id").alias("page"), F.col("n_chars").alias("text_len"))
    k = lambda t, c: table(spark, d, t).select(F.col(c).alias("page"))
    return graph.coverage(p, k("labels", "doc_id"), k("conversations", "conv_id"), k("benchmark", "item_id"), table(spark, d, "embeddings").select(F.col("vec_id").alias("page")))


@query("""WITH k AS (SELECT p_size AS qid, low, row_number() OVER (PARTITION BY p_size ORDER BY m, low) AS r FROM (SELECT p_size, string_split(p_name, ' ')[1] AS low, min(p_partkey) AS m FROM part GROUP BY ALL)),
q AS (SELECT qid, low FROM k WHERE r <= 2), e AS (SELECT p_name AS id, p_name AS name, max(p_type) AS description, count(*) AS frequency FROM part GROUP BY p_name),
h AS (SELECT qid, id, name, frequency, sum(contains(lower(name || ' ' || name || ' '), low)::INTEGER) AS nh, sum(contains(lower(description), low)::INTEGER) AS dh FROM q, e GROUP BY ALL)
SELECT qid, id, nh::BIGINT AS name_hits, dh::BIGINT AS desc_hits, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY nh DESC, dh DESC, frequency DESC, lower(name), id) AS rank FROM h WHERE nh > 0 OR dh > 0) WHERE rank <= 12""")
def entity_contains_match(spark, d) -> DataFrame:
    """For each part size, its first two colour or size words against part names"""
    p = table(spark, d, "part")
    k = p.groupBy(F.col("p_size").alias("qid"), F.element_at(F.split("p_name", " "), 1).alias("low")).agg(F.min("p_partkey").alias("m"))
    kw = k.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("m", "low"))).where("r <= 2")
    e = p.groupBy(F.col("p_name").alias("id")).agg(F.max("p_type").alias("description"), F.count("*").alias("frequency"))
    e = e.select("id", F.col("id").alias("name"), F.col("id").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"), "description", "frequency")
    return retrieval.entity_matches(kw, e)


def terms(spark, d) -> DataFrame:
    """Entities of the flagship query: capitalised words of five letters or more of benchmark passages."""
    w = table(spark, d, "benchmark").select("item_id", "text", F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|[^A-Za-z\p{L}])([A-Z][a-z]{4,})(?![a-z\p{L}])"), F.lit(1))).alias("w"))
    return w.groupBy("w").agg(F.min_by("text", "item_id").alias("text"), F.count("*").alias("n")).select(
        F.col("w").alias("id"), F.col("w").alias("name"), F.lit("Term").alias("type"), F.array().cast("array<string>").alias("aliases"), F.col("text").alias("source_text"), "n"
    )


@query(f"""WITH w AS (SELECT DISTINCT t AS term FROM (SELECT unnest({Q.tokens('text')}) AS t FROM benchmark) WHERE length(t) >= 8), c AS (SELECT doc_id, {Q.alnum('text')} AS c FROM documents)
SELECT term, doc_id FROM w JOIN c ON contains(c.c, w.term)""")
def mention_index(spark, d) -> DataFrame:
    """Long words of benchmark passages in documents run together"""
    w = table(spark, d, "benchmark").select(F.explode(X.tokens("text", 8)).alias("term")).distinct()
    c = table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.alnum("text").alias("text"))
    return contains_pairs(c, w).select("term", F.col("id").alias("doc_id"))


def question_graph(spark, d) -> retrieval.Graph:
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    e = terms(spark, d)
    m = retrieval.mentions(e, chunks, once=False).groupBy("id").agg(F.min("chunk").alias("page"))
    e = e.join(m, "id", "left").select("id", "name", "type", "aliases", "source_text", "page")
    w = table(spark, d, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit(r"(?:^|[^A-Za-z\p{L}])([A-Z][a-z]{4,})(?![a-z\p{L}])"), F.lit(1)).alias("w")).where(F.size("w") > 1)
    pairs = w.select("item_id", F.explode(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w") - 1).alias("b"))).alias("p"))
    ed = pairs.groupBy(F.col("p.a").alias("src"), F.lit("FOLLOWED_BY").alias("rel"), F.col("p.b").alias("dst")).agg(F.min("item_id").alias("page")).where("src <> dst")
    return retrieval.Graph(e, ed.select("src", "rel", "dst", F.lit("").alias("source_text"), "page"), chunks)


@query()
def graph_seeds(spark, d) -> DataFrame:
    """R5"""
    g = question_graph(spark, d)
    kw = keywords.selected_keywords(questions(spark, d), texts(spark, d)).select("qid", "low")
    return retrieval.seeds(kw, g.entities)


@query()
def graph_context(spark, d) -> DataFrame:
    """The context lines of every benchmark question"""
    return retrieval.graph_context(questions(spark, d), question_graph(spark, d))


@query()
def chunk_context(spark, d) -> DataFrame:
    """Keywords, matched terms, the documents that mention them, the best three"""
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("page_start"), F.col("doc_id").alias("page_end"))
    e = terms(spark, d)
    links = retrieval.mentions(e, chunks.select(F.col("chunk_id").alias("id"), "text"), once=False).select("id", F.col("chunk").alias("chunk_id"))
    e = e.select("id", "name", F.col("name").alias("canonical_name"), "aliases", F.lit("").alias("description"), F.col("n").alias("frequency"))
    return retrieval.chunk_context(questions(spark, d), e, chunks, links=links)


# --- vectors and chunks -------------------------------------------------------------------------

_KNN = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS qid, e AS qe FROM v WHERE vec_id % 20 = 0),
s AS (SELECT qid, vec_id, label, round(list_inner_product(qe, e) / (sqrt(list_inner_product(qe, qe)) * sqrt(list_inner_product(e, e))), 6) AS cosine FROM q, v WHERE qid <> vec_id)"""


def _vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    """Every twentieth vector is a query, against all."""
    v = table(spark, d, "embeddings")
    return v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"), v


@query(f"WITH {_KNN} SELECT qid, vec_id, cosine, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, vec_id) AS rank FROM s) WHERE rank <= 5")
def knn_cosine(spark, d) -> DataFrame:
    """V1, T1"""
    return vector.top_k(*_vectors(spark, d))


@query(f"WITH {_KNN} SELECT qid, vec_id, cosine, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, vec_id) AS rank FROM s WHERE label = 3) WHERE rank <= 5")
def knn_filtered(spark, d) -> DataFrame:
    """V3"""
    q, v = _vectors(spark, d)
    return vector.filtered_top_k(q, v, F.col("label") == 3)


@query(f"""WITH RECURSIVE {_KNN}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, vec_id) AS r FROM s) WHERE r <= 20),
likeness AS (SELECT a.qid, a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(x.e, y.e) AS c FROM near a JOIN near b ON a.qid = b.qid AND a.vec_id <> b.vec_id JOIN v x ON x.vec_id = a.vec_id JOIN v y ON y.vec_id = b.vec_id),
picked AS (SELECT DISTINCT qid, []::BIGINT[] AS chosen FROM near UNION ALL
  SELECT qid, list_append(any_value(chosen), first(vec_id ORDER BY worth DESC, r)) FROM (
    SELECT p.qid, p.chosen, n.vec_id, n.r, 0.5 * any_value(n.cosine) - 0.5 * coalesce(max(l.c), 0) AS worth FROM picked p JOIN near n ON n.qid = p.qid AND NOT list_contains(p.chosen, n.vec_id)
    LEFT JOIN likeness l ON l.qid = p.qid AND l.a = n.vec_id AND list_contains(p.chosen, l.b) WHERE len(p.chosen) < 5 GROUP BY p.qid, p.chosen, n.vec_id, n.r) GROUP BY qid),
done AS (SELECT qid, arg_max(chosen, len(chosen)) AS chosen FROM picked GROUP BY qid)
SELECT qid, chosen[rank] AS vec_id, rank::INTEGER AS rank FROM done, range(1, len(chosen) + 1) AS t(rank)""")
def mmr(spark, d) -> DataFrame:
    """V2"""
    return vector.mmr(*_vectors(spark, d))


@query()
def chunk_recursive(spark, d) -> DataFrame:
    """K7"""
    return chunking.chunk(table(spark, d, "documents"), "recursive")


@query()
def chunk_section(spark, d) -> DataFrame:
    """K1-K6, K8"""
    return chunking.chunk(table(spark, d, "documents"), "section")


@query()
def chunk_vector(spark, d) -> DataFrame:
    """K9"""
    return chunking.vector_chunks(table(spark, d, "documents"))


# --- diagnostics --------------------------------------------------------------------------------

_FLAGS = "SELECT d.doc_id, d.doc_id % 13 = 0 AS unsupported, l.doc_id IS NOT NULL AS attached, d.n_chars % 5 AS n_keywords, d.n_chars % 3 AS n_matched, d.n_chars % 2 = 0 AS broad, d.n_chars % 7 AS n_linked, d.n_chars % 11 < 4 AS gt_linked, d.n_chars % 17 < 9 AS holder FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)"


@query(f"""WITH f AS ({_FLAGS}), c AS (SELECT doc_id, CASE WHEN unsupported THEN 8 WHEN attached THEN 0 WHEN n_keywords = 0 THEN 1 WHEN n_matched = 0 AND broad THEN 2 WHEN n_matched = 0 THEN 9 WHEN n_linked = 0 THEN 3 WHEN gt_linked THEN 5 WHEN holder THEN 2 ELSE 4 END AS category FROM f)
SELECT category, count(*) AS n, CASE WHEN category <> 0 THEN round(100.0 * count(*) / (SELECT count(*) FROM c WHERE category <> 0), 4) END AS share FROM c GROUP BY category""")
def failure_classes(spark, d) -> DataFrame:
    """D1, A24, with remainders of document lengths for the flags"""
    n = F.col("n_chars")
    f = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.lit(True).alias("l")).distinct(), "doc_id", "left")
    c = evaluation.failure_class(F.col("doc_id") % 13 == 0, F.col("l").isNotNull(), n % 5, n % 3, n % 2 == 0, n % 7, n % 11 < 4, n % 17 < 9)
    return evaluation.failure_shares(f.select(c.alias("category")))


@query("""SELECT event_type, CASE o WHEN 0 THEN 'S_LLM_CYPHER_SUCCEEDED' WHEN 1 THEN 'E3_CYPHER_SYNTAX_ERROR' WHEN 2 THEN 'UNKNOWN_LOG' ELSE CASE WHEN user_id % 3 = 0 THEN 'E1_INVENTED_PROPERTY_RECOVERED' WHEN user_id % 5 < 2 AND user_id % 2 = 0 THEN 'E2_INFERRED_OVERCONSTRAINED_RECOVERED' WHEN user_id % 5 < 2 THEN 'E6_EVIDENCE_TRUNCATED' ELSE 'E5_GT_PAGE_OUT_OF_CAPS' END END AS failure_class, count(*) AS n
FROM (SELECT *, event_id % 4 AS o FROM events) GROUP BY ALL""")
def outcome_classes(spark, d) -> DataFrame:
    """D2"""
    o, u = F.col("event_id") % 4, F.col("user_id")
    outcome = F.when(o == 0, "success").when(o == 1, "error").when(o == 2, "unknown").otherwise("empty")
    c = evaluation.outcome_class(outcome, u % 3 == 0, u % 5 < 2, u % 2 == 0)
    return table(spark, d, "events").select("event_type", c.alias("failure_class")).groupBy("event_type", "failure_class").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT value > 3 AS np, value > 9 AS op, value > 5 AS nc, value > 8 AS oc, (event_id % 10) / 10.0 + 0.05 AS nr, (event_id % 10) / 10.0 AS ore, event_id % 50 AS cand FROM events),
a AS (SELECT sum(op::INTEGER)::BIGINT AS old_pages, sum(np::INTEGER)::BIGINT AS new_pages, sum(oc::INTEGER)::BIGINT AS old_chunks, sum(nc::INTEGER)::BIGINT AS new_chunks, round(avg(ore), 4) AS old_recall, round(avg(nr), 4) AS new_recall, round(avg(cand), 2) AS mean_candidates, count_if(cand > 80.0)::BIGINT AS broad FROM r)
SELECT *, CASE WHEN (new_pages > old_pages OR new_chunks > old_chunks OR new_recall > old_recall) AND mean_candidates <= 50 AND broad <= 2 THEN 'PASS' ELSE 'NOT APPROVED' END AS verdict, CASE WHEN new_pages > old_pages AND round(new_recall - old_recall, 4) >= 0.05 THEN 'PROCEED' ELSE 'STOP' END AS decision FROM a""")
def gate(spark, d) -> DataFrame:
    """A22, D4"""
    v, i = F.col("value"), F.col("event_id")
    r = table(spark, d, "events").select((v > 3).alias("new_page_on"), (v > 9).alias("old_page_on"), (v > 5).alias("new_chunk_on"), (v > 8).alias("old_chunk_on"), ((i % 10) / 10.0 + 0.05).alias("new_recall"), ((i % 10) / 10.0).alias("old_recall"), (i % 50).alias("new_candidates"))
    return evaluation.gate(r, 100)


@query(f"""WITH p AS (SELECT b.item_id AS qid, {Q.tokens('b.text', 3)} AS e, {Q.tokens('d.text', 3)} AS a FROM benchmark b JOIN documents d ON d.doc_id = b.item_id), s AS (SELECT qid, list_distinct(e) AS e, list_distinct(a) AS a FROM p)
SELECT qid, CASE WHEN len(e) > 0 THEN round(len(list_intersect(e, a))::DOUBLE / len(e), 6) ELSE 0.0 END AS evidence_recall, CASE WHEN len(a) > 0 THEN round(len(list_intersect(e, a))::DOUBLE / len(a), 6) ELSE 0.0 END AS evidence_precision FROM s""")
def evidence_recall(spark, d) -> DataFrame:
    """M11"""
    r = questions(spark, d).join(texts(spark, d).withColumnRenamed("id", "qid"), "qid").select("qid", F.col("question").alias("evidence"), F.col("text").alias("attached"))
    return evaluation.evidence(r).select("qid", "evidence_recall", "evidence_precision")


# --- construction statistics --------------------------------------------------------------------

@query(f"WITH {_RECORDS}, m AS (SELECT id, round(max(confidence), 9) AS confidence FROM raw GROUP BY id) SELECT (SELECT count(*) FROM raw) AS raw, count(*) AS merged, count(*) AS with_aliases, count(*) AS with_description, count(*) AS with_attributes, round(avg(confidence), 3) AS mean_confidence FROM m")
def construction_stats(spark, d) -> DataFrame:
    """A6, C4"""
    e = merging.entities_of(part_records(spark, d))
    return summary.construction(e, merging.merge_entities(e)).withColumn("raw", F.col("raw").cast("long"))


@query("SELECT p_name AS name, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, name LIMIT 20")
def name_frequency(spark, d) -> DataFrame:
    """A13, W9"""
    return summary.name_frequency(table(spark, d, "part").select(F.col("p_name").alias("name")))


@query("SELECT count(DISTINCT page) AS pages FROM (SELECT unnest([p_size, p_size + 1]) AS page FROM part)")
def linked_pages(spark, d) -> DataFrame:
    """A15"""
    return summary.linked_pages(table(spark, d, "part").select(F.array("p_size", F.col("p_size") + 1).alias("source_pages")))


@query(f"""WITH e AS (SELECT DISTINCT p_name AS id, unnest(list_distinct({Q.tokens("p_name || ' ' || p_type", 3)})) AS t FROM part), q AS (SELECT s_suppkey AS qid, unnest(list_distinct({Q.tokens("s_name || CASE s_suppkey % 3 WHEN 0 THEN ' blue widget' WHEN 1 THEN ' SMALL bolts' ELSE '' END", 3)})) AS t FROM supplier)
SELECT qid, id, count(*) AS shared FROM q JOIN e USING (t) GROUP BY qid, id""")
def question_entities(spark, d) -> DataFrame:
    """Suppliers with made-up questions against part names, with types as aliases"""
    k = F.col("s_suppkey") % 3
    q = table(spark, d, "supplier").select(F.col("s_suppkey").alias("qid"), F.concat("s_name", F.when(k == 0, " blue widget").when(k == 1, " SMALL bolts").otherwise("")).alias("question"))
    e = table(spark, d, "part").groupBy(F.col("p_name").alias("id")).agg(F.collect_set("p_type").alias("aliases")).withColumn("name", F.col("id"))
    return summary.question_entities(q, e)


@query("SELECT DISTINCT page, p_partkey AS id FROM (SELECT p_partkey, unnest([p_size, p_size + 1]) AS page FROM part) WHERE page IN (SELECT n_nationkey FROM nation)")
def page_holders(spark, d) -> DataFrame:
    """Parts linked to pages numbered like nations"""
    e = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array("p_size", F.col("p_size") + 1).alias("source_pages"))
    return summary.holders(e, table(spark, d, "nation").select(F.col("n_nationkey").alias("page")))


@query(f"""WITH {_TREE}, o AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst, rel) AS k FROM t), s AS (SELECT r_regionkey AS qid, 'r' || r_regionkey AS id FROM region),
p1 AS (SELECT qid, [id, dst] AS chain, [1, k] AS o FROM s JOIN o ON o.src = s.id), p2 AS (SELECT qid, chain || [dst] AS chain, o || [k] AS o FROM p1 JOIN o t ON t.src = chain[-1]),
p AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2), f AS (SELECT chain FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o) AS n FROM p) WHERE n <= 60),
c AS (SELECT count(DISTINCT x) AS n FROM (SELECT unnest(chain) AS x FROM f)), v AS (SELECT count(DISTINCT x) AS n FROM (SELECT src AS x FROM t UNION ALL SELECT dst FROM t))
SELECT round(avg(len(chain) - 1), 6) AS mean_hops, round(avg(CASE WHEN len(chain) > 2 THEN 1.0 ELSE 0.0 END), 6) AS multi_hop_share, round(100.0 * any_value(c.n) / any_value(v.n), 4) AS coverage FROM f, c, v""")
def path_statistics(spark, d) -> DataFrame:
    """A23"""
    e = tree(spark, d)
    seeds = table(spark, d, "region").select(F.col("r_regionkey").alias("qid"), F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(1).alias("rank"))
    n = e.select(F.explode(F.array("src", "dst")).alias("x")).distinct().count()
    return summary.path_statistics(graph.paths(e, seeds), n)


@query()
def chunk_starts(spark, d) -> DataFrame:
    """A16"""
    return summary.chunk_starts(chunking.chunk(table(spark, d, "documents")))
