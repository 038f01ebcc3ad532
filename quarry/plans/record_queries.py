"""Queries over extraction records, contexts and files, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import chunking, evaluation, graph, keywords, merging, retrieval, vector
from quarry.operators.components import shared_folder
from quarry.operators.contains import contains_pairs
from quarry.plans import graph_queries as G
from quarry.plans import sql as Q
from quarry.plans import text_queries as TQ
from quarry.sources import tables as S
from quarry.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


# --- relationships ------------------------------------------------------------------------------

def part_relations(spark, d) -> DataFrame:
    """Raw relationships from each part to the next: the source as written, in other cases or unknown, the target in this chunk or in another, some ends empty."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    k = F.col("p_partkey") % 4
    source = F.when(k == 0, F.col("p_name")).when(k == 1, F.upper("p_name")).when(k == 2, F.initcap("p_name")).otherwise(F.lit("Unknown thing"))
    return p.join(nxt, "p_partkey").select(
        source.alias("source"), F.concat(F.lit(" "), "p_type").alias("relation"), F.when(F.col("p_partkey") % 7 == 0, " ").otherwise(F.col("next")).alias("target"), F.lit("d").alias("description"),
        F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("evidence"), F.col("p_size").cast("int").alias("chunk_id"),
        F.col("p_size").cast("int").alias("page_start"), F.col("p_size").cast("int").alias("page_end"), F.col("p_partkey").alias("ord"),
    )


def resolved(spark, d) -> DataFrame:
    return merging.relationships_of(part_relations(spark, d), merging.entities_of(G.part_records(spark, d)))


_ID = Q.slug("p_name") + " || '-technology'"
_RESOLVED = f"""
ent AS (SELECT p_name, p_size, p_partkey, {_ID} AS id FROM part),
names AS (SELECT p_size, p_name AS n, id, p_partkey FROM ent UNION ALL SELECT p_size, upper(p_name), id, p_partkey FROM ent),
exact AS (SELECT p_size, n, arg_max(id, p_partkey) AS id FROM names GROUP BY ALL), loose AS (SELECT p_size, lower(n) AS n, arg_min(id, p_partkey) AS id FROM names GROUP BY ALL),
raw AS (SELECT p.p_partkey AS ord, p.p_size, upper(replace({Q.mapped("p.p_type", X.RELATIONS)}, ' ', '_')) AS relation,
  CASE p.p_partkey % 4 WHEN 0 THEN p.p_name WHEN 1 THEN upper(p.p_name) WHEN 2 THEN array_to_string(list_transform(string_split(lower(p.p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE 'Unknown thing' END AS s,
  CASE WHEN p.p_partkey % 7 = 0 THEN '' ELSE q.p_name END AS t FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1),
res AS (SELECT raw.ord, raw.relation, coalesce(a.id, b.id, {Q.slug("s")} || '-cross-chunk') AS source, coalesce(x.id, y.id, {Q.slug("t")} || '-cross-chunk') AS target FROM raw
  LEFT JOIN exact a ON a.p_size = raw.p_size AND a.n = s LEFT JOIN loose b ON b.p_size = raw.p_size AND b.n = lower(s)
  LEFT JOIN exact x ON x.p_size = raw.p_size AND x.n = t LEFT JOIN loose y ON y.p_size = raw.p_size AND y.n = lower(t) WHERE t <> ''),
rel AS (SELECT * FROM res WHERE source <> target)"""


@query(f"WITH {_RESOLVED} SELECT ord, source, relation, target, 0.5::DOUBLE AS confidence FROM rel")
def relationship_resolve(spark, d) -> DataFrame:
    """P13, J4"""
    return resolved(spark, d).select("ord", "source", "relation", "target", "confidence")


@query(f"""WITH {_RESOLVED}, me AS (SELECT id, min(p_partkey) AS ord, arg_min(p_name, p_partkey) AS name FROM ent GROUP BY id), sl AS (SELECT id, ord, {Q.slug("name")} AS s FROM me),
ks AS (SELECT id, ord, 0 AS k, s AS slug FROM sl UNION ALL SELECT id, ord, 1, CASE WHEN contains(s, '-') THEN regexp_replace(s, '-[^-]*$', '') ELSE s END FROM sl),
keys AS (SELECT slug, arg_max(id, ord * 2 + k) AS id FROM ks GROUP BY slug)
SELECT rel.ord, coalesce(a.id, source) AS source, relation, coalesce(b.id, target) AS target FROM rel
LEFT JOIN keys a ON ends_with(source, '-cross-chunk') AND a.slug = replace(source, '-cross-chunk', '') LEFT JOIN keys b ON ends_with(target, '-cross-chunk') AND b.slug = replace(target, '-cross-chunk', '')""")
def cross_chunk_resolve(spark, d) -> DataFrame:
    """J3"""
    e = merging.merge_entities(merging.entities_of(G.part_records(spark, d)))
    return merging.resolve_cross_chunk(resolved(spark, d), e).select("ord", "source", "relation", "target")


def part_entities(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("canonical_name"), F.col("p_type").alias("description"), F.lit(1).cast("long").alias("frequency"), F.col("p_partkey").alias("ord"))


def rewired(spark, d) -> DataFrame:
    """Lineitems as relationships between parts, some by name and some to nothing, moved to the survivors of equal names."""
    e = part_entities(spark, d)
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    n = F.col("l_linenumber")
    target = F.when(n == 7, F.concat("p_name", F.lit(merging.CROSS))).when(n == 6, F.concat(F.lit("nothing "), "l_suppkey")).otherwise(F.concat(F.lit("p"), "l_suppkey"))
    r = table(spark, d, "lineitem").join(p, "l_partkey").select(F.concat(F.lit("p"), "l_partkey").alias("source"), F.col("l_returnflag").alias("relation"), target.alias("target"))
    return merging.rewire(r, e, merging.merge_by_name(e))


_REWIRED = f"""
pe AS (SELECT 'p' || p_partkey AS id, p_name, {Q.norm("p_name")} AS k, {Q.alnum("p_name")} AS a, length(p_type) AS n, p_partkey FROM part),
sv AS (SELECT id, first_value(id) OVER (PARTITION BY k ORDER BY n DESC, p_partkey) AS survivor FROM pe), near AS (SELECT a, min(id) AS id FROM pe GROUP BY a),
r0 AS (SELECT 'p' || l_partkey AS source, l_returnflag AS relation, CASE l_linenumber WHEN 7 THEN p_name || '-cross-chunk' WHEN 6 THEN 'nothing ' || l_suppkey ELSE 'p' || l_suppkey END AS target FROM lineitem JOIN part ON p_partkey = l_partkey),
r1 AS (SELECT s.survivor AS source, relation, coalesce(t.survivor, near.id) AS target FROM r0 JOIN sv s ON s.id = source LEFT JOIN sv t ON t.id = target LEFT JOIN near ON near.a = {Q.alnum("replace(target, '-cross-chunk', '')")}),
rw AS (SELECT *, CASE WHEN target IS NULL THEN 'unresolvable' WHEN source = target THEN 'self_loop' ELSE 'kept' END AS fate FROM r1)"""


@query(f"WITH {_REWIRED} SELECT source, relation, target, fate, count(*) AS n FROM rw GROUP BY ALL")
def rewire_edges(spark, d) -> DataFrame:
    """J5, J6"""
    return rewired(spark, d).groupBy("source", "relation", "target", "fate").agg(F.count("*").alias("n"))


@query(f"WITH {_REWIRED} SELECT count_if(fate = 'unresolvable')::BIGINT AS unresolvable, count_if(fate = 'self_loop')::BIGINT AS self_loop, (count_if(fate = 'kept') - (SELECT count(*) FROM (SELECT DISTINCT source, relation, target FROM rw WHERE fate = 'kept')))::BIGINT AS duplicate FROM rw")
def rewire_collapse(spark, d) -> DataFrame:
    """A4"""
    return merging.rewire_counts(rewired(spark, d))


@query(f"WITH {G._LINES}, {G._NODES} SELECT a.name AS src, relation, b.name AS dst, count(*) AS n FROM l JOIN n a ON a.id = source JOIN n b ON b.id = target GROUP BY ALL")
def named_edges(spark, d) -> DataFrame:
    """J2"""
    r = merging.with_names(G.line_relations(spark, d), G.nodes(spark, d))
    return r.groupBy("src", "relation", "dst").agg(F.count("*").alias("n"))


@query(f"SELECT {_ID} AS id, 'attr_price' AS key, arg_max(p_retailprice, p_partkey)::DOUBLE AS value FROM part GROUP BY 1")
def attribute_rows(spark, d) -> DataFrame:
    """P18, A1's last writer"""
    e = merging.merge_entities(merging.entities_of(G.part_records(spark, d)))
    return merging.attributes_long(e).withColumn("value", F.col("value").cast("double"))


@query(f"WITH c AS (SELECT DISTINCT {_ID} AS id, p_size FROM part), pg AS (SELECT DISTINCT id, unnest([2 * p_size, 2 * p_size + 1])::INTEGER AS p FROM c) SELECT id, string_agg(p::VARCHAR, ',' ORDER BY p) AS source_pages FROM pg GROUP BY id")
def restamped_pages(spark, d) -> DataFrame:
    """Pages of entities renewed from their chunks, of two pages each"""
    e = merging.merge_entities(merging.entities_of(G.part_records(spark, d)))
    c = table(spark, d, "part").select(F.col("p_size").cast("int").alias("chunk_id")).distinct()
    c = c.select("chunk_id", (2 * F.col("chunk_id")).alias("page_start"), (2 * F.col("chunk_id") + 1).alias("page_end"))
    return merging.restamp_pages(e, c).select("id", G._list("source_pages"))


@query("SELECT unnest(['has_name', 'known_type', 'small']) AS name, unnest([count_if(NOT coalesce(length(p_name) > 0, false)), count_if(NOT coalesce(p_type <> 'LARGE', false)), count_if(NOT coalesce(p_size < 25, false))])::BIGINT AS failures FROM part")
def load_checks(spark, d) -> DataFrame:
    """D8"""
    return merging.check(table(spark, d, "part"), has_name=F.length("p_name") > 0, known_type=F.col("p_type") != "LARGE", small=F.col("p_size") < 25)


@query("SELECT p_name AS key, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def repeated_keys(spark, d) -> DataFrame:
    """What a uniqueness constraint on part names would reject"""
    return merging.repeated(table(spark, d, "part"), "p_name")


@query(f"WITH {G._EDGES}, {G._NODES}, g AS (SELECT id FROM n WHERE type = 'PROMO' OR name LIKE '%1') SELECT src, count(*) AS n FROM e WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g) GROUP BY src")
def detach_delete(spark, d) -> DataFrame:
    """Edges left after nodes are deleted with theirs"""
    n = G.nodes(spark, d)
    gone = n.where("type = 'PROMO' or name like '%1'").select("id")
    return merging.detach_delete(n, G.edges(spark, d), gone)[1].groupBy("src").agg(F.count("*").alias("n"))


@query(f"WITH {G._EDGES}, {G._NODES} SELECT a.name AS src, b.name AS dst, count(*) AS n FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE a.type = 'Supplier' AND e.rel = 'R' AND b.type = 'ECONOMY' GROUP BY ALL")
def typed_pattern(spark, d) -> DataFrame:
    """(:Supplier)-[R]->(:ECONOMY)"""
    m = graph.pattern(G.edges(spark, d), G.nodes(spark, d), "Supplier", "R", "ECONOMY")
    return m.groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"WITH n AS (SELECT s_suppkey AS id, {Q.norm('s_name')} AS k, {Q.norm('lag(s_name) OVER (ORDER BY s_suppkey)')} AS al FROM supplier) SELECT DISTINCT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM n a JOIN n b ON a.k = b.al AND a.id <> b.id WHERE a.k <> ''")
def alias_collisions(spark, d) -> DataFrame:
    """Suppliers whose alias is the name of the one before"""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    before = s.select((F.col("id") + 1).alias("id"), F.col("name").alias("alias"))
    n = s.join(before, "id", "left").select("id", "name", F.when(F.col("alias").isNull(), F.array().cast("array<string>")).otherwise(F.array("alias")).alias("aliases"))
    return graph.alias_collisions(n)


_TREE_NODES = "tn AS (SELECT 'r' || r_regionkey AS id, r_name AS name, '' AS sd FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey)"


def tree_nodes(spark, d) -> DataFrame:
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    a = r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("").alias("description"))
    b = n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("description"))
    return a.unionByName(b).select("*", F.col("name").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"), F.lit(1).cast("long").alias("frequency"))


@query(f"""WITH {G._TREE}, {_TREE_NODES}, e AS (SELECT * FROM t WHERE rel = 'HAS_NATION'), m AS (SELECT r_regionkey AS qid, tn.* FROM region, tn WHERE contains(lower(name), lower(r_name)) OR contains(lower(sd), lower(r_name))),
j AS (SELECT m.qid, m.id, e.rel, e.dst, m.name AS s, m.sd, b.name AS tt, b.sd AS td FROM m LEFT JOIN e ON e.src = m.id LEFT JOIN tn b ON b.id = e.dst),
k AS (SELECT qid, id, rel, dst, s || ' -[' || coalesce(rel, '') || ']-> ' || coalesce(tt, '?') || CASE WHEN sd = '' THEN '' ELSE ' | ' || s || ': ' || sd END || CASE WHEN coalesce(td, '') = '' THEN '' ELSE ' | ' || coalesce(tt, '?') || ': ' || td END AS line FROM j WHERE NOT (rel IS NULL AND tt IS NULL AND sd = '' AND coalesce(td, '') = ''))
SELECT qid, rank::INTEGER AS rank, line FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY id, rel NULLS LAST, dst NULLS LAST) AS rank FROM k) WHERE rank <= 25""")
def neighbour_lines(spark, d) -> DataFrame:
    """Regions and nations named like a region, with what they lead to"""
    kw = table(spark, d, "region").select(F.col("r_regionkey").alias("qid"), F.lower("r_name").alias("low"))
    return retrieval.neighbour_context(kw, tree_nodes(spark, d), G.tree(spark, d).where("rel = 'HAS_NATION'"))


@query(f"""WITH {G._TREE}, e AS (SELECT DISTINCT src, rel, dst, src || chr(1) || rel || chr(1) || dst AS eid FROM t), b AS (SELECT src AS a, dst AS b, eid FROM e UNION ALL SELECT dst, src, eid FROM e WHERE src <> dst),
l1 AS (SELECT r_regionkey AS qid, ['r' || r_regionkey, b.b] AS chain, [eid] AS used FROM region JOIN b ON b.a = 'r' || r_regionkey),
l2 AS (SELECT qid, chain || [b.b] AS chain, used || [eid] AS used FROM l1 JOIN b ON b.a = chain[-1] WHERE NOT list_contains(used, eid)), l AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2)
SELECT qid, array_to_string(chain, '>') AS chain FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY chain, used) AS n FROM l) WHERE n <= 50""")
def neighbourhood(spark, d) -> DataFrame:
    """The first fifty trails of up to two steps from each region"""
    seeds = table(spark, d, "region").select(F.col("r_regionkey").alias("qid"), F.concat(F.lit("r"), "r_regionkey").alias("id"))
    return graph.neighbourhood(G.tree(spark, d), seeds).select("qid", F.array_join("chain", ">").alias("chain"))


# --- contexts -----------------------------------------------------------------------------------

@query("""WITH k AS (SELECT p_size AS qid, low, row_number() OVER (PARTITION BY p_size ORDER BY m, low) AS r FROM (SELECT p_size, string_split(p_name, ' ')[1] AS low, min(p_partkey) AS m FROM part GROUP BY ALL)),
q AS (SELECT qid, low FROM k WHERE r <= 2), e AS (SELECT p_name AS id, max(p_type) AS description, count(*) AS frequency, list_sort(list(DISTINCT p_size))[1:2] AS pages FROM part GROUP BY p_name),
h AS (SELECT qid, id, any_value(pages) AS pages, any_value(frequency) AS f, sum(contains(lower(id || ' ' || id || ' '), low)::INTEGER) AS nh, sum(contains(lower(description), low)::INTEGER) AS dh FROM q, e GROUP BY qid, id),
m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY nh DESC, dh DESC, f DESC, lower(id), id) AS rank FROM h WHERE nh > 0 OR dh > 0),
p AS (SELECT qid, u.page, min(rank * 10 + u.pos) AS o FROM m, unnest(pages) WITH ORDINALITY AS u(page, pos) WHERE rank <= 6 GROUP BY ALL),
t AS (SELECT qid, page, text, row_number() OVER (PARTITION BY qid ORDER BY o, page) AS rank FROM p JOIN documents ON doc_id = page)
SELECT qid, rank::INTEGER AS rank, page::INTEGER AS page, CASE WHEN length(text) > 500 THEN text[1:500] || '...' ELSE text END AS text FROM t WHERE rank <= 3""")
def page_context(spark, d) -> DataFrame:
    """The keywords of entity_contains_match, parts on the pages of their sizes"""
    p = table(spark, d, "part")
    k = p.groupBy(F.col("p_size").alias("qid"), F.element_at(F.split("p_name", " "), 1).alias("low")).agg(F.min("p_partkey").alias("m"))
    kw = k.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("m", "low"))).where("r <= 2")
    e = p.groupBy(F.col("p_name").alias("id")).agg(F.max("p_type").alias("description"), F.count("*").alias("frequency"), F.array_sort(F.collect_set(F.col("p_size").cast("int"))).alias("source_pages"))
    e = e.select("*", F.col("id").alias("name"), F.col("id").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"))
    return retrieval.page_context(kw, e, table(spark, d, "documents").select(F.col("doc_id").cast("int").alias("page"), "text"))


@query(f"""WITH {TQ._LEXICAL}, s AS (SELECT qid, id, id AS page, rank FROM top WHERE rank <= 3), side AS (SELECT qid, page - 1 AS page, rank * 2 AS o FROM s UNION ALL SELECT qid, page + 1, rank * 2 + 1 FROM s),
x AS (SELECT qid, page AS id, min(o) AS o FROM side WHERE page IN (SELECT doc_id FROM documents) GROUP BY ALL), y AS (SELECT * FROM x ANTI JOIN s ON s.qid = x.qid AND s.id = x.id),
a AS (SELECT qid, id, 0 AS late, rank AS o FROM s UNION ALL SELECT qid, id, 1, o FROM y)
SELECT qid, id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY late, o, id) AS rank FROM a) WHERE rank <= 14""")
def page_fill(spark, d) -> DataFrame:
    """The best three documents of a question and then those next to them"""
    top = TQ.lexical_topk(spark, d).select("qid", "id", F.col("id").alias("page"), "rank")
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("page"))
    return retrieval.fill(top, chunks).select("qid", "id", "rank")


@query("SELECT doc_id, pos::INTEGER - 1 AS pos FROM (SELECT doc_id, u.pos, row_number() OVER (PARTITION BY doc_id, u.line ORDER BY u.pos) AS n FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, pos) WHERE text IS NOT NULL) WHERE n = 1")
def first_lines(spark, d) -> DataFrame:
    """The lines of each document, once each"""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return retrieval.first_lines(lines).select(F.col("qid").alias("doc_id"), F.col("ord").alias("pos"))


@query(f"""WITH {TQ._LEXICAL}, w AS (SELECT qid, count(*) AS n FROM qt GROUP BY qid), c AS (SELECT ov.qid, id, overlap / n::DOUBLE AS coverage, overlap = n AS contained FROM ov JOIN w USING (qid))
SELECT qid, id AS page, round(coverage, 6) AS coverage, contained FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY coverage DESC, id) AS r FROM c) WHERE r = 1""")
def truth_coverage(spark, d) -> DataFrame:
    """The page that covers most of a passage's tokens, and whether it has them all"""
    pages = TQ.texts(spark, d)
    return retrieval.best_coverage(TQ.questions(spark, d), pages).select("qid", F.col("id").alias("page"), F.round("coverage", 6).alias("coverage"), "contained")


@query(f"""WITH {TQ._LEXICAL}, truth AS (SELECT b.item_id AS qid, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), cand AS (SELECT * FROM top WHERE rank <= 10)
SELECT qid, min(cand.rank)::INTEGER AS rank FROM truth LEFT JOIN cand USING (qid, id) GROUP BY qid""")
def truth_rank(spark, d) -> DataFrame:
    """Where the lexical search first finds a document that has the passage"""
    passages = table(spark, d, "benchmark").select("item_id", F.col("text").alias("term"))
    has = contains_pairs(TQ.texts(spark, d), passages.select("term").distinct())
    truth = has.join(passages, "term").select(F.col("item_id").alias("qid"), "id").distinct()
    top = retrieval.lexical_top_k(TQ.questions(spark, d), TQ.texts(spark, d), 10)
    return evaluation.truth_rank(top, truth).select("qid", F.col("rank").cast("int").alias("rank"))


@query(f"""WITH {TQ._LEXICAL}, own AS (SELECT b.item_id AS qid, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
s AS (SELECT qid, id, false AS fallback FROM own UNION ALL SELECT qid, id, true FROM top WHERE rank <= 3 AND qid NOT IN (SELECT qid FROM own)) SELECT * FROM s""")
def fallback_context(spark, d) -> DataFrame:
    """Documents that hold the passage; without any, what the lexical search finds"""
    passages = table(spark, d, "benchmark").select("item_id", F.col("text").alias("term"))
    has = contains_pairs(TQ.texts(spark, d), passages.select("term").distinct()).join(passages, "term").select(F.col("item_id").alias("qid"), "id").distinct()
    return retrieval.with_fallback(has, TQ.lexical_topk(spark, d).select("qid", "id"))


_FALLBACK_STOP = "(" + ", ".join(f"'{w}'" for w in keywords.FALLBACK_STOP_WORDS) + ")"


@query(rf"""WITH b AS (SELECT item_id AS qid, regexp_replace(text, '[^\x00-\x7F]', '_', 'g') AS text FROM benchmark),
p AS (SELECT qid, list_filter(regexp_extract_all(text, '\b(?:[A-Z][A-Za-z0-9.\-]*|\d+)(?:\s+(?:[A-Z][A-Za-z0-9.\-]*|\d+))+\b'), lambda x: x <> '') AS s, list_filter(regexp_extract_all(text, '\b[A-Z][A-Za-z0-9.\-]{{2,}}\b'), lambda x: lower(x) NOT IN {_FALLBACK_STOP}) AS c,
  list_filter(regexp_extract_all(text, '\b[a-z][a-z0-9.\-]{{2,}}\b'), lambda x: lower(x) NOT IN {_FALLBACK_STOP}) AS l FROM b),
k AS (SELECT qid, u.pos, trim(trim(trim(u.w), '?. ,;:!')) AS kw FROM p, unnest(CASE WHEN len(s) > 0 THEN s WHEN len(c) > 0 THEN c ELSE l END) WITH ORDINALITY AS u(w, pos)),
o AS (SELECT qid, arg_min(kw, pos) AS keyword, min(pos) AS pos FROM k WHERE kw <> '' AND lower(kw) NOT IN {_FALLBACK_STOP} GROUP BY qid, lower(kw))
SELECT qid, keyword, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS rank FROM o) WHERE rank <= 3""")
def first_keywords(spark, d) -> DataFrame:
    """R1 (no benchmark text has quotes)"""
    return keywords.first_keywords(TQ.questions(spark, d))


@query("""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT qid, v.vec_id, v.label, round(list_cosine_similarity(q.e, v.embedding::DOUBLE[]), 6) AS c FROM q, embeddings v WHERE v.vec_id <> qid),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, vec_id) AS rank FROM s)
SELECT qid, string_agg('[Page ' || label || ']' || chr(10) || 'vector ' || vec_id, chr(10) || chr(10) ORDER BY rank) AS context FROM r WHERE rank <= 3 GROUP BY qid""")
def vector_context(spark, d) -> DataFrame:
    """V5: what the three nearest vectors stand for, by page"""
    e = table(spark, d, "embeddings")
    top = vector.top_k(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"), e, 4).where("qid <> vec_id")
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where("rank <= 3")
    return vector.formatted(top.select("qid", "vec_id", "rank"), e.select("vec_id", F.col("label").alias("page"), F.concat(F.lit("vector "), "vec_id").alias("text")))


@query(f"""WITH {Q.TURNS}, {TQ._METRICS_SQL}, c AS (SELECT m.*, d.lang FROM m LEFT JOIN documents d ON d.doc_id = m.conv_id),
a AS ({" UNION ALL ".join(f"SELECT '{n}' AS metric, round(avg({n}) FILTER (lang = 'en'), 6) AS vector, round(avg({n}), 6) AS graph FROM c" for n in TQ._NAMES)})
SELECT *, round(graph - vector, 4) AS difference, CASE WHEN round(graph - vector, 4) > 0 THEN 'Graph' WHEN round(graph - vector, 4) < 0 THEN 'Vector' ELSE 'Tie' END AS winner FROM a""")
def comparison_table(spark, d) -> DataFrame:
    """M10, with conversations of English documents on the one side and all on the other"""
    t = TQ.turns(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), "lang"), "conv_id", "left")
    rows = evaluation.rolled_up(evaluation.scored(t.withColumn("category", F.coalesce("lang", F.lit("none")))))
    return evaluation.comparison(rows.where("category = 'en'"), rows.where("category is null"))


@query("SELECT a.conv_id * 1000 + a.turn AS question_id, a.text AS before, b.text AS after FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user'")
def before_after(spark, d) -> DataFrame:
    """What was asked and what was said next"""
    c = table(spark, d, "conversations")
    key = lambda shift: (F.col("conv_id") * 1000 + F.col("turn") - shift).alias("question_id")
    asked, said = c.where("role = 'user'").select(key(0), F.col("text").alias("answer")), c.where("role = 'assistant'").select(key(1), F.col("text").alias("answer"))
    return evaluation.before_after(asked, said)


# --- chunks -------------------------------------------------------------------------------------

@query("SELECT page, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS chunk_ids FROM (SELECT p_partkey, unnest(range(p_size, p_size + p_partkey % 3 + 1))::INTEGER AS page FROM part) GROUP BY page")
def page_chunks(spark, d) -> DataFrame:
    """Parts as chunks of one to three pages"""
    c = table(spark, d, "part").select(F.lit(0).alias("doc_id"), F.col("p_partkey").alias("chunk_id"), F.col("p_size").cast("int").alias("page_start"), (F.col("p_size") + F.col("p_partkey") % 3).cast("int").alias("page_end"))
    return chunking.page_chunks(c).select("page", G._list("chunk_ids"))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.n_chars AS a, l.n AS b FROM documents d FULL JOIN (SELECT doc_id, length(text)::BIGINT AS n FROM documents SEMI JOIN labels USING (doc_id)) l ON l.doc_id = d.doc_id WHERE d.n_chars IS DISTINCT FROM l.n")
def chunk_differences(spark, d) -> DataFrame:
    """Documents against a rebuilt store that holds the labelled ones"""
    t, zero = table(spark, d, "documents"), F.lit(0).alias("chunk_id")
    built = t.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", zero, F.char_length("text").cast("long").alias("char_count"))
    return chunking.differing_chunks(t.select("doc_id", zero, F.col("n_chars").alias("char_count")), built).select("doc_id", "a", "b")


@query("SELECT conv_id AS doc_id, turn AS chunk_id, CASE WHEN lag(text) OVER w IS NULL THEN text ELSE right(lag(text) OVER w, 40) || chr(10) || text END AS text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def chunk_overlap(spark, d) -> DataFrame:
    """Turns led by the end of the one before"""
    return chunking.overlapped(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_id"), "text"), 40)


@query("SELECT doc_id FROM documents WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 30")
def extractable(spark, d) -> DataFrame:
    """P14"""
    return merging.extractable(table(spark, d, "documents")).select("doc_id")


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS preview FROM documents")
def previews(spark, d) -> DataFrame:
    """P19"""
    return table(spark, d, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query("WITH a AS (SELECT p_partkey, [p_partkey::VARCHAR, 'x', p_size::VARCHAR, '', '7.5', NULL] AS v FROM part), i AS (SELECT p_partkey, list_filter(list_transform(v, lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN x::INTEGER END), lambda x: x IS NOT NULL) AS v FROM a) SELECT p_partkey, array_to_string(v, ',') AS ints, list_filter(v, lambda x: x BETWEEN 2 AND 61)[1] AS page FROM i")
def valid_pages(spark, d) -> DataFrame:
    """P15, P16"""
    v = F.array(F.col("p_partkey").cast("string"), F.lit("x"), F.col("p_size").cast("string"), F.lit(""), F.lit("7.5"), F.lit(None).cast("string"))
    return table(spark, d, "part").select("p_partkey", F.array_join(X.ints(v).cast("array<string>"), ",").alias("ints"), X.first_page(v).alias("page"))


@query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 5")
def first_chunks(spark, d) -> DataFrame:
    """T3"""
    return table(spark, d, "documents").orderBy("doc_id").limit(5).select("doc_id", "text")


# --- files --------------------------------------------------------------------------------------

def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("SELECT doc_id::INTEGER AS page, text FROM documents WHERE text <> ''")
def pages_from_json(spark, d) -> DataFrame:
    """S4 over arrays of pages written as files"""
    f = _folder(spark)
    S.write_json_arrays(table(spark, d, "documents").select(F.col("doc_id").alias("page"), "text"), f)
    return S.read_pages(spark, f)


@query("SELECT item_id::INTEGER AS id, 'hard' AS category, text AS question, text AS ground_truth FROM benchmark")
def questions_from_json(spark, d) -> DataFrame:
    """S6, under the other names of two fields"""
    f = _folder(spark)
    S.write_json_arrays(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("hard").alias("difficulty"), F.col("text").alias("question"), F.col("text").alias("answer")), f)
    return S.read_questions(spark, f)


@query("SELECT p_partkey::INTEGER AS chunk_id, p_name AS text, p_size::INTEGER AS page_start, p_size::INTEGER + 1 AS page_end, p_type AS section_title, length(p_name)::INTEGER AS char_count FROM part")
def chunks_from_json(spark, d) -> DataFrame:
    """S8, with the text under another name in each of two folders"""
    f = _folder(spark)
    p = lambda name: table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias(name), F.col("p_size").alias("page_start"), (F.col("p_size") + 1).alias("page_end"), F.col("p_type").alias("section_title"), F.char_length("p_name").alias("char_count"))
    S.write_json_arrays(p("chunk_text").where("page_start < 25"), f"{f}/a")
    S.write_json_arrays(p("content").where("page_start >= 25"), f"{f}/b")
    return S.read_chunks(spark, f"{f}/a").unionByName(S.read_chunks(spark, f"{f}/b"))


@query("SELECT 'p' || p_partkey AS id, p_name AS name, p_type AS type, p_size::INTEGER AS page FROM part")
def graph_from_json(spark, d) -> DataFrame:
    """S5, the sibling dialect: nodes of a graph file with properties and a single page"""
    f = _folder(spark)
    p = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_type").alias("type"), F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("page")).alias("properties"))
    S.write_json_arrays(p, f, wrap="nodes")
    return S.read_graph_nodes(spark, f)


@query("SELECT event_id, 'purchase' AS event, user_id::VARCHAR AS value FROM events WHERE event_type = 'purchase'")
def log_events(spark, d) -> DataFrame:
    """S9"""
    f = _folder(spark)
    table(spark, d, "events").select(F.format_string("%s user=%s id=%s", "event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string"))).write.text(f)
    log = S.read_log(spark, f, {"purchase": r"^purchase user=(\d+)"})
    return log.select(F.regexp_extract("line", r"id=(\d+)", 1).cast("long").alias("event_id"), "event", "value")


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_sink(spark, d) -> DataFrame:
    """S10, written and read again"""
    f = _folder(spark)
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    S.write_json(c, f)
    return spark.read.schema(c.schema).json(f)


@query("SELECT conv_id, turn, role, replace(replace(text, chr(13), ''), '\\', '/') AS text FROM conversations")
def csv_sink(spark, d) -> DataFrame:
    """S11, written and read again (multi-line, quoted)"""
    f = _folder(spark)
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.replace(F.replace("text", F.lit("\r"), F.lit("")), F.lit("\\"), F.lit("/")).alias("text"))
    S.write_csv(c, f)
    return spark.read.schema(c.schema).option("header", True).option("multiLine", True).option("escape", '"').csv(f)


@query("SELECT round(avg(value), 6) AS value, round(avg(user_id), 6) AS user_id FROM events")
def csv_means(spark, d) -> DataFrame:
    """S15"""
    f = _folder(spark)
    S.write_csv(table(spark, d, "events").select("event_id", "user_id", "value"), f)
    return S.column_means(spark.read.option("header", True).csv(f), ["value", "user_id"])


@query("SELECT vec_id, label FROM embeddings WHERE vec_id BETWEEN 100 AND 300")
def vector_store(spark, d) -> DataFrame:
    """Vectors written by id and a range of ids read back"""
    f = _folder(spark)
    S.write_vectors(table(spark, d, "embeddings"), f, 8)
    return S.read_vectors(spark, f, 100, 300).select("vec_id", "label")


@query("SELECT 's' || s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN 'new ' || s_name ELSE s_name END AS name FROM supplier UNION ALL SELECT 'x' || s_suppkey, s_name FROM supplier WHERE s_acctbal < 0")
def node_upsert(spark, d) -> DataFrame:
    """Stored nodes, replaced by id or added"""
    s = table(spark, d, "supplier")
    old = s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"))
    less = s.where("s_acctbal < 0")
    new = less.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("new "), "s_name").alias("name")).unionByName(less.select(F.concat(F.lit("x"), "s_suppkey").alias("id"), F.col("s_name").alias("name")))
    return S.upsert(old, new, ["id"])
