"""Queries over texts and answers, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions.metrics import with_metrics
from quarry.operators import evaluation, keywords, retrieval
from quarry.plans import sql as Q
from quarry.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


@query(f"SELECT doc_id, {X.clean_text_sql('text')} AS cleaned FROM documents")
def clean_text(spark, d) -> DataFrame:
    """P1, P2"""
    return table(spark, d, "documents").select("doc_id", X.clean_text("text").alias("cleaned"))


def _edge_lines(docs: DataFrame) -> DataFrame:
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.lower(x))), lambda x: x != "")
    return docs.select("source", lines.alias("l"))


def header_footer_patterns(docs: DataFrame, threshold: int = 3) -> DataFrame:
    """(source, line, heads, feet): lines of over five characters among the first or last two of at least
    `threshold` pages of a document; docs are its pages, `source` names it."""
    d = _edge_lines(docs).where(F.size("l") > 0)
    n = F.size("l")
    both = F.concat(
        F.transform(F.slice("l", 1, 2), lambda x: F.struct(x.alias("line"), F.lit(1).alias("h"), F.lit(0).alias("f"))),
        F.transform(F.slice("l", F.greatest(n - 1, F.lit(1)), 2), lambda x: F.struct(x.alias("line"), F.lit(0).alias("h"), F.lit(1).alias("f"))),
    )
    e = d.select("source", F.explode(both).alias("e")).where(F.char_length("e.line") > 5)
    g = e.groupBy("source", F.col("e.line").alias("line")).agg(F.sum("e.h").alias("heads"), F.sum("e.f").alias("feet"))
    big = docs.groupBy("source").agg(F.count("*").alias("pages")).where(F.col("pages") >= threshold)
    return g.where((F.col("heads") >= threshold) | (F.col("feet") >= threshold)).join(big.select("source"), "source", "left_semi")


_HEADS = """
l AS (SELECT source, doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(lower(x))), lambda x: x <> '') AS l FROM documents),
e AS (SELECT source, unnest(list_transform(l[1:2], lambda x: {line: x, h: 1, f: 0}) || list_transform(l[greatest(len(l) - 1, 1):], lambda x: {line: x, h: 0, f: 1})) AS e FROM l),
p AS (SELECT source, e.line AS line, sum(e.h)::BIGINT AS heads, sum(e.f)::BIGINT AS feet FROM e WHERE length(e.line) > 5 GROUP BY ALL),
hf AS (SELECT * FROM p WHERE (heads >= 3 OR feet >= 3) AND source IN (SELECT source FROM documents GROUP BY source HAVING count(*) >= 3))"""


@query(f"WITH {_HEADS} SELECT * FROM hf")
def header_footer_lines(spark, d) -> DataFrame:
    """P3, A26-style counts"""
    return header_footer_patterns(table(spark, d, "documents").select("source", "text"))


def strip_lines(docs: DataFrame, patterns: DataFrame, most: int = 100_000) -> DataFrame:
    """Docs (doc_id, source, text) without the pattern lines, wherever they stand.

    Up to `most` patterns go to the tasks, by source, and texts are filtered where they are; more are joined line by line.
    """
    of = patterns.select("source", "line").distinct()
    if of.count() <= most:
        sets = F.broadcast(of.groupBy(F.col("source").alias("_source")).agg(F.collect_set("line").alias("_lines")))
        d = docs.join(sets, docs["source"] == F.col("_source"), "left")
        kept = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: ~F.coalesce(F.array_contains("_lines", F.trim(F.lower(x))), F.lit(False)))
        return d.select("doc_id", F.array_join(kept, "\n").alias("stripped"))
    lines = docs.select("doc_id", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "raw"))
    kept = lines.withColumn("line", F.trim(F.lower("raw"))).join(of, ["source", "line"], "left_anti")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), "\n")
    return docs.select("doc_id").join(kept.groupBy("doc_id").agg(body.alias("stripped")), "doc_id", "left").select("doc_id", F.coalesce("stripped", F.lit("")).alias("stripped"))


@query(f"""WITH {_HEADS},
r AS (SELECT d.doc_id, d.source, u.pos, u.raw FROM documents d, unnest(string_split(coalesce(text, ''), chr(10))) WITH ORDINALITY AS u(raw, pos)),
k AS (SELECT r.* FROM r ANTI JOIN hf ON r.source = hf.source AND trim(lower(r.raw)) = hf.line)
SELECT d.doc_id, coalesce(s, '') AS stripped FROM documents d LEFT JOIN (SELECT doc_id, string_agg(raw, chr(10) ORDER BY pos) AS s FROM k GROUP BY doc_id) USING (doc_id)""")
def strip_headers(spark, d) -> DataFrame:
    """P3"""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return strip_lines(docs, header_footer_patterns(docs))


@query(f"SELECT doc_id, {Q.normalize_answer('text')} AS normalized, {Q.norm('text')} AS norm_key, md5({Q.alnum('text')}) AS alnum_md5 FROM documents")
def normalize_tokens(spark, d) -> DataFrame:
    """P4, P5, P6"""
    return table(spark, d, "documents").select("doc_id", X.normalize_answer("text").alias("normalized"), X.norm("text").alias("norm_key"), F.md5(X.alnum("text")).alias("alnum_md5"))


@query(f"SELECT p_partkey, {Q.slug('p_name')} AS slug, {Q.norm('p_brand')} AS norm_key, {Q.alnum('p_brand')} AS alnum_key FROM part")
def slug(spark, d) -> DataFrame:
    """P5, P6, P7"""
    return table(spark, d, "part").select("p_partkey", X.slug("p_name").alias("slug"), X.norm("p_brand").alias("norm_key"), X.alnum("p_brand").alias("alnum_key"))


_REJECT = f"({Q.noise('w', X.NOISE_PATTERNS)} OR starts_with(w, 'http') OR starts_with(w, 'www.') OR contains(w, '@'))"


@query(rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \n\t\r]+'), lambda x: x <> '') AS ws FROM documents)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(list_filter(ws, lambda w: {_REJECT}))::BIGINT AS n_noise FROM w""")
def noise_filter(spark, d) -> DataFrame:
    """P8, P9"""
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \n\t\r]+"), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", w.alias("ws")).select("doc_id", F.size("ws").cast("long").alias("n_words"), F.size(F.filter("ws", X.is_rejected)).cast("long").alias("n_noise"))


@query(f"SELECT page_id, {_REJECT.replace('w,', 'url,').replace('(w)', '(url)').replace('coalesce(w', 'coalesce(url')} AS noise FROM pages")
def noise_urls(spark, d) -> DataFrame:
    """P8, P9"""
    return table(spark, d, "pages").select("page_id", X.is_rejected(F.col("url")).alias("noise"))


@query("SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Country' WHEN 'SMALL' THEN 'Tool' WHEN 'LARGE' THEN 'CodeValue' ELSE p_type END AS raw, "
       + Q.mapped("(CASE p_type WHEN 'ECONOMY' THEN 'Country' WHEN 'SMALL' THEN 'Tool' WHEN 'LARGE' THEN 'CodeValue' ELSE p_type END)", X.ENTITY_TYPES) + " AS type FROM part")
def type_mapping(spark, d) -> DataFrame:
    """P10"""
    raw = F.when(F.col("p_type") == "ECONOMY", "Country").when(F.col("p_type") == "SMALL", "Tool").when(F.col("p_type") == "LARGE", "CodeValue").otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", raw.alias("raw"), X.entity_type(raw).alias("type"))


_EVENT = "(CASE event_type WHEN 'click' THEN 'LINKS_TO' WHEN 'view' THEN 'DEVELOPS' WHEN 'purchase' THEN 'ADOPTED' ELSE event_type || ' of' END)"


@query(f"SELECT event_id, replace(upper({Q.mapped(_EVENT, X.RELATIONS)}), ' ', '_') AS relation, upper(translate({_EVENT}, ' -.', '___')) AS label FROM events")
def relation_mapping(spark, d) -> DataFrame:
    """P11, P17"""
    t = F.col("event_type")
    raw = F.when(t == "click", "LINKS_TO").when(t == "view", "DEVELOPS").when(t == "purchase", "ADOPTED").otherwise(F.concat(t, F.lit(" of")))
    return table(spark, d, "events").select("event_id", X.relation(raw).alias("relation"), X.graph_label(raw).alias("label"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k')::BIGINT WHEN event_id % 3 = 1 THEN json_extract_string(props, '$.k')::BIGINT ELSE NULL END AS k FROM events")
def json_repair(spark, d) -> DataFrame:
    """Bare, fenced and broken answers made of props"""
    p = F.col("props")
    answer = F.when(F.col("event_id") % 3 == 0, p).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here it is:\n```json\n"), p, F.lit("\n```"))).otherwise(F.concat(F.lit("{broken "), p, F.lit(" }")))
    return table(spark, d, "events").select("event_id", F.get_json_object(X.repair_json(answer), "$.k").cast("long").alias("k"))


def turns(spark, d) -> DataFrame:
    """(conv_id, turn, n, answer, truth, contexts): each assistant turn, the user turn before it and all that was said."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    t = table(spark, d, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("answer"), F.row_number().over(w).cast("long").alias("n"),
        F.last(F.when(F.col("role") == "user", F.struct("text")), ignorenulls=True).over(before).alias("u"), F.collect_list("text").over(before).alias("contexts"),
    )
    return t.where("role = 'assistant' and u is not null").select("conv_id", "turn", "n", "answer", F.col("u.text").alias("truth"), "contexts")


_METRICS_SQL = f"""
m0 AS (SELECT *, {Q.answer_tokens('answer')} AS a, {Q.answer_tokens('truth')} AS g, lower(array_to_string(list_filter(contexts, lambda c: c <> ''), ' ')) AS ctext,
  list_transform(contexts, lambda c: list_distinct({Q.answer_tokens('c')})) AS cw FROM pairs),
m1 AS (SELECT *, list_distinct(a) AS ad, list_distinct(g) AS gd FROM m0),
m2 AS (SELECT *, list_sum(list_transform(ad, lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(g, lambda y: y = x)))))::DOUBLE AS same,
  CASE WHEN len(gd) > 0 THEN len(list_intersect(gd, ad))::DOUBLE / len(gd) ELSE 0 END AS answer_accuracy,
  CASE WHEN coalesce(answer, '') = '' THEN 1.0 WHEN len(contexts) = 0 OR ctext = '' THEN 0.0 WHEN len(a) = 0 THEN 1.0 ELSE len(list_filter(a, lambda t: contains(ctext, t)))::DOUBLE / len(a) END AS faithfulness FROM m1),
m AS (SELECT conv_id, turn, n,
  CASE WHEN {Q.normalize_answer('answer')} = {Q.normalize_answer('truth')} THEN 1.0 ELSE 0.0 END::DOUBLE AS exact_match,
  CASE WHEN coalesce(same, 0) > 0 THEN 2 * (same / len(a)) * (same / len(g)) / (same / len(a) + same / len(g)) ELSE 0 END AS f1_score,
  answer_accuracy, faithfulness,
  CASE WHEN len(contexts) = 0 THEN 0.0 WHEN len(gd) = 0 THEN 1.0 ELSE list_sum(list_transform(cw, lambda c: CASE WHEN len(c) > 0 THEN len(list_intersect(gd, c))::DOUBLE / len(c) ELSE 0 END)) / len(contexts) END AS context_precision,
  CASE WHEN len(contexts) = 0 THEN 0.0 WHEN len(gd) = 0 THEN 1.0 ELSE len(list_intersect(gd, list_distinct(flatten(cw))))::DOUBLE / len(gd) END AS context_recall,
  CASE WHEN coalesce(answer, '') = '' THEN 0.0 WHEN len(contexts) = 0 THEN 1.0 ELSE 1.0 - faithfulness END AS hallucination_rate,
  CASE WHEN coalesce(answer, '') = '' THEN 0.0 ELSE 0.5 * faithfulness + 0.5 * answer_accuracy END AS citation_correctness,
  answer_accuracy AS multi_hop_success FROM m2)"""
_NAMES = ("exact_match", "f1_score", "answer_accuracy", "faithfulness", "context_precision", "context_recall", "hallucination_rate", "citation_correctness", "multi_hop_success")


def _metrics(spark, d, names) -> DataFrame:
    return with_metrics(turns(spark, d), names).select("conv_id", "turn", "n", *(F.round(n, 6).alias(n) for n in names))


def _metrics_sql(names) -> str:
    return f"WITH {Q.TURNS}, {_METRICS_SQL} SELECT conv_id, turn, n, " + ", ".join(f"round({n}, 6) AS {n}" for n in names) + " FROM m"


@query(_metrics_sql(("exact_match", "f1_score", "answer_accuracy", "multi_hop_success")))
def answer_metrics(spark, d) -> DataFrame:
    """M1, M2, M3, M9"""
    return _metrics(spark, d, ("exact_match", "f1_score", "answer_accuracy", "multi_hop_success"))


@query(_metrics_sql(("faithfulness", "hallucination_rate", "citation_correctness")))
def grounding_metrics(spark, d) -> DataFrame:
    """M4, M7, M8"""
    return _metrics(spark, d, ("faithfulness", "hallucination_rate", "citation_correctness"))


@query(_metrics_sql(("context_precision", "context_recall")))
def context_metrics(spark, d) -> DataFrame:
    """M5, M6"""
    return _metrics(spark, d, ("context_precision", "context_recall"))


@query(f"""WITH {Q.TURNS}, {_METRICS_SQL}, c AS (SELECT m.*, coalesce(d.lang, 'none') AS category FROM m LEFT JOIN documents d ON d.doc_id = m.conv_id)
SELECT category, count(*) AS n, {", ".join(f"round(avg({n}), 6) AS {n}" for n in _NAMES)} FROM c GROUP BY ROLLUP (category)""")
def metrics_by_category(spark, d) -> DataFrame:
    """A18"""
    t = turns(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), "lang"), "conv_id", "left")
    return evaluation.rolled_up(evaluation.scored(t.withColumn("category", F.coalesce("lang", F.lit("none")))))


_LEXICAL = f"""
qt AS (SELECT item_id AS qid, unnest(list_distinct({Q.tokens('text', 3)})) AS t FROM benchmark),
dt AS (SELECT doc_id AS id, unnest(list_distinct({Q.tokens('text', 3)})) AS t FROM documents),
ov AS (SELECT qid, id, count(*) AS overlap FROM qt JOIN dt USING (t) GROUP BY qid, id),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, id) AS rank FROM ov)"""


def questions(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def texts(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query(f"WITH {_LEXICAL} SELECT qid, id, overlap, rank::INTEGER AS rank FROM top WHERE rank <= 3")
def lexical_topk(spark, d) -> DataFrame:
    """R15's overlap term, W2"""
    return retrieval.lexical_top_k(questions(spark, d), texts(spark, d), 3)


@query(f"""WITH {_LEXICAL}, pairs AS (SELECT t.qid, any_value(b.text) AS truth, list(d.text ORDER BY t.rank) AS contexts FROM top t JOIN documents d ON d.doc_id = t.id JOIN benchmark b ON b.item_id = t.qid WHERE t.rank <= 3 GROUP BY t.qid),
m AS (SELECT qid, list_distinct({Q.answer_tokens('truth')}) AS g, list_transform(contexts, lambda c: list_distinct({Q.answer_tokens('c')})) AS cw FROM pairs)
SELECT qid, round(list_sum(list_transform(cw, lambda c: CASE WHEN len(c) > 0 THEN len(list_intersect(g, c))::DOUBLE / len(c) ELSE 0 END)) / len(cw), 6) AS context_precision,
  round(len(list_intersect(g, list_distinct(flatten(cw))))::DOUBLE / len(g), 6) AS context_recall FROM m""")
def retrieval_quality(spark, d) -> DataFrame:
    """M5, M6 of the lexical retriever"""
    top = lexical_topk(spark, d).join(texts(spark, d), "id").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("contexts"))
    names = ("context_precision", "context_recall")
    t = with_metrics(top.join(questions(spark, d), "qid"), names, answer="question", truth="question")
    return t.select("qid", *(F.round(n, 6).alias(n) for n in names))


@query(f"""WITH q AS (SELECT item_id AS qid, unnest(list_distinct({Q.tokens('text')})) AS t FROM benchmark),
d AS (SELECT doc_id AS id, {Q.tokens('text')} AS w FROM documents), s AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avg FROM d),
tf AS (SELECT id, any_value(len(w))::DOUBLE AS l, t, count(*)::DOUBLE AS tf FROM (SELECT id, w, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY id, t),
df AS (SELECT t, count(*)::DOUBLE AS df FROM tf GROUP BY t),
sc AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avg))), 6) AS score FROM tf JOIN df USING (t) JOIN q USING (t), s GROUP BY qid, id)
SELECT qid, id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 10""")
def bm25_topk(spark, d) -> DataFrame:
    """C5"""
    return retrieval.bm25_top_k(questions(spark, d), texts(spark, d), 10)


_STOP = "(" + ", ".join(f"'{w}'" for w in keywords.STOP_WORDS) + ")"


@query(rf"""WITH b AS (SELECT item_id, regexp_replace(text, '[^\x00-\x7F]', '_', 'g') AS text FROM benchmark), c AS (
  SELECT item_id AS qid, 3 AS prio, p.pos, p.w FROM b, unnest(regexp_extract_all(text, '\b(?:[A-Z][A-Za-z0-9.\-]*|\d+)(?:\s+(?:[A-Z][A-Za-z0-9.\-]*|\d+))+\b')) WITH ORDINALITY AS p(w, pos)
  UNION ALL SELECT item_id, 2, p.pos, p.w FROM b, unnest(regexp_extract_all(text, '\b[A-Z][A-Za-z0-9.\-]{{2,}}\b')) WITH ORDINALITY AS p(w, pos)
  UNION ALL SELECT item_id, 1, p.pos, p.w FROM b, unnest(regexp_extract_all(text, '\b[a-z][a-z0-9.\-]{{2,}}\b')) WITH ORDINALITY AS p(w, pos)),
k AS (SELECT qid, prio, pos, trim(trim(trim(w), '?. ,;:!')) AS kw FROM c),
u AS (SELECT qid, lower(kw) AS low, arg_max(kw, prio * 1000000 - pos) AS keyword, max(prio) AS prio FROM k WHERE kw <> '' AND lower(kw) NOT IN {_STOP} GROUP BY ALL),
df AS (SELECT low, (SELECT count(*) FROM documents d WHERE contains(lower(d.text), t.low)) AS df FROM (SELECT DISTINCT low FROM u) t),
s AS (SELECT qid, keyword, low, df, prio * 100 + least(length(keyword), 12) + ((SELECT count(*) FROM documents) - df) / (SELECT count(*) FROM documents)::DOUBLE * 10.0 AS score FROM u JOIN df USING (low))
SELECT qid, keyword, low, df, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, low) AS rank FROM s) WHERE rank <= 2""")
def keyword_rank(spark, d) -> DataFrame:
    """R2, A26 (no benchmark text has quotes)"""
    return keywords.ranked_keywords(questions(spark, d), texts(spark, d)).withColumn("score", F.round("score", 6))


_GRAPH_STOP = "(" + ", ".join(f"'{w}'" for w in keywords.GRAPH_STOP_WORDS) + ")"


@query(rf"""WITH RECURSIVE b AS (SELECT item_id, regexp_replace(text, '[^\x00-\x7F]', '_', 'g') AS text FROM benchmark), c AS (
  SELECT item_id AS qid, 3 AS prio, p.pos, p.w FROM b, unnest(regexp_extract_all(text, '{keywords.RUN_PLAIN}')) WITH ORDINALITY AS p(w, pos)
  UNION ALL SELECT item_id, 2, p.pos, p.w FROM b, unnest(regexp_extract_all(text, '{keywords.CAPITAL_OR_DIGIT}')) WITH ORDINALITY AS p(w, pos)
  UNION ALL SELECT item_id, 1, p.pos, p.w FROM b, unnest(regexp_extract_all(text, '{keywords.LOWER}')) WITH ORDINALITY AS p(w, pos)),
k AS (SELECT qid, prio, pos, trim(regexp_replace(trim(trim(trim(w), '{keywords.EDGE}')), '{keywords.PARTICLE}', '')) AS kw FROM c),
u AS (SELECT qid, lower(kw) AS low, arg_max(kw, prio * 1000000 - pos) AS keyword, max(prio) AS prio FROM k WHERE kw <> '' AND lower(kw) NOT IN {_GRAPH_STOP} GROUP BY ALL),
w AS (SELECT *, ' ' || array_to_string(list_filter(regexp_split_to_array(low, '[^a-z0-9]+'), lambda x: x <> ''), ' ') || ' ' AS words, row_number() OVER (PARTITION BY qid ORDER BY prio DESC, length(keyword) DESC, low) AS i FROM u),
f AS (SELECT DISTINCT qid, 0::BIGINT AS i, []::VARCHAR[] AS kept, false AS ok FROM w UNION ALL SELECT qid, i, CASE WHEN ok THEN list_append(kept, words) ELSE kept END, ok FROM (
  SELECT f.qid, w.i, f.kept, w.words, w.words <> '  ' AND (regexp_matches(w.keyword, '^[A-Z0-9][A-Z0-9.\-]{{2,}}$') OR len(list_filter(f.kept, lambda x: contains(x, w.words))) = 0) AS ok FROM f JOIN w ON w.qid = f.qid AND w.i = f.i + 1)),
g AS (SELECT w.qid, w.keyword, w.low, w.prio FROM w JOIN f ON f.qid = w.qid AND f.i = w.i AND f.ok),
df AS (SELECT low, (SELECT count(*) FROM documents d WHERE contains(lower(d.text), t.low)) AS df FROM (SELECT DISTINCT low FROM g) t),
s AS (SELECT qid, keyword, low, prio * 100 + least(length(keyword), 15) + ((SELECT count(*) FROM documents) - df) / (SELECT count(*) FROM documents)::DOUBLE * 30.0 AS score FROM g JOIN df USING (low))
SELECT qid, keyword, low, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, low) AS rank FROM s) WHERE rank <= 6""")
def keyword_select(spark, d) -> DataFrame:
    """R3, R4"""
    return keywords.selected_keywords(questions(spark, d), texts(spark, d)).withColumn("score", F.round("score", 6))


@query("""WITH p AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS r FROM documents)
SELECT source, doc_id, n_chars, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM p WHERE r <= 2) WHERE rank <= 12""")
def diversity_topk(spark, d) -> DataFrame:
    """At most two documents of a language and then twelve of a source"""
    docs = table(spark, d, "documents").select(F.col("source").alias("qid"), F.col("lang").alias("page"), F.col("doc_id").alias("id"), F.col("n_chars").alias("score"))
    return retrieval.spread(docs).select(F.col("qid").alias("source"), F.col("id").alias("doc_id"), F.col("score").alias("n_chars"), "rank")


@query("""SELECT conv_id, turn, n_chars, running FROM (SELECT conv_id, turn, length(text) AS n_chars, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM conversations) WHERE running <= 15000""")
def budget_prefix(spark, d) -> DataFrame:
    """W4"""
    lines = table(spark, d, "conversations").select(F.col("conv_id").alias("qid"), F.struct("turn", "text").alias("ord"), F.col("text").alias("line"), "turn")
    return retrieval.budget(lines).select(F.col("qid").alias("conv_id"), "turn", F.char_length("line").cast("long").alias("n_chars"), "running")


@query("SELECT d.doc_id FROM documents d ANTI JOIN labels l USING (doc_id)")
def resume_todo(spark, d) -> DataFrame:
    """J19, U4"""
    return evaluation.todo(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


_ERROR = "(CASE WHEN event_type = 'error' THEN (CASE user_id % 4 WHEN 0 THEN 'Quota exhausted: daily cap' WHEN 1 THEN 'Connection reset by peer' WHEN 2 THEN 'no rows' ELSE '' END) ELSE NULL END)"


def _errors(spark, d) -> DataFrame:
    u = F.col("user_id") % 4
    said = F.when(u == 0, "Quota exhausted: daily cap").when(u == 1, "Connection reset by peer").when(u == 2, "no rows").otherwise("")
    return table(spark, d, "events").select("event_id", "event_type", F.col("value").alias("latency"), F.when(F.col("event_type") == "error", said).alias("error"))


@query(f"SELECT event_id, {_ERROR} LIKE 'Quota%' OR {_ERROR} LIKE 'Connection%' AS poisoned FROM events WHERE event_type = 'error'")
def poison_scan(spark, d) -> DataFrame:
    """D5"""
    return _errors(spark, d).where("event_type = 'error'").select("event_id", evaluation.poisoned(F.col("error")).alias("poisoned"))


@query(f"SELECT count(*) AS n, count_if({_ERROR} LIKE 'Quota%' OR {_ERROR} LIKE 'Connection%')::BIGINT AS poisoned, count(*) = (SELECT max(event_id) - min(event_id) + 1 FROM events) AND NOT bool_or(coalesce({_ERROR} LIKE 'Quota%' OR {_ERROR} LIKE 'Connection%', false)) AS complete FROM events")
def phase_complete(spark, d) -> DataFrame:
    """D6"""
    e = _errors(spark, d)
    r = table(spark, d, "events").agg((F.max("event_id") - F.min("event_id") + 1).alias("n")).first()
    return evaluation.phase_complete(e, r["n"])


@query(f"SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_latency, round(avg(CASE WHEN coalesce({_ERROR}, '') <> '' THEN 1.0 ELSE 0.0 END), 6) AS error_rate, round(1 - avg(CASE WHEN coalesce({_ERROR}, '') <> '' THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM events GROUP BY event_type")
def latency_summary(spark, d) -> DataFrame:
    """A19, A20"""
    return evaluation.system_metrics(_errors(spark, d), "event_type")


@query("SELECT user_id, count(*) AS n, round(avg(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.5 ELSE 0.0 END), 6) AS judge_mean FROM events GROUP BY user_id")
def judge_score(spark, d) -> DataFrame:
    """A21"""
    verdict = F.when(F.col("event_type") == "purchase", "correct").when(F.col("event_type") == "signup", "partial").otherwise("wrong")
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg(evaluation.judged(verdict)), 6).alias("judge_mean"))


@query("""SELECT event_id, CASE WHEN upper(l) LIKE '%->%' OR upper(l) LIKE '%--%' OR upper(l) LIKE '%RELATED%' OR upper(l) LIKE '%CONTAINS%' THEN 'relationship' ELSE 'entity' END AS kind
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a -[' || event_type || ']-> b' WHEN 1 THEN event_type || ' is related to x' WHEN 2 THEN event_type ELSE 'It contains ' || event_type END AS l FROM events)""")
def context_triage(spark, d) -> DataFrame:
    """D9, P20"""
    k, t = F.col("event_id") % 4, F.col("event_type")
    line = F.when(k == 0, X.triple_line(F.lit("a"), t, F.lit("b"))).when(k == 1, F.concat(t, F.lit(" is related to x"))).when(k == 2, t).otherwise(F.concat(F.lit("It contains "), t))
    return table(spark, d, "events").select("event_id", X.context_kind(line).alias("kind"))
