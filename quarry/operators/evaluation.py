"""Rollups of metrics, comparison and gates (inventory A18-A24, M10, M11, J17, J20, D1-D6, W7, S11, W10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.metrics import NAMES, with_metrics
from quarry.functions.text import tokens

# What infrastructure failures look like in an error text.
TRANSPORT_HINTS = ("timed out", "timeout", "connection", "getaddrinfo", "urlopen", "winerror", "10054", "11001", "eof", "ssl", "unreachable", "reset", "read operation", "network")


def scored(records: DataFrame) -> DataFrame:
    """records (answer, truth, contexts, ...) with the nine metrics."""
    return with_metrics(records)


def rolled_up(metrics: DataFrame, places: int = 6) -> DataFrame:
    """(category, n, nine means) for each category and, with category null, for all."""
    means = [F.round(F.avg(m), places).alias(m) for m in NAMES]
    return metrics.rollup("category").agg(F.count("*").alias("n"), *means)


def comparison(vector: DataFrame, graph: DataFrame) -> DataFrame:
    """(metric, vector, graph, difference, winner) of two single rows of metrics."""
    long = lambda d, n: d.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in NAMES))).alias("x")).select("x.metric", F.col("x.v").alias(n))
    d = long(vector, "vector").join(long(graph, "graph"), "metric", "full")
    diff = F.round(F.col("graph") - F.col("vector"), 4)
    return d.withColumn("difference", diff).withColumn("winner", F.when(diff > 0, "Graph").when(diff < 0, "Vector").otherwise("Tie"))


def judged(verdict: Column) -> Column:
    """Correct 1, partial 0.5, anything else 0."""
    return F.when(F.lower(verdict) == "correct", 1.0).when(F.lower(verdict) == "partial", 0.5).otherwise(0.0)


def system_metrics(records: DataFrame, by: str) -> DataFrame:
    """(by, n, mean latency, error rate, success rate)."""
    failed = F.coalesce("error", F.lit("")) != ""
    rate = F.round(F.avg(failed.cast("double")), 6)
    return records.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg("latency"), 6).alias("mean_latency"), rate.alias("error_rate"), F.round(1 - F.avg(failed.cast("double")), 6).alias("success_rate"))


def poisoned(error: Column) -> Column:
    """The error is one of quota or transport rather than of the query."""
    e = F.lower(F.coalesce(error, F.lit("")))
    hit = F.contains(e, F.lit("quota exhausted"))
    for h in TRANSPORT_HINTS:
        hit = hit | F.contains(e, F.lit(h))
    return hit


def phase_complete(records: DataFrame, expected: int) -> DataFrame:
    """N, poisoned, complete: exactly the expected number and none poisoned."""
    d = records.agg(F.count("*").alias("n"), F.count_if(poisoned(F.col("error"))).alias("poisoned"))
    return d.withColumn("complete", (F.col("n") == expected) & (F.col("poisoned") == 0))


def todo(all_ids: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return all_ids.join(done.select(key).distinct(), key, "left_anti")


def failure_class(unsupported: Column, attached: Column, n_keywords: Column, n_matched: Column, broad: Column, n_linked: Column, gt_linked: Column, holder_matchable: Column) -> Column:
    """One of nine categories, the first rule that holds."""
    return (
        F.when(unsupported, 8).when(attached, 0).when(n_keywords == 0, 1).when((n_matched == 0) & broad, 2).when(n_matched == 0, 9)
        .when(n_linked == 0, 3).when(gt_linked, 5).when(holder_matchable, 2).otherwise(4)
    )


def outcome_class(outcome: Column, leaked: Column, page_attached: Column, evidence_reachable: Column) -> Column:
    """How a generated query ended."""
    return (
        F.when(outcome == "success", "S_LLM_CYPHER_SUCCEEDED").when(outcome == "error", "E3_CYPHER_SYNTAX_ERROR").when(outcome == "unknown", "UNKNOWN_LOG")
        .when(leaked, "E1_INVENTED_PROPERTY_RECOVERED").when(page_attached & evidence_reachable, "E2_INFERRED_OVERCONSTRAINED_RECOVERED")
        .when(page_attached, "E6_EVIDENCE_TRUNCATED").otherwise("E5_GT_PAGE_OUT_OF_CAPS")
    )


def failure_shares(classes: DataFrame) -> DataFrame:
    """(category, n, share of failures in percent); category 0 is success and has no share."""
    g = classes.groupBy("category").agg(F.count("*").alias("n"))
    # one row for each of at most ten categories
    total = F.sum(F.when(F.col("category") != 0, F.col("n")).otherwise(0)).over(Window.partitionBy(F.lit(0)))
    return g.withColumn("share", F.when((F.col("category") != 0) & (total > 0), F.round(100 * F.col("n") / total, 4)))


def gate(rows: DataFrame, corpus: int) -> DataFrame:
    """Aggregates of old and new retrieval and the verdict.

    rows: page_on, chunk_on, recall, candidates for `new` and `old` each (columns new_page_on, ...).
    PASS needs an improvement, candidates of at most half the corpus on average, and at most two
    questions with over 80 % of it; PROCEED needs more pages and 0.05 more recall.
    """
    n = lambda c: F.sum(F.col(c).cast("int"))
    d = rows.agg(
        n("old_page_on").alias("old_pages"), n("new_page_on").alias("new_pages"), n("old_chunk_on").alias("old_chunks"), n("new_chunk_on").alias("new_chunks"),
        F.round(F.avg("old_recall"), 4).alias("old_recall"), F.round(F.avg("new_recall"), 4).alias("new_recall"),
        F.round(F.avg("new_candidates"), 2).alias("mean_candidates"), F.count_if(F.col("new_candidates") > 0.8 * corpus).alias("broad"),
    )
    better = (F.col("new_pages") > F.col("old_pages")) | (F.col("new_chunks") > F.col("old_chunks")) | (F.col("new_recall") > F.col("old_recall"))
    passed = better & (F.col("mean_candidates") <= 0.5 * corpus) & (F.col("broad") <= 2)
    go = (F.col("new_pages") > F.col("old_pages")) & (F.round(F.col("new_recall") - F.col("old_recall"), 4) >= 0.05)
    return d.withColumn("verdict", F.when(passed, "PASS").otherwise("NOT APPROVED")).withColumn("decision", F.when(go, "PROCEED").otherwise("STOP"))


def evidence(rows: DataFrame) -> DataFrame:
    """Recall and precision of evidence tokens (over two characters) in the attached text, as token sets."""
    e, t = F.array_distinct(tokens("evidence", 3)), F.array_distinct(tokens("attached", 3))
    both = F.size(F.array_intersect(e, t)).cast("double")
    over = lambda n: F.when(n > 0, F.round(both / n, 6)).otherwise(0.0)
    return rows.withColumns({"evidence_recall": over(F.size(e)), "evidence_precision": over(F.size(t))})


def truth_rank(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, rank) of the first candidate (qid, id, rank) that is a truth (qid, id); null if none is."""
    hit = candidates.join(truth, ["qid", "id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("rank"))
    return truth.select("qid").distinct().join(hit, "qid", "left")


def side_by_side(a: DataFrame, b: DataFrame, order: str) -> DataFrame:
    """Two record lists joined by their position in column `order`, the shorter one padded with nulls."""

    def numbered(d: DataFrame, name: str) -> DataFrame:
        return d.select(F.col(order).alias("at"), F.struct(*d.columns).alias(name))

    return numbered(a, "left").join(numbered(b, "right"), "at", "full")


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Answers before and after, by question."""
    return before.select("question_id", F.col("answer").alias("before")).join(after.select("question_id", F.col("answer").alias("after")), "question_id", "left")
