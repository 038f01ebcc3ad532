"""Keywords of questions (inventory R1-R4, A26): questions are a table (qid, question)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.contains import contains_pairs

# Words that are no keywords.
FALLBACK_STOP_WORDS = tuple(
    """what who how when where which why is are was were does do did the a an of for in on at by to with and or from it its this that
    have has had be been can could would should please provide many much pages page version year number""".split()
)
STOP_WORDS = FALLBACK_STOP_WORDS + tuple(
    """between difference using used use via within during before after upon under over into onto than then these those their there they
    them such each both other most more some any all one two three four five six seven eight nine ten first second third etc""".split()
)
GRAPH_STOP_WORDS = STOP_WORDS + tuple("said according guide accordingly if pay own may".split())

# The four kinds of candidates.
QUOTED = r"""\"([^\"]+)\"|'([^']+)'"""
RUN = r"\b(?:[A-Z][A-Za-z0-9.\-]*|\d+)(?:\s+(?:[A-Z][A-Za-z0-9.\-]*|\d+))+\b"
RUN_PLAIN = r"\b(?:[A-Z][A-Za-z0-9\-]*[A-Za-z0-9]|\d+)(?:\s+(?:[A-Z][A-Za-z0-9\-]*[A-Za-z0-9]|\d+))+\b"
CAPITAL = r"\b[A-Z][A-Za-z0-9.\-]{2,}\b"
CAPITAL_OR_DIGIT = r"\b[A-Z0-9][A-Za-z0-9.\-]{2,}\b"
LOWER = r"\b[a-z][a-z0-9.\-]{2,}\b"
EDGE = "?. ,;:!"
PARTICLE = r"(?i)^(the|a|an|in|on|at|by|for|of|to|with|from|as|if)\s+"


def _all(q: Column, pattern: str) -> Column:
    """All matches; letters and digits beyond ASCII become _, so that \\b sees word characters in them on any JVM."""
    return F.regexp_extract_all(F.regexp_replace(q, r"[\p{L}\p{N}&&[^\x00-\x7F]]", "_"), F.lit(pattern), F.lit(0))


def _quoted(q: Column) -> Column:
    return F.transform(F.regexp_extract_all(q, F.lit(QUOTED), F.lit(0)), lambda x: F.trim(F.substring(x, 2, 1 << 20).substr(F.lit(1), F.char_length(x) - 2)))


def _clean(c: Column) -> Column:
    return F.trim(F.btrim(F.trim(c), F.lit(EDGE)))


def first_keywords(questions: DataFrame, cap: int = 3) -> DataFrame:
    """(qid, keyword, rank): quoted and runs; only without any, single capitals; only without any, lower-case words."""
    q = F.col("question")
    stop = F.array(*map(F.lit, FALLBACK_STOP_WORDS))
    content = lambda a: F.filter(a, lambda w: ~F.array_contains(stop, F.lower(w)))
    strong = F.filter(F.concat(_quoted(q), _all(q, RUN)), lambda x: x != "")
    single, low = content(_all(q, CAPITAL)), content(_all(q, LOWER))
    d = questions.select("qid", strong.alias("s"), single.alias("c"), low.alias("l"))
    got = F.when(F.size("s") > 0, F.col("s")).when(F.size("c") > 0, F.col("c")).otherwise(F.col("l"))
    k = d.select("qid", F.posexplode(F.transform(got, _clean)).alias("pos", "keyword")).where((F.col("keyword") != "") & ~F.lower("keyword").isin(*FALLBACK_STOP_WORDS))
    once = k.groupBy("qid", F.lower("keyword").alias("low")).agg(F.min("pos").alias("pos"), F.min_by("keyword", "pos").alias("keyword"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("pos"))).where(F.col("rank") <= cap).select("qid", "keyword", "rank")


def candidates(questions: DataFrame, *, run: str = RUN, capital: str = CAPITAL, stop: tuple[str, ...] = STOP_WORDS, particles: bool = False) -> DataFrame:
    """(qid, keyword, low, prio) of all kinds, once for each lower-case form, in its most specific spelling (the first such)."""
    q = F.col("question")
    kinds = ((_quoted(q), 4), (_all(q, run), 3), (_all(q, capital), 2), (_all(q, LOWER), 1))
    tagged = lambda a, p: F.transform(a, lambda w: F.struct(w.alias("w"), F.lit(p).alias("prio")))
    every = F.concat(*(tagged(a, p) for a, p in kinds))
    d = questions.select("qid", F.posexplode(every).alias("pos", "c"))
    word = _clean(F.col("c.w"))
    if particles:
        word = F.trim(F.regexp_replace(word, PARTICLE, ""))
    d = d.select("qid", "pos", F.col("c.prio").alias("prio"), word.alias("keyword")).withColumn("low", F.lower("keyword"))
    d = d.where((F.col("keyword") != "") & ~F.col("low").isin(*stop))
    return d.groupBy("qid", "low").agg(F.max_by("keyword", F.struct("prio", -F.col("pos"))).alias("keyword"), F.max("prio").alias("prio"))


def document_frequency(keywords: DataFrame, texts: DataFrame) -> DataFrame:
    """(term, df): in how many texts (id, text) each lower-case keyword (low) occurs."""
    found = contains_pairs(texts.select("id", F.lower("text").alias("text")), keywords.select(F.col("low").alias("term")))
    return found.groupBy("term").agg(F.count("*").alias("df"))


def _scored(c: DataFrame, texts: DataFrame, rarity: float, longest: int) -> DataFrame:
    n = max(1, texts.count())
    d = c.join(document_frequency(c, texts).withColumnRenamed("term", "low"), "low", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    share = (F.lit(n) - F.col("df")) / F.lit(float(n))
    return d.withColumn("score", F.col("prio") * 100 + F.least(F.char_length("keyword"), F.lit(longest)) + share * rarity)


def ranked_keywords(questions: DataFrame, texts: DataFrame, cap: int = 2) -> DataFrame:
    """R2: (qid, keyword, low, df, score, rank): specificity, length up to 12, rarity among texts; the best `cap`."""
    d = _scored(candidates(questions), texts, 10.0, 12)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "low")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).select("qid", "keyword", "low", "df", "score", "rank")


def graph_candidates(questions: DataFrame) -> DataFrame:
    """(qid, keyword, low, prio) without those whose words stand in a row inside a better kept one; codes stay."""
    c = candidates(questions, run=RUN_PLAIN, capital=CAPITAL_OR_DIGIT, stop=GRAPH_STOP_WORDS, particles=True)
    words = F.filter(F.split("low", "[^a-z0-9]+"), lambda w: w != "")
    code = F.col("keyword").rlike(r"^[A-Z0-9][A-Z0-9.\-]{2,}$")
    item = F.struct(-F.col("prio"), -F.char_length("keyword"), "low", "keyword", words.alias("words"), code.alias("code"), "prio")
    rows = c.select("qid", item.alias("i")).groupBy("qid").agg(F.array_sort(F.collect_list("i")).alias("items"))

    def inside(small: Column, big: Column) -> Column:
        n = F.size(small)
        return (F.size(big) >= n) & F.exists(F.sequence(F.lit(1), F.greatest(F.size(big) - n + 1, F.lit(1))), lambda i: F.slice(big, i, n) == small)

    keep = lambda s, x: F.when((F.size(x["words"]) > 0) & (x["code"] | ~F.exists(s, lambda k: inside(x["words"], k["words"]))), F.concat(s, F.array(x))).otherwise(s)
    kept = F.aggregate("items", F.slice("items", 1, 0), keep)
    return rows.select("qid", F.explode(kept).alias("k")).select("qid", "k.keyword", "k.low", "k.prio")


def selected_keywords(questions: DataFrame, texts: DataFrame, cap: int = 6) -> DataFrame:
    """(qid, keyword, low, score, rank): specificity, length up to 15, rarity; the best `cap`."""
    d = _scored(graph_candidates(questions), texts, 30.0, 15)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "low")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).select("qid", "keyword", "low", "score", "rank")
