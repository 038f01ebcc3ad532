"""Operator 8, URL filters by empirical-Bayes host reputation.

Explicit rules come first. Every other url gets its host's reputation: the share of labelled pages
that are good, shrunk by beta-binomial priors from the host to its registered domain, from that to the
suffix and from that to all pages. Each level's concentration is estimated from the data by moments
over all its groups. A host is blocked if the upper posterior bound of its share lies below `least`,
so hosts with no or few labels are let through by what is known of those above them.

A page's labelled outcome is the row of `labels` with its id: good means quality 1 and not toxic.

Defined cases: a null url or one without :// has an empty host and path and meets the empty host's
reputation; labels that repeat count as often as they come, null labels don't count; without any
label every host is let through; a very long url without a host is one url of the empty host; rows that repeat get the same verdict; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level labels under which names are registered in country domains.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


#: The rules of the query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    get = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(get(1), UPPER, LOWER), get(2)


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix; a port or user is not part of either."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    last = F.substring_index(bare, ".", -1)
    two = F.substring_index(bare, ".", -2)
    second = F.when(F.char_length(last) == 2, F.substring_index(two, ".", 1).isin(*SECOND_LEVEL)).otherwise(False) & (two != last)
    return F.when(second, F.substring_index(bare, ".", -3)).otherwise(two), F.when(second, two).otherwise(last)


def concentration(groups: DataFrame) -> tuple[float, float]:
    """(share, a + b) of the beta prior of groups (y of n good): moments of the overdispersion."""
    n, y = F.col("n").cast("double"), F.col("y").cast("double")
    r = groups.where("n > 0").agg(F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(y).alias("y"), F.sum(n * n).alias("nn"), F.sum(y * y / n).alias("yy")).first()
    if not r["k"]:
        return 0.5, 2.0
    share = (r["y"] + 0.5) / (r["n"] + 1.0)
    spread = r["yy"] - r["y"] ** 2 / r["n"]  # sum of n * (y / n - mean)^2
    room = r["n"] - r["nn"] / r["n"] - (r["k"] - 1)
    phi = (spread / (share * (1 - share)) - (r["k"] - 1)) / room if room > 0 else 0.0
    phi = min(0.99, max(1e-4, phi))
    return share, 1 / phi - 1


def reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host with mean and bound_sd of its posterior, for all hosts of pages (page_id, host)."""
    good = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)
    seen = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("page_id"), good.alias("good"))
    seen = seen.groupBy("page_id").agg(F.count("*").alias("n"), F.sum("good").alias("y"))
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = pages.join(seen, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("y"))
    hosts = cut(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "y"))  # read by every level above
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    share, ks = concentration(suffixes)
    kd, kh = concentration(domains)[1], concentration(hosts)[1]
    mean = lambda m, k: (m * F.lit(k) + F.col("y")) / (F.lit(k) + F.col("n"))
    s = suffixes.select("suffix", mean(F.lit(share), ks).alias("ms"))
    d = domains.join(s, "suffix").select("suffix", "domain", mean(F.col("ms"), kd).alias("md"))
    h = hosts.join(d, ["suffix", "domain"])
    m = mean(F.col("md"), kh)
    return h.select("host", m.alias("mean"), F.sqrt(m * (1 - m) / (F.col("n") + F.lit(kh) + 1)).alias("sd"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, *, least: float = 0.5, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    rep = reputation(p.select("page_id", "host"), labels)
    bad = F.col("mean") + F.lit(z) * F.col("sd") < F.lit(least)
    rule, verdict = F, F
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, verdict = rule.when(fits, r.text), verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    rule = rule.otherwise(none) if rule is not F else none
    other = F.when(bad, "block").otherwise("allow")
    verdict = verdict.otherwise(other) if verdict is not F else other
    return p.join(rep, "host").select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def op8_url_filters(spark, sf_dir: str) -> DataFrame:
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    return judge(pages.select("page_id", "url"), labels.select("doc_id", "quality", "toxic"))
