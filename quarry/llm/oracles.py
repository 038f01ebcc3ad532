"""DuckDB SQL for the rows of the queries that SQL can express on whole tables."""

from __future__ import annotations

from quarry.llm.mixing import op4_sql
from quarry.llm.portable import hash31_sql
from quarry.llm.sharding import BUCKET_ROWS, MOST_BUCKETS, SHARDS
from quarry.llm.urls import LOWER, RULES, SECOND_LEVEL, UPPER
from quarry.llm.vectors import THRESHOLD


def op3_sql() -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, row_number() OVER () AS rid, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.rid AS a, b.rid AS b FROM ok a JOIN ok b ON a.rid <> b.rid AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= {THRESHOLD}),
r AS (SELECT rid AS id, rid AS x FROM v UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.x),
c AS (SELECT r.id, min(v.vec_id) AS component_id FROM r JOIN v ON v.rid = r.x GROUP BY r.id),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.id = v.rid LEFT JOIN n ON n.a = v.rid"""


def op5_sql() -> str:
    return r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT rid, doc_id, t.i, array_to_string(ws[t.i:t.i + 12], ' ') AS k FROM w, unnest(range(1, len(ws) - 11)) AS t(i)),
m AS (SELECT k, min(doc_id) AS d FROM g GROUP BY k),
h AS (SELECT rid, i FROM g JOIN m USING (k) WHERE m.d < g.doc_id),
c AS (SELECT DISTINCT rid, i + j AS p FROM h, range(13) AS t(j)),
x AS (SELECT w.rid, u.p, u.word FROM w, unnest(ws) WITH ORDINALITY AS u(word, p)),
s AS (SELECT x.rid, string_agg(word, ' ' ORDER BY x.p) AS kept, count(*) AS n FROM x ANTI JOIN c ON c.rid = x.rid AND c.p = x.p GROUP BY x.rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (rid)"""


def crc32_sql(text: str) -> str:
    """The CRC-32 of a text's bytes, by the usual table of 256 remainders."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    digits = "'0123456789ABCDEF'"
    byte = f"(strpos({digits}, x[1]) - 1) * 16 + strpos({digits}, x[2]) - 1"
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ({byte})::BIGINT)"
    return f"xor(list_reduce({data}, lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1]::BIGINT), 4294967295::BIGINT), 4294967295::BIGINT)"


def op6_sql() -> str:
    buckets = f"least({MOST_BUCKETS}, greatest(1, (count(*) OVER () + {SHARDS * BUCKET_ROWS} - 1) // {SHARDS * BUCKET_ROWS}))"
    key = "((coalesce(doc_id, 0)::HUGEINT % 18446744073709551616) + 18446744073709551616) % 18446744073709551616"
    return f"""
WITH RECURSIVE d AS (SELECT *, row_number() OVER () AS rid, {hash31_sql("doc_id", 5)} % {buckets} AS bucket FROM documents),
j(rid, k, b, j) AS (
  SELECT rid, ({key} * 2862933555777941757 + 1) % 18446744073709551616, 0::BIGINT, 0::BIGINT FROM (SELECT rid, doc_id FROM d)
  UNION ALL
  SELECT rid, (k * 2862933555777941757 + 1) % 18446744073709551616, j2, j2 FROM (SELECT rid, k, floor((b + 1) * (2147483648.0::DOUBLE / ((k // 8589934592) + 1)::DOUBLE))::BIGINT AS j2 FROM j) WHERE j2 <= {SHARDS}),
s AS (SELECT rid, max(CASE WHEN b < {SHARDS} THEN b END)::INTEGER AS shard, max(b)::INTEGER AS grown_shard FROM j GROUP BY rid)
SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, {crc32_sql("coalesce(text, '')")}, octet_length(encode(coalesce(text, '')))) - 1 AS slot, grown_shard
FROM d JOIN s USING (rid)"""


def op8_sql(least: float = 0.5, z: float = 1.645) -> str:
    rules = sorted(RULES, key=lambda r: -len(r.text))
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r.text}'" for f, r in zip(fits, rules)) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fits, rules)) + " END"
    second = ", ".join(f"'{s}'" for s in SECOND_LEVEL)

    def level(name: str, table: str) -> str:
        return f"""
{name}0 AS (SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(y)::DOUBLE AS y, sum(n::DOUBLE * n) AS nn, sum(y::DOUBLE * y / n) AS yy FROM {table} WHERE n > 0),
{name}1 AS (SELECT *, (y + 0.5) / (n + 1.0) AS share, yy - y * y / n AS spread, n - nn / n - (k - 1) AS room FROM {name}0),
{name} AS (SELECT coalesce(share, 0.5) AS share, CASE WHEN k = 0 THEN 2.0 ELSE 1 / least(0.99, greatest(1e-4, CASE WHEN room > 0 THEN (spread / (share * (1 - share)) - (k - 1)) / room ELSE 0 END)) - 1 END AS k FROM {name}1)"""

    return rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
l AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS y FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(y), 0)::BIGINT AS y, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS parts FROM p LEFT JOIN l USING (page_id) GROUP BY host),
h1 AS (SELECT *, len(parts) > 1 AND length(parts[-1]) = 2 AND parts[-2] IN ({second}) AS two FROM h0),
hosts AS (SELECT host, n, y, array_to_string(parts[CASE WHEN two THEN -3 ELSE -2 END:], '.') AS domain, array_to_string(parts[CASE WHEN two THEN -2 ELSE -1 END:], '.') AS suffix FROM h1),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(y) AS y FROM hosts GROUP BY ALL), suffixes AS (SELECT suffix, sum(n) AS n, sum(y) AS y FROM domains GROUP BY ALL),{level("cs", "suffixes")},{level("cd", "domains")},{level("ch", "hosts")},
ms AS (SELECT suffix, (cs.share * cs.k + y) / (cs.k + n) AS m FROM suffixes, cs), md AS (SELECT d.suffix, d.domain, (ms.m * cd.k + y) / (cd.k + n) AS m FROM domains d JOIN ms USING (suffix), cd),
mh AS (SELECT h.host, (md.m * ch.k + y) / (ch.k + n) AS m, n + ch.k + 1 AS s FROM hosts h JOIN md USING (suffix, domain), ch)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN m + {z} * sqrt(m * (1 - m) / s) < {least} THEN 'block' ELSE 'allow' END) AS verdict FROM p JOIN mh USING (host)"""


ORACLE_SQL = {
    "op3_embedding_near_dedup": op3_sql(),
    "op4_mixing": op4_sql(),
    "op5_substring_dedup": op5_sql(),
    "op6_sharding": op6_sql(),
    "op8_url_filters": op8_sql(),
}
