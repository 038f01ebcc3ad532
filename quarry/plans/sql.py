"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations


def norm(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"


def alnum(c: str) -> str:
    return f"regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]', '', 'g')"


def tokens(c: str, least: int = 1) -> str:
    return f"list_filter(string_split({norm(c)}, ' '), lambda t: length(t) >= {least})"


def normalize_answer(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def answer_tokens(c: str) -> str:
    return f"list_filter(string_split({normalize_answer(c)}, ' '), lambda t: t <> '')"


def slug(c: str) -> str:
    return rf"regexp_replace(regexp_replace(trim(lower(coalesce({c}, ''))), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '[\s_-]+', '-', 'g')"


def noise(c: str, patterns: tuple[str, ...]) -> str:
    hits = " OR ".join(f"regexp_matches(trim(coalesce({c}, '')), '{p}')" for p in patterns)
    return f"(length(trim(coalesce({c}, ''))) < 2 OR {hits})"


def mapped(c: str, pairs: dict[str, str]) -> str:
    return f"(CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items()) + f" ELSE {c} END)"


#: One assistant turn and the user turn before it; its context is what the conversation said before it.
TURNS = """
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations),
u AS (SELECT conv_id, n, turn, role, text, max(CASE WHEN role = 'user' THEN n END) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS un,
  list(text) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS contexts FROM t),
pairs AS (SELECT u.conv_id, u.turn, u.n, u.text AS answer, v.text AS truth, list_filter(u.contexts, lambda c: c IS NOT NULL) AS contexts FROM u JOIN t v ON v.conv_id = u.conv_id AND v.n = u.un WHERE u.role = 'assistant')"""
