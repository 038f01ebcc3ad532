"""Text expressions: cleaning, normal forms, tokens, noise (inventory P1, P2, P4-P11, P15-P21).

Every function takes and returns a Column. `\\w` and `\\s` are spelled out where the engine's ASCII
classes would differ from Unicode ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic characters and what replaces them.
ONE_TO_ONE = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", " ": " ", "−": "-", "×": "x", "•": "•"}
TO_MANY = {"—": " - ", "…": "..."}
DELETED = "​‌‍﻿­"
BULLETS = "•●◦▪▸►‣⁃"
BLANKS = r"[\t\r\f\x0B \x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

# Names that are noise, matched at their start.
NOISE_PATTERNS = (
    r"^\+?\d[\d\s\-()]{6,}$",
    r"^[\w.\-]+@[\w.\-]+\.\w+$",
    r"^https?://",
    r"^www\.",
    r"^[A-F0-9\-]{24,}$",
    r"^[A-Z]{2}\d{2}[A-Z0-9]{10,}$",
)

# Entity types and relations written in other ways.
ENTITY_TYPES = {
    "Country": "Location", "City": "Location", "State": "Location", "Province": "Location", "Region": "Location", "Continent": "Location", "Address": "Location",
    "Company": "Organization", "Institution": "Organization", "Agency": "Organization",
    "Software": "Product",
    "Guide": "Document", "Specification": "Document", "Manual": "Document", "Report": "Document",
    "Workflow": "Process", "Procedure": "Process", "Algorithm": "Process",
    "Framework": "Technology", "Library": "Technology", "Platform": "Technology", "Tool": "Technology", "API": "Technology",
    "Interface": "System", "Module": "System", "Component": "System",
    "Scheme": "Standard", "Norm": "Standard", "Guideline": "Standard",
    "Code": "Identifier", "CodeValue": "Code",
}
RELATIONS = {
    "CREATE": "CREATED", "DEVELOPS": "DEVELOPED_BY", "PUBLISHED": "PUBLISHES", "ISSUED": "ISSUED_BY", "ADOPTED": "USES", "MIGRATES_TO": "USES",
    "IMPLEMENTED": "IMPLEMENTS", "BELONGS": "BELONGS_TO", "PARTOF": "PART_OF", "ESTABLISHED": "CREATED", "ESTABLISHES": "CREATED",
    "PERMITS": "SUPPORTS", "ALLOWS": "ENABLES", "CONNECTED_TO": "RELATED_TO", "LINKS_TO": "REFERENCES",
}


def _strings(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def normalize_unicode(c: Column | str) -> Column:
    """Typographic characters to plain ones, in one translate and two replaces."""
    out = F.translate(_strings(c), "".join(ONE_TO_ONE) + DELETED, "".join(ONE_TO_ONE.values()))
    for old, new in TO_MANY.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def clean_text(c: Column | str) -> Column:
    """Controls, decorative lines, blanks, page numbers, bullets, blank lines, line ends, in this order."""
    t = normalize_unicode(c)
    t = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]", "")
    t = F.regexp_replace(t, r"(?md)^[═━─\-_=~*]{3,}\s*$", "")
    t = F.regexp_replace(t, BLANKS, " ")
    t = F.regexp_replace(t, r"(?md)^\s*\d{1,3}\s*$", "")
    t = F.regexp_replace(t, rf"(?md)^\s*[{BULLETS}]\s*", "• ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.array_join(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), "\n")
    return F.btrim(t, F.lit(" \n"))


def clean_text_sql(c: str) -> str:
    """clean_text as DuckDB SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    t = f"translate(coalesce({c}, ''), {q(''.join(ONE_TO_ONE) + DELETED)}, {q(''.join(ONE_TO_ONE.values()))})"
    for old, new in TO_MANY.items():
        t = f"replace({t}, {q(old)}, {q(new)})"
    for p, r in (
        (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]", ""),
        (r"(?m)^[═━─\-_=~*]{3,}\s*$", ""),
        (BLANKS, " "),
        (r"(?m)^\s*\d{1,3}\s*$", ""),
        (rf"(?m)^\s*[{BULLETS}]\s*", "• "),
        (r"\n{3,}", "\n\n"),
    ):
        t = f"regexp_replace({t}, {q(p)}, {q(r)}, 'g')"
    t = f"array_to_string(list_transform(string_split({t}, chr(10)), lambda x: trim(x, ' ')), chr(10))"
    return f"trim({t}, ' ' || chr(10))"


def normalize_answer(c: Column | str) -> Column:
    """Lower, marks to spaces (letters, digits and _ of any script stay), spaces folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_strings(c)), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def norm(c: Column | str) -> Column:
    """P5: lower, runs of anything but a-z0-9 to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(_strings(c)), "[^a-z0-9]+", " "))


def alnum(c: Column | str) -> Column:
    """Lower, a-z0-9 only."""
    return F.regexp_replace(F.lower(_strings(c)), "[^a-z0-9]", "")


def slug(c: Column | str) -> Column:
    """Lower, trimmed, word characters, spaces and hyphens only, runs of the latter to one hyphen."""
    kept = F.regexp_replace(F.trim(F.lower(_strings(c))), r"[^\p{L}\p{N}_\s-]", "")
    return F.regexp_replace(kept, r"[\s_-]+", "-")


def tokens(c: Column | str, least: int = 1) -> Column:
    """Words of norm() of at least `least` characters, in order, with repeats."""
    return F.filter(F.split(norm(c), " "), lambda t: F.char_length(t) >= least)


def answer_tokens(c: Column | str) -> Column:
    """Words of normalize_answer(), in order, with repeats."""
    return F.filter(F.split(normalize_answer(c), " "), lambda t: t != "")


def is_noise(c: Column) -> Column:
    """No name, one character, or a phone number, address, link, hash or account number."""
    name = F.trim(_strings(c))
    hit = F.char_length(name) < 2
    for p in NOISE_PATTERNS:
        hit = hit | name.rlike(p)
    return hit


def is_rejected(c: Column) -> Column:
    """Noise, or a link or an address."""
    return is_noise(c) | c.startswith("http") | c.startswith("www.") | c.contains("@")


def _mapped(c: Column, pairs: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(x) for p in pairs.items() for x in p))
    return F.coalesce(F.try_element_at(table, c), c)


def entity_type(c: Column) -> Column:
    """P10: canonical entity type, one hop; a missing type is a Concept."""
    return _mapped(F.coalesce(c, F.lit("Concept")), ENTITY_TYPES)


def relation(c: Column, vocabulary: tuple[str, ...] = ()) -> Column:
    """Canonical relation, one hop; outside the vocabulary upper case with _ for spaces."""
    m = _mapped(c, RELATIONS)
    shaped = F.replace(F.upper(m), F.lit(" "), F.lit("_"))
    return F.when(m.isin(*vocabulary), m).otherwise(shaped) if vocabulary else shaped


def graph_label(c: Column) -> Column:
    """A relation as an edge type: spaces, hyphens and dots to _, upper case."""
    return F.upper(F.translate(c, " -.", "___"))


def ints(c: Column) -> Column:
    """The integers among an array's values."""
    return F.filter(F.transform(c, lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def first_page(c: Column, low: int = 2, high: int = 61) -> Column:
    """The first valid page of an array with bad values."""
    return F.try_element_at(F.filter(ints(c), lambda p: p.between(low, high)), F.lit(1))


def preview(c: Column, n: int = 200, more: str = "...") -> Column:
    """The first n characters, marked if there are more."""
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit(more))).otherwise(c)


def entity_line(page: Column, name: Column, kind: Column, text: Column) -> Column:
    """P20: [Entity | page P] NAME (TYPE): TEXT"""
    return F.format_string("[Entity | page %s] %s (%s): %s", page.cast("string"), name, kind, text)


def chunk_line(page: Column, text: Column) -> Column:
    """P20: [Source chunk | page P] TEXT"""
    return F.format_string("[Source chunk | page %s] %s", page.cast("string"), text)


def triple_line(src: Column, rel: Column, dst: Column) -> Column:
    """P20: SRC -[REL]-> DST"""
    return F.format_string("%s -[%s]-> %s", src, rel, dst)


def source_line(chunk: Column, first: Column, last: Column, text: Column) -> Column:
    """P20: [Source (chunk N, pages X-Y)] TEXT"""
    return F.format_string("[Source (chunk %s, pages %s-%s)] %s", chunk.cast("string"), first.cast("string"), last.cast("string"), text)


def parse_source_line(c: Column) -> Column:
    """P20 inverse: struct (chunk_id, page_start, page_end, text); null fields where it is no such line."""
    p = r"(?s)^\[Source \(chunk (\d+), pages (\d+)-(\d+)\)\] (.*)$"
    get = lambda k: F.nullif(F.regexp_extract(c, p, k), F.lit(""))
    return F.struct(*(get(k).try_cast("int").alias(n) for k, n in ((1, "chunk_id"), (2, "page_start"), (3, "page_end"))), get(4).alias("text"))


def repair_json(c: Column) -> Column:
    """The JSON object in a model's answer: the text itself, a fenced block, the widest {...}; else empty lists."""
    t = F.trim(_strings(c))
    fenced = F.trim(F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)\s*```", 1))
    braced = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    valid = lambda x: F.when((x != "") & F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(valid(t), valid(fenced), valid(braced), F.lit('{"entities": [], "relationships": []}'))


def context_kind(c: Column) -> Column:
    """A context line is a relationship if it has an arrow, a double hyphen, RELATED or CONTAINS."""
    return F.when(F.upper(c).rlike("->|--|RELATED|CONTAINS"), "relationship").otherwise("entity")
