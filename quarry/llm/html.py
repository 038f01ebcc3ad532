"""Operator 1, main text of HTML pages by two-pass block rules.

The page is cut into blocks at block-level tags. What HTML itself names as something else (nav, footer,
aside, menu, dialog, a header outside the article, hidden elements) and containers whose class, id or
role names boilerplate are set aside; a container that holds most of the page's stop words never is by its name,
unless an article or main element lies outside it. All other blocks are classified twice:

1. Length, stop-word density and link density decide the clear ones: long blocks dense in stop words
   and poor in links are good, blocks dense in links and long runs without stop words or sentences bad.
2. Ambiguous blocks, most of them short, inherit the label of the nearest decided neighbours: those of
   the same parent first, then those of the smallest container that holds a decided one (a tie is good;
   a heading asks what follows it first). An article or main element is one feature of this pass: its
   blocks are good where nothing inside it is decided, its long runs without stop words (tables, code)
   are left to their neighbours, and ambiguous blocks outside it aren't taken
   in by what it holds. It never drops a block that the first pass found good.

Stop words are of four languages; on a page with hardly any of them the stop-word tests say nothing.

Defined cases: a null or empty page has empty text; an unclosed tag, quote, comment or raw-text element
(script, style, textarea, title) ends with the page, an unclosed form control with the next block, and
other unclosed elements that are dropped are taken as empty; elements nested deeper than 512 are taken
as siblings; a page of many megabytes is read whole, in time in proportion to it (an attribute value
beyond 65,536 characters ends at the first `>`); pages that repeat give the same text; an empty table
gives none; other columns are not read.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be been but by can could for from had has have he her his
    if in into is it its more no not of on one or other our she so some such than that the their them then
    there these they this to was we were what when which who will with would you
    aber als am an auch auf aus bei bis da das dass dem den der des die durch ein eine einem einen einer
    er es für hat ich ihr im ist mit nach nicht noch nur oder sich sie sind so über um und uns von vor war
    was wenn werden wie wir zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous
    on ou où par pas plus pour qu que qui sa se ses son sont sur un une vous
    al como con cuando del desde donde el ella ellos era esta este fue ha hay las lo los me mi muy más no
    o para pero por porque se sin sobre su sus también tiene todo una uno y ya
    """.split()
)
#: Words in a class, id or role that name what is not the article.
BOILERPLATE = frozenset(
    """
    ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments
    commentlist complementary consent contentinfo cookie cookies copyright disqus footer gdpr login menu
    modal nav navbar navigation newsletter overlay pagination popup promo promoted promotion sidebar sidenav
    signup skip sponsor sponsored subscribe subscription tagcloud toolbar topbar
    """.split()
)
#: Words that name it on a container outside the article only, as articles use them too.
UNCLEAR = frozenset(
    """
    alert alertdialog aside bar byline dialog disclaimer discussion dropdown form header legal message notice
    notices pager privacy rail recommended related replies reply respond search share sharing shortcuts social
    tags toc warning widget
    """.split()
)
#: Parts of a name that say how an element looks or behaves, so that it doesn't name what it is.
STATES = frozenset("has no not with without is closed disabled enabled off on open allowed".split())
BLOCKS = frozenset(
    """
    address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre
    section summary table tbody td tfoot th thead tr ul caption
    """.split()
)
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 dt dd li legend caption figcaption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
DROPPED = frozenset("noscript template svg canvas iframe object math head datalist audio video map".split())
CONTROLS = frozenset("button select".split())
BAD_TAGS = frozenset("nav footer aside menu dialog".split())
WHOLE = frozenset("html body main".split())  # what no class word condemns

LONG, DENSE, SPARSE, MANY_LINKS, SOME_LINKS = 12, 0.12, 0.04, 0.5, 0.33
KNOWN, DEPTH = 0.03, 512
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]{0,65536}+"|'[^']{0,65536}+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'=<>`]++))?""")
_WORD = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[^a-z0-9]+")
_SENTENCE = re.compile(r"[.!?…。！？](?:\s|$)")
_NEXT_LINK = re.compile(r"<a[\s>]", re.I)


@dataclass
class Container:
    tag: str
    parent: int
    aside: bool  # named as something other than the article
    inside: bool  # in an article or main element
    content: bool  # is such an element
    named: bool = False  # a class, id or role names boilerplate
    first: int = 0  # its blocks are first <= i < end
    end: int = 0
    stops: int = 0
    mains: int = 0  # article and main elements in it, itself included


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    at: int  # number of its container
    aside: bool  # its own element is named as something other than the article
    heading: bool
    words: int = 0
    stops: int = 0


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    containers: list[Container] = field(default_factory=list)


def attributes(source: str) -> dict[str, str]:
    """Attributes of a start tag by lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        value = m[2] or ""
        out.setdefault(m[1].lower(), value[1:-1] if value[:1] in ("'", '"') else value)
    return out


def _names(attrs: dict[str, str], words: frozenset[str]) -> bool:
    for a in ("class", "id", "role"):
        for token in attrs.get(a, "").lower().split():
            parts = set(_PARTS.split(token))
            if parts & words and not parts & STATES:
                return True
    return False


def _hidden(attrs: dict[str, str]) -> bool:
    style = attrs.get("style", "").lower().replace(" ", "")
    return "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style


def parse(page: str) -> Page:
    """The page's blocks in order, with white space folded and references decoded, and their containers."""
    out = Page(containers=[Container("", -1, False, False, False)])
    stack = [0]
    parts: list[str] = []
    link_at = -1  # number of parts when the open link began
    across = False  # the open link has an end of its own
    links = 0
    leaf_aside = heading = False
    control = ""  # the form control that is open
    next_close = next_open = -1  # of links

    def flush() -> None:
        nonlocal links, link_at
        if parts:
            if link_at >= 0:
                links += sum(map(len, parts[link_at:]))
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                b = Block(text, links, stack[-1], leaf_aside, heading)
                words = _WORD.findall(text.lower())
                b.words, b.stops = len(words), sum(w in STOP_WORDS for w in words)
                out.blocks.append(b)
            parts.clear()
        link_at = 0 if link_at >= 0 and across else -1
        links = 0

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not control:
            parts.append(page[at:lt])
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        if not page[lt + 1 : lt + 3].lstrip("/")[:1].isalpha():
            if not control:
                parts.append("<")
            at = lt + 1
            continue
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not m:  # no tag ends any more
            break
        at = m.end()
        closing, tag, source = m[1], m[2].lower(), m[3]
        if tag in RAW or tag in DROPPED:
            if not closing:
                if source.endswith("/") and tag in ("svg", "math"):
                    continue
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in RAW:
                    break
                if not control:
                    parts.append(" ")
            continue
        if tag in CONTROLS:
            control = "" if closing else tag
            continue
        if tag == "option" and control == "select":
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            if link_at >= 0:
                links += sum(map(len, parts[link_at:]))
            link_at = -1 if closing else len(parts)
            if not closing:
                if next_close < at:
                    found = page.find("</a", at)
                    next_close = n + 1 if found < 0 else found
                if next_open < at:
                    nxt = _NEXT_LINK.search(page, at)
                    next_open = nxt.start() if nxt else n
                across = next_close < next_open or (next_close <= n and next_open == n)
        elif tag in BLOCKS:
            flush()
            control, leaf_aside, heading = "", False, False
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if out.containers[stack[k]].tag == tag:
                        for c in stack[k:]:
                            out.containers[c].end = len(out.blocks)
                        del stack[k:]
                        break
                continue
            attrs = attributes(source) if source and not source.isspace() else {}
            up = out.containers[stack[-1]]
            if tag in LEAVES:
                heading = tag in HEADINGS
                leaf_aside = bool(attrs) and (_hidden(attrs) or _names(attrs, BOILERPLATE))
            elif tag != "hr" and len(stack) < DEPTH:
                aside = tag in BAD_TAGS or (tag == "header" and not up.inside)
                named = False
                content = tag in ("article", "main") or attrs.get("role", "").lower() in ("article", "main")
                if attrs and tag not in ("html", "body"):
                    aside = aside or _hidden(attrs)
                    if tag not in WHOLE and (tag != "article" or up.inside):
                        named = _names(attrs, BOILERPLATE) or (not up.inside and not content and _names(attrs, UNCLEAR))
                out.containers.append(Container(tag, stack[-1], aside, up.inside or content, content, named, len(out.blocks)))
                stack.append(len(out.containers) - 1)
    flush()
    for c in stack:
        out.containers[c].end = len(out.blocks)
    return out


def set_aside(p: Page) -> list[bool]:
    """Which blocks lie in what is named as something other than the article."""
    cs = p.containers
    aside = [False] * len(cs)
    for k, c in enumerate(cs):
        aside[k] = c.aside or (c.parent >= 0 and aside[c.parent])
    for b in p.blocks:
        if not aside[b.at]:
            cs[b.at].stops += b.stops
    for k in range(len(cs) - 1, -1, -1):
        c = cs[k]
        c.mains += c.content and not aside[k]
        if k:
            cs[c.parent].stops += c.stops
            cs[c.parent].mains += c.mains
    for k, c in enumerate(cs):
        most = 2 * c.stops > cs[0].stops and c.mains == cs[0].mains
        aside[k] = aside[k] or (c.named and not most) or (c.parent >= 0 and aside[c.parent])
    return [aside[b.at] or b.aside for b in p.blocks]


def first_pass(b: Block, known: bool, inside: bool) -> bool | None:
    """True good, False bad, None ambiguous; known: the page's language has stop words here."""
    density = b.links / len(b.text)
    if density > MANY_LINKS:
        return False
    stops = b.stops / max(1, b.words)
    if b.words >= LONG:
        if density <= SOME_LINKS and (stops >= DENSE or not known) and (stops >= DENSE or _SENTENCE.search(b.text)):
            return True
        if density > SOME_LINKS or (known and not inside and stops < SPARSE and not _SENTENCE.search(b.text)):
            return False
        return None
    if b.words and density > SOME_LINKS:
        return False
    return False if "©" in b.text else None


def decide(p: Page) -> list[tuple[bool, int]]:
    """(kept, which pass decided; 0 if set aside) of each block."""
    blocks, cs = p.blocks, p.containers
    gone = set_aside(p)
    n = len(blocks)
    words = sum(b.words for b, g in zip(blocks, gone) if not g)
    known = sum(b.stops for b, g in zip(blocks, gone) if not g) >= KNOWN * words
    labels = [None if g else first_pass(b, known, cs[b.at].inside) for b, g in zip(blocks, gone)]
    content = any(cs[b.at].inside and not g and label is not False for b, g, label in zip(blocks, gone, labels))

    def sides(same: bool) -> tuple[list[int], list[int]]:
        """The nearest decided block before and after each one, of the same parent or of any."""
        got = []
        for order, none in ((range(n), -1), (range(n - 1, -1, -1), n)):
            side, last = [none] * n, {}
            for i in order:
                key = blocks[i].at if same else 0
                side[i] = last.get(key, none)
                if labels[i] is not None:
                    last[key] = i
            got.append(side)
        return got[0], got[1]

    siblings, any_ = sides(True), sides(False)

    def inherited(i: int) -> bool:
        def of(before: int, after: int) -> bool:
            if after < n and blocks[i].heading:
                return labels[after]
            if before < 0 or after >= n:
                return labels[after if before < 0 else before]
            if i - before == after - i:
                return labels[before] or labels[after]
            return labels[before if i - before < after - i else after]

        if siblings[0][i] >= 0 or siblings[1][i] < n:
            return of(siblings[0][i], siblings[1][i])
        before, after = any_[0][i], any_[1][i]
        k = blocks[i].at
        while k > 0:
            c = cs[k]
            lo, hi = before if before >= c.first else -1, after if after < c.end else n
            if lo >= 0 or hi < n:
                return of(lo, hi)
            if c.content:
                return True
            k = c.parent
        if content:
            return False
        return of(before, after) if before >= 0 or after < n else True

    return [(False, 0) if gone[i] else (labels[i], 1) if labels[i] is not None else (inherited(i), 2) for i in range(n)]


def extract(page: str | None) -> str:
    """The main text of a page: its good blocks, one to a line."""
    if not page:
        return ""
    p = parse(page)
    return "\n".join(b.text for b, (kept, _) in zip(p.blocks, decide(p)) if kept)


@F.arrow_udf(T.StringType())
def main_text(pages: pa.Array) -> pa.Array:
    return pa.array([extract(p) for p in pages.to_pylist()], pa.string())


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", main_text("html").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
