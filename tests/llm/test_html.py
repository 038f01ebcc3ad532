"""The block rules against a plain version on random pages, and on pages that ordinary sites have."""

from __future__ import annotations

import random
import time
from html.parser import HTMLParser

import pytest

from quarry.llm import html
from quarry.llm.html import extract

TEXT = "The house by the river was sold to a man who had come from the city, and it is not for us to say more about it. " * 3
LONG = TEXT.strip()


@pytest.mark.parametrize(
    "page",
    [
        f'<body class="single has-sidebar"><p>{LONG}</p></body>',
        f'<body class="cookie-consent-off"><article><p>{LONG}</p></article></body>',
        f'<body class="sidebar"><main class="page form"><p>{LONG}</p></main></body>',
        f'<article class="post comments-open"><p>{LONG}</p></article>',
        f'<article data-hidden="false"><p>{LONG}</p></article>',
        f'<article data-id="menu"><p>{LONG}</p></article>',
        f'<p title="hidden gem">{LONG}</p>',
        f'<div class="layout-sidebar"><p>{LONG}</p></div>',
        f'<form action="x"><input><p>{LONG}</p></form>',
        f"<p>{LONG}</p><button>Press",
        f'<p>{LONG}</p><svg><path d="x">',
        f"<noscript><p>{LONG}</p>",
        f'<a name="top"><p>{LONG}</p>',
    ],
)
def test_long_text_stays(page):
    assert extract(page) == LONG


def test_text_outside_a_teaser_stays():
    other = LONG.replace("house", "mill")
    assert extract(f"<p>{LONG}</p><article><p>{other}</p></article>") == f"{LONG}\n{other}"


def test_unclosed_elements_end_with_the_block():
    for tag in ("button", "select"):
        assert extract(f"<article><p>{LONG}</p><{tag}>Press<p>Short end.</p></article>") == f"{LONG}\nShort end."
    for tag in ("object", "svg", "audio", "video", "template", "math"):
        assert extract(f"<article><p>{LONG}</p><{tag}><p>Short end.</p></article>") == f"{LONG}\nShort end."
        assert extract(f"<article><p>{LONG}</p><{tag}>gone</{tag}><p>Short end.</p></article>") == f"{LONG}\nShort end."


@pytest.mark.parametrize("name", ["warning", "notice", "legal", "search", "share", "reply", "related", "message"])
def test_unclear_names_in_the_article_leave_it_whole(name):
    page = f'<article><p>{LONG}</p><p class="{name}">{LONG}</p><div class="{name}"><p>{LONG}</p></div></article>'
    assert extract(page) == "\n".join([LONG] * 3)


def test_boilerplate_goes():
    page = f"""<header><p>{LONG}</p></header><nav><ul><li><a href=x>Home</a></li></ul></nav><div class="cookie-notice">{LONG}</div>
<div class="notice">{LONG}</div><article><header><h1>Title</h1></header><p>{LONG}</p><div class="ad">{LONG}</div><p>End.</p>
<section id="comments"><article class="comment"><p>{LONG}</p></article></section></article>
<div id="sidebar"><p>{LONG}</p></div><aside>{LONG}</aside><p style="display: none">{LONG}</p><p hidden>{LONG}</p>
<ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul><footer>{LONG}</footer>"""
    assert extract(page) == f"Title\n{LONG}\nEnd."


def test_two_passes_without_an_article():
    page = f"""<div><a href=a>Home</a> | <a href=b>News</a></div><div><h1>Title</h1><p>Short.</p><p>{LONG}</p><p>End.</p></div>
<div><h2>More</h2><ul><li><a href=c>{LONG}</a></li></ul></div><div>© 2020 A house</div>"""
    assert extract(page) == f"Title\nShort.\n{LONG}\nEnd."
    decided = [by for _, by in html.decide(html.parse(page))]
    assert 1 in decided and 2 in decided


def test_an_article_of_short_blocks_stays():
    assert extract("<nav><a href=x>Home</a></nav><article><h1>Title</h1><p>Short.</p></article><footer>foot</footer>") == "Title\nShort."
    assert extract("<p>Short.</p>") == "Short."


def test_other_languages_and_code_stay():
    finnish = "Talo joen rannalla myytiin miehelle joka oli tullut kaupungista eikä meidän asiamme ole sanoa enempää. " * 3
    assert extract(f"<ul><li><a href=x>Koti</a></ul><p>{finnish}</p><p>Loppu.</p>") == f"{finnish.strip()}\nLoppu."
    code = "def f x return x plus y times z minus w over v"
    assert extract(f"<article><p>{LONG}</p><pre>{code}</pre></article>") == f"{LONG}\n{code}"


def test_references_and_space():
    assert extract("<p>A &amp;&nbsp;&lt;b&gt;\n\t c&#233;</p>") == "A & <b> cé"
    assert extract("<p>1 < 2 and 3 <4</p>") == "1 < 2 and 3 <4"


def test_very_long_and_hostile_pages_take_time_in_proportion():
    began = time.time()
    assert len(extract(f"<p>{LONG}</p>" * 6000)) == 6000 * (len(LONG) + 1) - 1
    for piece in ("<a>", "<div>", "<a href=x>y", "</p", "<p class='", "<button>", "<svg>", "<script>", "<!--", "&lt"):
        extract(f"<p>{LONG}</p>" + piece * 60_000)
    assert time.time() - began < 60


class Plain(HTMLParser):
    """Blocks of a well-formed page as (text, link characters, path of containers, heading)."""

    def __init__(self):
        super().__init__()
        self.path, self.out, self.text, self.links, self.link, self.heading, self.number = [], [], "", 0, False, False, 0

    def flush(self):
        if t := " ".join(self.text.split()):
            self.out.append((t, self.links, tuple(self.path), self.heading))
        self.text, self.links = "", 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = True
        elif tag in html.BLOCKS:
            self.flush()
            self.heading = tag in html.HEADINGS
            if tag not in html.LEAVES:
                self.number += 1
                self.path.append((tag, self.number))

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
        elif tag in html.BLOCKS:
            self.flush()
            self.heading = False
            if tag not in html.LEAVES:
                self.path.pop()

    def handle_data(self, data):
        self.text += data
        self.links += len(data) * self.link


def plain_extract(page: str) -> str:
    """The rules by their words: every ambiguous block looks at every other one."""
    p = Plain()
    p.feed(page)
    p.flush()
    blocks = [b for b in p.out]
    gone = [any(t in html.BAD_TAGS for t, _ in b[2]) for b in blocks]
    words = [[w for w in html._WORD.findall(b[0].lower())] for b in blocks]
    stops = [sum(w in html.STOP_WORDS for w in ws) for ws in words]
    left = [i for i in range(len(blocks)) if not gone[i]]
    known = sum(stops[i] for i in left) >= 0.03 * sum(len(words[i]) for i in left)
    inside = [any(t in ("article", "main") for t, _ in b[2]) for b in blocks]
    label = {}
    for i in left:
        text, links = blocks[i][:2]
        share, density, sentence = stops[i] / max(1, len(words[i])), links / len(text), bool(html._SENTENCE.search(text))
        if density > 0.5:
            label[i] = False
        elif len(words[i]) >= 12:
            if density <= 0.33 and (share >= 0.12 or (not known and sentence)):
                label[i] = True
            elif density > 0.33 or (known and not inside[i] and share < 0.04 and not sentence):
                label[i] = False
        elif (words[i] and density > 0.33) or "©" in text:
            label[i] = False
    content = any(inside[i] and label.get(i) is not False for i in left)

    def nearest(i, group):
        before, after = [j for j in group if j < i], [j for j in group if j > i]
        if after and blocks[i][3]:
            return label[min(after)]
        gap = min(abs(i - j) for j in group)
        return any(label[j] for j in (i - gap, i + gap) if j in group)

    def inherit(i):
        path = blocks[i][2]
        if group := [j for j in label if blocks[j][2] == path]:
            return nearest(i, group)
        for depth in range(len(path), 0, -1):
            if group := [j for j in label if blocks[j][2][:depth] == path[:depth]]:
                return nearest(i, group)
            if path[depth - 1][0] in ("article", "main"):
                return True
        if content:
            return False
        return nearest(i, list(label)) if label else True

    return "\n".join(blocks[i][0] for i in left if (label[i] if i in label else inherit(i)))


def random_page(r: random.Random) -> str:
    def words(n, share):
        return " ".join(r.choice(("the", "of", "and", "is")) if r.random() < share else r.choice(("xkcd", "brum", "tolk", "vex")) for _ in range(n)) + r.choice(("", ".", ". ©" if r.random() < 0.2 else "!"))

    def block(depth):
        kind = r.random()
        if depth < 4 and kind < 0.35:
            tag = r.choice(("div", "div", "div", "section", "article", "main", "nav", "ul", "blockquote"))
            return f"<{tag}>" + "".join(block(depth + 1) for _ in range(r.randint(0, 4))) + f"</{tag}>"
        tag = r.choice(("p", "p", "p", "li", "h2"))
        body = words(r.randint(1, 30), r.choice((0, 0.03, 0.1, 0.3)))
        if r.random() < 0.3:
            body += f" <a href=x>{words(r.randint(1, 20), 0.2)}</a>"
        return f"<{tag}>{body}</{tag}>"

    return "<html><body>" + "".join(block(0) for _ in range(r.randint(1, 8))) + "</body></html>"


def test_random_pages_match_the_plain_version():
    r = random.Random(5)
    passes = set()
    for _ in range(1500):
        page = random_page(r)
        assert extract(page) == plain_extract(page), page
        passes.update(html.decide(html.parse(page)))
    assert passes == {(False, 0), (True, 1), (False, 1), (True, 2), (False, 2)}
