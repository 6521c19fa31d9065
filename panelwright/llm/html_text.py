"""Main text of web pages: blocks labelled content or boilerplate by a minimum cut.

A page is read once into blocks (runs of text inside one block-level element)
with their chain of elements. A linear classifier gives every block a score
from its landmarks (elements and the words of their class, id and role), link
density, length and wording. The score is the block's terminal capacity, to
the content side if positive, to the boilerplate side if negative. Smoothness
edges join blocks that follow each other and blocks that follow each other
inside one element, so that a block without evidence goes with its
neighbours. The minimum cut decides all blocks of a page together.

Scale. Pages are independent rows; one pass without a shuffle, work and memory
in proportion to the page. Nothing is learned from the data.

Edge cases: null or empty html, or html without blocks of content, gives an
empty text with n_chars 0; unclosed, stray and misnested tags are accepted, a
script without an end reaches to the end of the page, as in browsers; equal
rows each keep their row; null ids and urls stay; very long pages are read
whole; an empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from panelwright.llm.common import arrow_map, read
from panelwright.llm.mincut import settle
from panelwright.llm.registry import query

TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[a-z]+")
UNFINISHED = re.compile(r"<[a-zA-Z/!?]")

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template iframe object svg math canvas audio video head title textarea select button option datalist dialog xmp noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split()
)
# A start tag of the left closes an open element of the right beside it.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody"), "body": ("head",),
}
HOLDERS = frozenset("ul ol dl table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Landmarks. Elements and roles that are never the article, elements that hold it,
# and words of class and id for both.
OUTER_TAGS = frozenset("nav footer aside form menu fieldset".split())
OUTER_ROLES = frozenset("navigation contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
MAIN_TAGS = frozenset("article main".split())
OUTER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation navi menu topbar breadcrumb breadcrumbs "
    "sidebar aside widget widgets footer foot masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "related recommended recommendations trending popular share sharing social comment comments commentlist disqus discussion reply replies respond "
    "pagination pager paging toolbar search hidden tags tagcloud copyright legal disclaimer outbrain taboola skip".split()
)
MAIN_WORDS = frozenset("article content post story entry main text body prose articlebody".split())
SMALL_PRINT = re.compile(
    r"©|\(c\) \d{4}|all rights reserved|\bcookies?\b|accept all|\bsubscribe\b|sign (?:up|in)\b|\blog ?in\b|\bread more\b|share (?:on|this)|follow us|privacy policy|terms of (?:use|service)|"
    r"\badvertisement\b|\bsponsored\b|skip to|back to top|leave a (?:comment|reply)|\d+ comments?\b",
    re.I,
)
# Weights of the classifier and of the smoothness edges, in hundredths.
W_OUTER, W_HINT, W_MAIN, W_MAIN_HINT = -900, -500, 400, 150
W_HEADER, W_LINKED, W_LONG, W_MIDDLE, W_SHORT, W_SENTENCE, W_HEADING, W_PRINT = -500, -250, 150, 50, -60, 50, 60, -200
NEXT_TO, SAME_ELEMENT = 60, 100


class Element(NamedTuple):
    tag: str
    parent: int
    words: frozenset
    roles: frozenset
    shown: bool


class Block(NamedTuple):
    text: str
    element: int
    linked: int  # characters inside links


def _attributes(tag: str, raw: str) -> tuple[frozenset, frozenset, bool]:
    """Words of class and id, roles, and whether the element is shown."""
    if not raw or "=" not in raw and "hidden" not in raw:
        return frozenset(), frozenset(), True
    words, roles, shown = set(), set(), True
    for name, value in ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "itemprop"):
            words.update(WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
        elif name == "role":
            roles.update(value.lower().split())
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            shown = False
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            shown = False
    return frozenset(words), frozenset(roles), shown


class _Reader:
    """Blocks and elements of one page."""

    def __init__(self):
        self.elements = [Element("", -1, frozenset(), frozenset(), True)]
        self.holds_main = [False]
        self.stack = [0]
        self.open: dict[str, int] = {}
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.articles = 0
        self.link_depth = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, self.stack[-1], min(self.linked, len(text))))
            self.parts = []
        self.linked = 0

    def text(self, raw: str) -> None:
        t = html.unescape(raw) if "&" in raw else raw
        self.parts.append(t)
        if self.open.get("a"):
            self.linked += len(" ".join(t.split()))

    def pop(self) -> None:
        tag = self.elements[self.stack.pop()].tag
        self.open[tag] -= 1
        if self.link_depth > len(self.stack):  # a link left open ends with the element it began in
            self.open["a"] = 0

    def close_to(self, tags, holders=frozenset()) -> None:
        """Close the innermost open element of ``tags``, unless a holder lies above it."""
        if not any(self.open.get(t) for t in tags):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.elements[self.stack[at]].tag
            if tag in tags:
                while len(self.stack) > at:
                    self.pop()
                return
            if tag in holders:
                return

    def start(self, tag: str, raw: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag == "a":
            self.open["a"] = 0 if raw.rstrip().endswith("/") else 1
            self.link_depth = len(self.stack)
            return
        if tag in INLINE:
            return
        self.flush()
        if tag in VOID:
            return
        if tag != "p" or self.open.get("p"):
            self.close_to(("p",), HOLDERS | MAIN_TAGS | {"div", "section", "blockquote", "li", "td"})
        if tag in CLOSES:
            self.close_to(CLOSES[tag], HOLDERS)
        words, roles, shown = _attributes(tag, raw)
        self.elements.append(Element(tag, self.stack[-1], words, roles, shown))
        self.holds_main.append(False)
        first = tag == "article" and not self.articles and not words & OUTER_WORDS
        self.articles += tag == "article"
        if tag in ("main", "h1") or first:
            for i in reversed(self.stack):
                if self.holds_main[i]:
                    break
                self.holds_main[i] = True
        if not raw.endswith("/"):
            self.stack.append(len(self.elements) - 1)
            self.open[tag] = self.open.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.open["a"] = 0
        elif tag not in INLINE:
            self.flush()
            self.close_to((tag,))

    def read(self, page: str) -> None:
        at, stop = 0, page.rfind(">") + 1  # no tag ends beyond
        while True:
            found = TOKEN.search(page, at, stop)
            if not found:
                break
            if found.start() > at:
                self.text(page[at : found.start()])
            at = found.end()
            mark, tag, raw = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
            if not tag:
                continue
            tag = tag.lower()
            if mark:
                self.end(tag)
            elif tag in UNREAD and tag not in VOID and not raw.endswith("/"):
                if tag not in INLINE:
                    self.flush()
                at = _end_of(page, at, tag)
            else:
                self.start(tag, raw)
        if at < len(page):  # a tag or comment that never ends is no text
            self.text(UNFINISHED.split(page[at:], maxsplit=1)[0])
        self.flush()


_ENDS: dict[str, re.Pattern] = {}


def _end_of(page: str, at: int, tag: str) -> int:
    """Where reading goes on after an element whose inside is not read.

    A missing end of a script or another element of raw text takes the rest of
    the page; the head ends at the body, other elements count as not opened.
    """
    if tag not in _ENDS:
        _ENDS[tag] = re.compile(r"</head\s*>|(?=<body[\s>])" if tag == "head" else rf"</{tag}[^>]*>", re.I)
    found = _ENDS[tag].search(page, at)
    if found:
        return found.end()
    return len(page) if tag in ("script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noframes") else at


def landmarks(elements: list[Element], holds_main: list[bool]) -> list[int]:
    """Score of every element from itself and the elements around it.

    An element that is never the article settles all inside it, as does one
    named so by its class or id, unless it is the one around the main element,
    the title or the first article.
    """
    out = [0] * len(elements)
    for i, e in enumerate(elements):
        above = out[e.parent] if i else 0
        if above <= W_OUTER or not e.shown or e.tag in OUTER_TAGS or e.roles & OUTER_ROLES:
            out[i] = W_OUTER
        elif e.words & OUTER_WORDS and not (holds_main[i] or e.tag in ("html", "body")):
            out[i] = W_OUTER if above > 0 else W_HINT
        elif above < 0:
            out[i] = above
        elif e.tag == "header" and above == 0:
            out[i] = W_HEADER
        elif e.tag in MAIN_TAGS or "main" in e.roles or "articlebody" in e.words:
            out[i] = W_MAIN
        elif above == 0 and e.words & MAIN_WORDS and e.tag not in ("html", "body"):
            out[i] = W_MAIN_HINT
        else:
            out[i] = above
    return out


def score(block: Block, tag: str, region: int) -> int:
    """Pull of a block to the content side (positive) or the boilerplate side."""
    words = block.text.count(" ") + 1
    s = region + (W_LONG if words >= 25 else W_MIDDLE if words >= 10 else 0 if tag in HEADINGS else W_SHORT)
    if tag in HEADINGS:
        s += W_HEADING
    if block.text[-1] in ".!?。！？…":
        s += W_SENTENCE
    if block.linked * 2 > len(block.text):
        s += W_LINKED
    if words < 40 and SMALL_PRINT.search(block.text) and region < W_MAIN:
        s += W_PRINT
    return s


def main_text(page: str | None) -> str:
    """Content blocks of one page, joined by an empty line."""
    if not page:
        return ""
    r = _Reader()
    r.read(page)
    if not r.blocks:
        return ""
    region = landmarks(r.elements, r.holds_main)
    pull = [score(b, r.elements[b.element].tag, region[b.element]) for b in r.blocks]
    edges, last = [], {}
    for i, b in enumerate(r.blocks):
        if i:
            edges.append((i - 1, i, NEXT_TO))
        home = r.elements[b.element].parent if b.element else 0
        if home in last:
            edges.append((last[home], i, SAME_ELEMENT))
        last[home] = i
    kept = settle(pull, edges)
    return "\n\n".join(b.text for b, k in zip(r.blocks, kept) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row."""

    def run(b: pa.RecordBatch):
        texts = [main_text(p).encode("utf-8", "replace").decode() for p in b.column("html").to_pylist()]
        cols = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    rows = pages.selectExpr(f"`{id_col}` AS page_id", f"`{url}` AS url", f"`{page}` AS html")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return arrow_map(rows, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


# States the result for pages with one plain article element, as the given ones have.
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS x FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(x, '</?(?:p|h[1-6]|div|ul|li)(?:\s[^>]*)?>'), lambda t: trim(regexp_replace(
  regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(t, '<br\s*/?>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&amp;?', '&', 'g'),
  '\s+', ' ', 'g'))) AS blocks FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda t: t <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM c
"""


@query("op12_main_text", SQL)
def op12_main_text(spark, sf_dir):
    return extract(read(spark, sf_dir, "pages"))
