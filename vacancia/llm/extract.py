"""Operator 8: main text of HTML pages by text-to-tag ratios.

Events of the standard library's parser are turned into lines, one for each block. A line's ratio is
its text outside links over its tags; lines in page furniture (by element, role or class) count
zero; a class or id names furniture as a whole only ("sidebar", "cookie-notice", not "has-sidebar"). What is named as comments, adverts, notices or forms
is furniture at any size and on any element but html, body and main, an article too; what is named as layout (header, menu, sidebar) is not if it holds
a main, all articles or most of the text. The ratios are smoothed by a Gaussian over neighbouring lines, and a threshold at a share of
their standard deviation divides the lines into two clusters. A content region is an article, or
outside of these an element with a line of the upper cluster; all its lines but furniture are kept, so short paragraphs stay, but for
lines that are links alone and don't stand between its lines of the upper cluster.

A task holds one page, of any length, and its lines. Defined results: null or empty html, or a page of furniture alone, gives an empty text and
n_chars 0; markup that is never closed ends with the page; lines of equal ratios fall to one side of the threshold together; repeated rows give
repeated results; null page_id and url are carried; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vacancia.llm.common import map_arrow, texts

SIGMA, REACH = 1.0, 2
THRESHOLD = 0.5  # of the standard deviation of the smoothed ratios

# Fixed values of HTML: elements by their part in a page.
UNSEEN = {"script", "style", "noscript", "template", "iframe", "object", "svg", "head", "canvas", "audio", "video"}
FURNITURE = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset", "textarea", "label"}
CONTAINERS = FURNITURE | UNSEEN | {"html", "body", "main", "article", "section", "div", "header", "ul", "ol", "dl", "table", "figure", "blockquote", "details"}
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "pre", "hr", "caption", "figcaption", "address", "center", "option", "summary", "tbody", "thead", "tfoot", "legend"}
BREAKS = {"br", "wbr", "img", "input"}
#: Elements that no name makes furniture; those that any block ends, and those that one of their kind ends.
KEPT = {"html", "body", "main"}
LINES, ITEMS = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "dt", "dd", "td", "th", "tr", "option"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Words that name furniture: of readers' comments, of adverts, notices and forms, and of layout.
COMMENTS = {"comment", "comments", "commentlist", "disqus", "replies"}
INSERTS = {
    "ad", "ads", "adsbygoogle", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "notice", "notices", "alert", "popup", "modal", "overlay",
    "newsletter", "subscribe", "signup", "login",
}
LAYOUT = {
    "banner", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "sidebar", "widget", "footer", "header", "masthead", "toolbar",
    "share", "sharing", "social", "related", "recommended", "search",
}
MARKS = COMMENTS | INSERTS | LAYOUT
#: Words with which a name tells of a state and not of what an element is ("has-comments", "comments-open").
STATES = {"has", "with", "no", "non", "not", "without", "is", "open", "closed", "enabled", "disabled", "count", "allow", "off", "on", "show", "hide", "free"}
#: Words for parts and places of inserts.
PARTS = {"section", "wrapper", "wrap", "container", "content", "inner", "outer", "form", "block", "slot", "unit", "item", "body", "message", "text", "label", "panel", "region", "zone", "space", "dialog", "strip", "inline"}
#: Words that may stand beside one of MARKS in the name of furniture; any other word leaves it to the ratios.
BESIDE = {"site", "global", "top", "bottom", "left", "right", "primary", "secondary", "bar", "list", "links", "area", "box"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}

_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[^a-z]+")


class Lines(HTMLParser):
    """Collects lines: text, characters in links, tags, parent, and whether the line is furniture."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, int, int, int, int, bool, tuple[int, ...]]] = []  # text, link characters, tags, parent, article, furniture, named
        self.stack: list[tuple[str, int, int, bool, bool, tuple[int, ...]]] = [("", 0, 0, False, False, ())]  # tag, number, article, furniture, unseen, named
        self.articles: list[tuple[str, tuple[int, ...]]] = []  # tag and named elements around each article and main
        self.count = 0
        self.around: dict[int, int] = {}  # the container that a container stands in
        self.parts: list[str] = []
        self.linked = self.tags = self.links = 0

    def line(self) -> None:
        """Ends the line that is open."""
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            _, number, article, furniture, _, named = self.stack[-1]
            self.rows.append((text, self.linked, self.tags, number, article, furniture, named))
            self.linked = self.tags = 0
        self.parts = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "a":
            self.links += 1
        if tag in BREAKS:
            self.parts.append(" ")
        insert = bool(attrs) and tag not in KEPT and named_insert(attrs)
        if tag not in BLOCKS:
            if insert and tag not in VOID:  # within a line: its words are left out
                self.stack.append((tag, *self.stack[-1][1:4], True, self.stack[-1][5]))
            return
        self.line()
        self.end_items(tag)
        if insert and tag not in CONTAINERS and tag not in VOID:
            self.stack.append((tag, *self.stack[-1][1:3], True, *self.stack[-1][4:]))
        if tag == "body":  # a head that is never closed ends here
            self.stack = [x for x in self.stack if x[0] != "head"]
        if tag in CONTAINERS:
            self.count += 1
            self.around[self.count] = self.stack[-1][1]
            _, _, article, furniture, unseen, named = self.stack[-1]
            if tag in ("article", "main"):
                article = article or self.count
                self.articles.append((tag, named))
            plain = bool(attrs) and tag not in ("html", "body", "main", "article")
            furniture = furniture or tag in FURNITURE or tag == "header" and not article or plain and marked(attrs) or insert
            if plain and named_furniture(attrs):
                named = (*named, self.count)
            self.stack.append((tag, self.count, article, furniture, unseen or tag in UNSEEN, named))

    def end_items(self, tag: str) -> None:
        """Ends what a block's begin ends: a paragraph or heading, and an item of the same list or row."""
        while self.stack[-1][0] in LINES or tag in ITEMS and self.stack[-1][0] in ITEMS or self.stack[-1][4] and self.stack[-1][0] not in BLOCKS:
            self.stack.pop()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.links = 0
        if tag in BLOCKS:
            self.line()
        if tag not in CONTAINERS:  # only inserts are on the stack, down to the next container
            at = len(self.stack) - 1
            while self.stack[at][0] != tag and self.stack[at][0] not in CONTAINERS and at:
                at -= 1
            if at and self.stack[at][0] == tag:
                del self.stack[at:]
        else:
            at = next((i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i][0] == tag), 0)
            if at:
                del self.stack[at:]
                self.links = 0

    def handle_data(self, data: str) -> None:
        if self.stack[-1][4]:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data)


def named_insert(attrs: list) -> bool:
    """Whether a class or id names comments, an advert, a notice or a form: furniture whatever it holds."""
    for name, value in attrs:
        if name in ("class", "id") and value:
            for one in value.lower().split():
                parts = set(_PARTS.split(one)) - {""}
                if parts & COMMENTS and not parts & STATES or parts & INSERTS and parts <= MARKS | BESIDE | PARTS:
                    return True
    return False


def named_furniture(attrs: list) -> bool:
    """Whether a class or id is a name of furniture: words of MARKS, with words of BESIDE at most."""
    for name, value in attrs:
        if name in ("class", "id") and value:
            for one in value.lower().split():
                parts = set(_PARTS.split(one)) - {""}
                if parts & MARKS and parts <= MARKS | BESIDE:
                    return True
    return False


def believed(parser: Lines) -> set[int]:
    """The elements named as furniture that may be: none with a main, with all articles of the page, or with most of its text outside links."""
    weight: dict[int, int] = {}
    whole = 0
    for text, linked, _, _, _, furniture, named in parser.rows:
        size = 0 if furniture else max(len(text) - linked, 0)
        whole += size
        for n in named:
            weight[n] = weight.get(n, 0) + size
    around = [set(named) for _, named in parser.articles]
    held = set().union(*(set(named) for tag, named in parser.articles if tag == "main")) | (set.intersection(*around) if around else set())
    return {n for n, size in weight.items() if n not in held and 2 * size <= whole}


def marked(attrs: list) -> bool:
    """Whether role or style say that an element is furniture or hidden."""
    for name, value in attrs:
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def smooth(ratios: np.ndarray) -> np.ndarray:
    kernel = np.exp(-np.square(np.arange(-REACH, REACH + 1) / SIGMA) / 2)
    padded = np.concatenate([np.zeros(REACH), ratios, np.zeros(REACH)])
    return np.convolve(padded, kernel / kernel.sum(), "valid")


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.line()
    if not parser.rows:
        return ""
    furniture = believed(parser)
    rows = [(*r[:5], r[5] or not furniture.isdisjoint(r[6])) for r in parser.rows]
    ratios = np.array([0.0 if f else max(len(t) - linked, 0) / max(tags, 1) for t, linked, tags, _, _, f in rows])
    smoothed = smooth(ratios)
    upper = (smoothed > THRESHOLD * smoothed.std()) & (ratios > 0)
    articles = {r[4] for r, u in zip(rows, upper) if u and r[4]}
    keep = np.array([r[4] in articles for r in rows])
    spans: dict[int, tuple[int, int]] = {}
    for i in np.flatnonzero(upper & ~keep).tolist():
        parent = rows[i][3]
        spans[parent] = (spans.get(parent, (i, i))[0], i)
    for a, b in spans.values():
        keep[a : b + 1] = True
    within = {0: 0 in spans}  # whether a container is, or stands in, one that holds a line of the upper cluster

    def inside(number: int) -> bool:
        way = []
        while number not in within and number not in spans:
            way.append(number)
            number = parser.around[number]
        found = within.get(number, True)
        within.update(dict.fromkeys(way, found))
        return found

    if spans:
        keep |= (ratios > 0) & np.array([inside(r[3]) for r in rows])
    return "\n\n".join(r[0] for r, k in zip(rows, keep) if k and not r[5])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row."""

    def make():
        def step(batch: pa.RecordBatch):
            found = [main_text(h) for h in texts(batch.column(2))]
            return [batch.column(0), batch.column(1), found, list(map(len, found))]

        return step

    return map_arrow(pages.select("page_id", "url", "html"), make, "page_id long, url string, text string, n_chars long")
