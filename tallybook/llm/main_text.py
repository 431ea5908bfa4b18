"""Main text of web pages by tree scoring.

The markup is cut into a small tree. Elements that are never content by their tag
(menus, headers, footers, forms, scripts) or by a word of their class, id or role
go first. Every paragraph then gives points for its length and commas to its
ancestors, halved at each level up; a container's points are discounted by the
share of its text that stands in links. The best container is kept with those of
its siblings that score near it or are long and nearly free of links. Its blocks
are the text runs between block tags, in page order.

Null and empty html give an empty text, broken markup is read as far as it goes,
text outside any tag counts as the page's body. Of containers with equal scores the
first is the best. Repeated rows each get their result, extra columns are ignored, an
empty table gives no rows. Pages of any length and depth are read whole: sizes are
computed once, and no step calls itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag, and no content of the page.
RAW = frozenset("script style iframe head title textarea".split())
BOILERPLATE = frozenset("nav header footer aside form button select menu dialog fieldset input label option noscript template svg canvas annotation annotation-xml".split()) | RAW
#: What is a heading or text of its own within an article.
IN_ARTICLE = frozenset("header label".split())
#: Elements in which a slash closes a tag, and tags that end them wherever they stand, as an unclosed picture does not hold the rest of a page.
FOREIGN = ("svg", "math")
BREAKOUT = frozenset("b blockquote br center code dd div dl dt em h1 h2 h3 h4 h5 h6 hr i img li nav ol p pre s section article main header footer small span strong sub sup table u ul".split())
BLOCK = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside".split())
CONTAINER = frozenset("article body div main section td html blockquote".split())
#: Words that, in a class, id or role, name the parts that are no content: our own list, one line
#: per kind: menus, headers, footers, sidebars, notices, adverts, forms, reader comments, sharing.
_NAMES = """
menu menubar nav navbar navigation breadcrumb breadcrumbs pager pagination toolbar topbar
header masthead banner
footer copyright
sidebar related recommended
notice cookie cookies consent gdpr disclaimer popup modal
ad ads advert advertisement advertising promo promotion promoted sponsor sponsored
form login signup sign-up search subscribe subscription newsletter
comment comments commentlist replies respond disqus
share sharing social
"""
NEGATIVE = re.compile(rf"(?:^|[\s_-])(?:{'|'.join(_NAMES.split())})(?:$|[\s_-]|\d)", re.I)
#: Names of a header are those of an article's heading within one.
NEGATIVE_INSIDE = re.compile(rf"(?:^|[\s_-])(?:{'|'.join(n for n in _NAMES.split() if n not in ('header', 'masthead', 'banner'))})(?:$|[\s_-]|\d)", re.I)
POSITIVE = re.compile(r"(?:article|body|content|entry|main|post|story|text)", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}
#: An opening tag of the first kind ends the nearest open element of the second, unless one of the third lies nearer.
_LIST, _CELL = ({"ul", "ol"}, {"table", "tbody", "thead"})
_CLOSES = {"li": ({"li"}, _LIST), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, _CELL), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
_CLOSES |= dict.fromkeys(BLOCK - {"body", "html", "li", "td", "th", "tr", "dd", "dt", "tbody", "thead", "tfoot"}, ({"p"}, CONTAINER | {"li", "table", "td", "th"}))
#: Elements that give points as a whole; of containers the text that stands in them directly does.
_PARAGRAPH = frozenset("p pre h1 h2 h3 blockquote li td dd".split())
_SCORED = CONTAINER | {"ul", "ol", "table", "span", "center"}


class Node:
    """An element. ``bad`` ones, and ``dead`` ones inside them, are no content; sizes do not count those."""

    __slots__ = ("tag", "parent", "kids", "bad", "dead", "good", "score", "chars", "links", "commas")

    def __init__(self, tag: str, parent: Node | None, bad: bool = False, good: bool = False):
        self.tag, self.parent, self.bad, self.good = tag, parent, bad, good
        self.dead = bad or parent is not None and parent.dead
        self.kids: list[Node | str] = []
        self.score, self.chars, self.links, self.commas = 0.0, 0, 0, 0

    @property
    def density(self) -> float:
        """The share of the text that stands in links."""
        return self.links / self.chars if self.chars else 1.0


class _Open:
    """The open elements, with the places of each tag, so that no lookup walks a deep page."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def close(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()

    def nearest(self, tags) -> int:
        """The place of the innermost open element with one of the tags, 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


def _kind(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether it is named like content. A header within an article, by tag or by name, is its heading."""
    bad, good = tag in BOILERPLATE and not (tag in IN_ARTICLE and in_article), tag in ("article", "main")
    negative = NEGATIVE_INSIDE if in_article else NEGATIVE
    if attrs and "=" in attrs or "hidden" in attrs:
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name == "hidden" or name == "aria-hidden" and value == "true" or name in ("class", "id", "role") and tag != "article" and negative.search(value):
                bad = True
            elif name in ("class", "id", "role") and POSITIVE.search(value):
                good = True
    return bad, good


def parse(html: str) -> list[Node]:
    """The elements of a page in page order, the root first; comments and raw text keep no text."""
    root = Node("html", None)
    nodes, open_, at, n = [root], _Open(root), 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            open_.stack[-1].kids.append(html[at:])
            break
        if m.start() > at:
            open_.stack[-1].kids.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            place = open_.nearest((tag,))
            if place:
                open_.close(place)
            continue
        if tag in ("html", "body"):
            continue
        foreign = min((open_.places[t][0] for t in FOREIGN if open_.places.get(t)), default=0)
        if foreign and tag in BREAKOUT and open_.nearest(("foreignobject",)) < open_.nearest(FOREIGN):
            open_.close(foreign)
            foreign = 0
        # elsewhere HTML takes no notice of a slash at a tag's end
        single = tag in VOID or m[3].endswith("/") and (foreign > 0 or tag in FOREIGN)
        if tag in RAW and not single:
            end = _RAW_END[tag].search(html, at)
            if end or tag not in ("head", "iframe"):
                at = end.end() if end else n
            continue
        if tag in _CLOSES:
            ends, scope = _CLOSES[tag]
            place = open_.nearest(ends)
            if place > open_.nearest(scope):
                open_.close(place)
        node = Node(tag, open_.stack[-1], *_kind(tag, m[3], bool(open_.places.get("article"))))
        node.parent.kids.append(node)
        nodes.append(node)
        if not single:
            open_.push(node)
    return nodes


def _measure(nodes: list[Node]) -> None:
    """Characters, characters in links and commas of every element, children before their parents."""
    for x in reversed(nodes):
        if x.dead:
            continue
        for k in x.kids:
            if isinstance(k, str):
                t = _SPACE.sub(" ", k).strip()
                x.chars += len(t)
                x.commas += t.count(",")
            elif not k.bad:
                x.chars += k.chars
                x.commas += k.commas
                x.links += k.chars if k.tag == "a" else k.links


def _score(nodes: list[Node]) -> None:
    """Paragraphs, and direct text of containers, give points to their ancestors."""
    for x in nodes:
        own = x.tag in _PARAGRAPH
        if x.dead or not (own or x.tag in CONTAINER):
            continue
        if own:
            chars, links, commas = x.chars, x.links, x.commas
        else:
            texts = [_SPACE.sub(" ", k).strip() for k in x.kids if isinstance(k, str)]
            chars, links, commas = sum(map(len, texts)), 0, sum(t.count(",") for t in texts)
        if not chars:
            continue
        points = (1 + commas + min(chars / 100, 3)) * (1 - links / chars)
        up, share = (x.parent if own else x), 1.0
        while up is not None and share > 0.05:
            up.score += points * share
            up, share = up.parent, share / 2


def _blocks(node: Node, out: list[list[str]]) -> None:
    """Adds the text of an element to the last block of ``out``; each block tag begins and ends one."""
    walk = [(iter(node.kids), False)]
    while walk:
        kids, block = walk[-1]
        for k in kids:
            if isinstance(k, str):
                out[-1].append(k)
            elif k.tag == "br":
                out[-1].append(" ")
            elif not k.bad:
                inner = k.tag in BLOCK
                if inner:
                    out.append([])
                walk.append((iter(k.kids), inner))
                break
        else:
            walk.pop()
            if block:
                out.append([])


def main_text(html: str | None) -> str:
    """The main text of one page: blocks in page order, joined by an empty line."""
    if not html:
        return ""
    nodes = parse(html)
    _measure(nodes)
    _score(nodes)
    best, top = nodes[0], -1.0
    for x in nodes:
        if x.score > 0 and not x.dead and x.tag in _SCORED:
            x.score *= 1 - x.density
            value = x.score * (1.25 if x.good else 1.0) + 5 * x.good
            if value > top:
                best, top = x, value
    keep = [best]
    if best.parent is not None:
        keep = []
        for s in best.parent.kids:
            if s is best:
                keep.append(s)
            elif not isinstance(s, str) and not s.bad:
                near = s.tag in CONTAINER and s.score >= max(10.0, 0.2 * top) and s.density < 0.3
                if near or s.tag == "p" and s.chars > 80 and s.density < 0.25 or s.tag in ("h1", "h2") and s.chars and s.density < 0.25:
                    keep.append(s)
    out: list[list[str]] = []
    for x in keep:
        out.append([])
        _blocks(x, out)
    texts = (_SPACE.sub(" ", unescape("".join(b))).strip() for b in out)
    return "\n\n".join(t for t in texts if t)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages(page_id, url, html)``: page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable] = {"op7_main_text": query}
