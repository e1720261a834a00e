"""Main text of a web page by composite text density.

Every node of the page's tree gets its characters per tag, lowered where they are mostly link text. A node's
density sum is that of its children. The least density on the path from the node of greatest sum up to the
body is the threshold: nodes at or above it are content, and of each the subtree of greatest sum is taken whole.
Parts that are page furniture by their element, role or class are cut out before densities are taken; a form, or
an element furniture by its class or id, is not cut where it holds the page's main part or most of its text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallymark.llm.common import chunks

# Elements of HTML by their part in the page.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li",
    "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
FURNITURE = {
    "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "head", "title", "button", "select",
    "textarea", "dialog", "menu", "svg", "object", "audio", "video", "canvas", "noembed", "noframes"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar",
    "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "sidebars", "widget", "footer", "masthead", "cookie", "cookies", "consent", "notice", "notices",
    "gdpr", "newsletter", "subscribe", "subscription", "popup", "modal", "overlay", "comment", "comments", "disqus", "replies", "respond", "share", "sharing",
    "social", "related", "recommended", "pagination", "pager", "toolbar", "login", "signup", "search"}
HEAD = {"head", "base", "link", "meta", "title", "style", "script", "noscript", "template"}  # what a head may hold
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
# Which open elements a start tag closes, and how far up it looks.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "thead": {"caption"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"},
          "tbody": {"table"}, "tfoot": {"table"}, "thead": {"table"}}

_TOKEN = re.compile(r"<!--(?:>|->|.*?-->|.*)|<[!?][^>]*>?|</[^a-zA-Z][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>?", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>]|$)""", re.I)
_PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "links", "density", "total", "cut")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.chars = self.tags = self.link_chars = self.links = 0
        self.density = self.total = 0.0
        self.cut = ""


def _furniture(tag: str, attributes: str, in_article: bool) -> str:
    """``always`` or ``named`` (which may turn out to be a wrapper) for furniture, else empty."""
    named = "named" if tag == "form" else ""
    if not named and (tag in FURNITURE or (tag == "header" and not in_article)):
        return "always"
    if not attributes or tag in ("html", "body", "article", "main"):
        return named
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "role" and value.lower() in ROLES):
            return "always"
        if name in ("class", "id") and any(part.lower() in NAMES for part in _PARTS.split(value)):
            named = "named"
    return named


class _Open:
    """The open elements, with counts by tag so that closing never searches in vain."""

    def __init__(self, root: Node):
        self.nodes, self.count, self.cut = [root], Counter(), Counter()

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        self.count[node.tag] += 1
        self.cut[node.tag] += bool(node.cut)

    def close(self, tags: set[str], barriers: frozenset[str] | set[str]) -> None:
        """Close the innermost open element of ``tags`` and all within it, unless a barrier lies between."""
        if not any(self.count[t] for t in tags):
            return
        for at in range(len(self.nodes) - 1, 0, -1):
            tag = self.nodes[at].tag
            if tag in tags:
                for node in self.nodes[at:]:
                    self.count[node.tag] -= 1
                    self.cut[node.tag] -= bool(node.cut)
                del self.nodes[at:]
                return
            if tag in barriers:
                return


def parse(page: str) -> Node:
    """The body of a page as a tree without furniture; text leaves are strings. Unclosed and misnested tags are tolerated.

    Furniture is opened and closed as any other element and left out at the end.
    """
    root = Node("body", None)
    open_, place = _Open(root), 0
    while True:
        m = _TOKEN.search(page, place)
        text = page[place:m.start() if m else len(page)]
        if text:
            if open_.count["head"] and text.strip():
                open_.close({"head"}, set())
            open_.nodes[-1].children.append(html.unescape(text) if "&" in text else text)
        if m is None:
            return _without_furniture(root)
        place, tag, ends = m.end(), (m[2] or "").lower(), bool(m[1])
        if tag == "body" and not ends:
            open_.close({"head"}, set())
        if not tag or tag in ("html", "body"):
            continue
        if tag in RAW and not ends:  # text up to its end tag, whatever it holds
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, place)
            place = end.end() if end else len(page)
            continue
        if ends:
            open_.close({tag}, {"td", "th", "table"} - {tag} if tag in BLOCKS or open_.cut[tag] else BLOCKS)
            continue
        if open_.count["head"] and tag not in HEAD:
            open_.close({"head"}, set())
        if tag in CLOSES:
            open_.close(CLOSES[tag], SCOPES[tag])
        if tag in BLOCKS:
            open_.close({"p"}, {"td", "th", "table", "caption"})
        empty = tag in VOID or m[3].endswith("/")
        cut = _furniture(tag, m[3], bool(open_.count["article"] or open_.count["main"]))
        if cut and empty:
            continue
        node = Node(tag, open_.nodes[-1])
        node.cut = cut
        open_.nodes[-1].children.append(node)
        if tag not in VOID:
            open_.push(node)


def _without_furniture(root: Node) -> Node:
    """The tree without what is cut. Of named elements stay those around the page's article or main, else one with most of the text."""
    size: dict[int, int] = {}
    holds: dict[int, int] = {}  # articles and mains within
    for node in _postorder(root):
        node.children = [c for c in node.children if isinstance(c, str) or c.cut != "always"]
        size[id(node)] = sum(len(c.strip()) if isinstance(c, str) else size[id(c)] for c in node.children)
        holds[id(node)] = sum((c.tag in ("article", "main")) + holds[id(c)] for c in node.children if isinstance(c, Node))
    scopes = [root]
    while scopes:
        named, stack = [], [scopes.pop()]
        free = stack[0].tag in ("article", "main")
        while stack:
            node = stack.pop()
            for c in node.children:
                if isinstance(c, Node):
                    free = free or c.tag in ("article", "main")
                    (named if c.cut else stack).append(c)
        most = [n for n in named if 2 * size[id(n)] > size[id(root)]]
        around = most or [n for n in named if holds[id(n)] == 1]  # several articles may be comments
        for node in [] if free else around:
            node.cut = ""
            scopes.append(node)
    for node in _postorder(root):
        node.children = [c for c in node.children if isinstance(c, str) or not c.cut]
    return root


def _postorder(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node)]
    return order[::-1]


def weigh(body: Node) -> list[Node]:
    """Densities and density sums of all nodes; children before parents."""
    order = _postorder(body)
    for node in order:
        for child in node.children:
            if isinstance(child, Node):
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.chars if child.tag == "a" else child.link_chars
                node.links += child.links + (child.tag == "a")
            else:
                node.chars += len(child.strip())
        if node.tag == "a":
            node.link_chars = node.chars
    share = body.link_chars / max(1, body.chars)
    for node in order:
        c, lc = node.chars, node.link_chars
        if c:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            ratio = c / max(1, lc) * max(1, node.tags) / max(1, node.links)
            node.density = c / max(1, node.tags) * math.log(max(1.0, ratio)) / math.log(max(base, math.e))
        node.total = sum(x.density for x in node.children if isinstance(x, Node) and x.tag in BLOCKS)
    return order


def select(body: Node) -> list[Node]:
    """Subtrees that hold the main text, in page order.

    An ``article`` or ``main`` around the node of greatest sum is the main text, with other articles at or above
    the threshold. Without one it is that node's subtree and, beside the path to it, headings and blocks
    at or above the threshold.
    """
    order = weigh(body)
    best = max(reversed(order), key=lambda n: n.total)  # ties: the outermost and first in page order
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    whole = next((n for tag in ("article", "main") for n in path if n.tag == tag), None)
    if whole is not None:
        others = [n for n in order if n.tag == "article" and n.density >= threshold and whole.tag == "article"]
        kept = {id(whole), *map(id, others)}
    else:
        on_path = set(map(id, path))
        beside = [c for n in path[1:] for c in n.children if isinstance(c, Node) and id(c) not in on_path]
        kept = {id(best), *(id(c) for c in beside if c.tag in HEADINGS or (c.tag in BLOCKS and c.density >= threshold))}
    taken, stack = [], [body]
    while stack:
        node = stack.pop()
        if id(node) in kept:
            taken.append(node)
        else:
            stack += reversed([c for c in node.children if isinstance(c, Node)])
    return taken


def blocks(node: Node) -> list[str]:
    """Texts of the blocks under a node in page order: white space is one space, empty ones are left out."""
    out, held = [], []

    def flush():
        text = _SPACE.sub(" ", "".join(held)).strip()
        if text:
            out.append(text)
        held.clear()

    stack: list = [node]
    while stack:
        top = stack.pop()
        if top is None:
            flush()
        elif isinstance(top, str):
            held.append(top)
        elif top.tag in ("br", "wbr", "img"):
            held.append(" " if top.tag == "br" else "")
        else:
            block = top.tag in BLOCKS
            if block:
                flush()
                stack.append(None)
            stack += reversed(top.children)
    flush()
    return out


def main_text(page: str) -> str:
    """The page's main text; empty for an empty page or one without content."""
    if "<" not in page:
        return _SPACE.sub(" ", html.unescape(page)).strip()
    return " ".join(b for node in select(parse(page)) for b in blocks(node))


def extract(df: DataFrame, keep: list[str], column: str = "html") -> DataFrame:
    """``keep`` columns of every row, the main text of its page and its length in code points.

    Null and empty pages have an empty text; pages are read whole; repeated rows are treated alike; an empty
    table gives an empty one; other columns are not read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for (pages,) in chunks([batch.select([0])], 0) for p in pages]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(F.col(column), *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, f"{kinds}, text string, n_chars long")
