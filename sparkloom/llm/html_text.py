"""Operator 2: main text of web pages by composite text density.

A page becomes a tree (implied end tags, void and raw-text elements, unclosed and stray tags as browsers take them), in time linear
in its length but for a logarithm. Elements that can't be part of an article are pruned: menus, headers, footers, sidebars, scripts,
styles. Forms, and elements whose class, id or role names an advert, a notice, reader comments and the like, are pruned unless the page
has next to no other text: from the one of most text down, a form or an element with such a word somewhere in its names stays where
it has more text than all that is not in doubt, one whose whole name says it where it has `SURE` times that. (A page may lie within one
form, or its wrapper be called `has-sidebar`.) For every node that is left (inline
formatting counts with its block), composite text density is its characters per tag, adjusted for the characters and tags of links. Child densities are summed; the node of the largest sum lies in
the main text, and the smallest density on the path from the body to it is the threshold. From the body down, each node that
reaches the threshold marks the node of the largest sum below it, and all text of marked nodes is the result, in page order.

Character references are decoded once, white space within a block becomes one space, blocks are joined by one space. Null, empty
and text-free html gives an empty text. Plain text without tags is one block. Rows that repeat an id get a row each. An empty table
gives an empty result. Other columns are ignored. Very deep pages are handled without recursion.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile(r"[>=]")
_VALUE = re.compile(r"\s*([\"'])")
_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|itemprop|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
_PRUNED = frozenset("head script style noscript template iframe object embed svg canvas math nav header footer aside button select textarea input label fieldset dialog menu audio video map title noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that format a part of a block: they are no nodes of their own for densities.
_THROUGH = _INLINE | {"br", "hr", "img"}
_CLOSES_P = frozenset("address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li".split())
_IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}}
_P_SCOPE = frozenset("article aside body button caption div html main nav object section table td th footer header ul ol li blockquote form figure".split())
_NAMED = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion banner banners "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager header masthead topbar footer bottombar sidebar sidebars aside rail "
    "comment comments commentlist discussion disqus respond reply replies cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay "
    "newsletter subscribe subscription signup login share sharing social socials related recommended recommendations widget widgets toolbar skip copyright "
    "complementary contentinfo search form dialog disclaimer".split()
)
#: Words that may stand beside those of _NAMED in a name that is sure.
_NEUTRAL = frozenset("site main page list box area section container wrap wrapper block inner outer global top left right post entry article content primary secondary bar unit slot item items link links div text module region group form".split())
_NOT = frozenset("no has with without is not hide show".split())
SURE = 25
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


class _Node:
    __slots__ = ("tag", "parent", "children", "pruned", "doubt", "own", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: _Node | None, pruned: bool, doubt: int = 0):
        self.tag, self.parent, self.pruned, self.doubt = tag, parent, pruned, doubt
        self.children: list[_Node | str] = []


def _doubt(attributes: str) -> int:
    """Whether class, id or role say that this is no part of an article: 3 hidden, 2 a whole name says so, 1 a part of one, 0 none."""
    worst = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            return 3
        if name in ("class", "id", "role"):
            for token in value.split():
                parts = [x for x in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if x]
                if parts and not _NAMED.isdisjoint(parts) and parts[0] not in _NOT:
                    worst = max(worst, 2 if all(x in _NAMED or x in _NEUTRAL or x.isdigit() for x in parts) else 1)
    return worst


class _Stack:
    """The open elements, with the places of each tag's, so that no step walks over all of them."""

    def __init__(self, root: _Node):
        self.nodes, self.of = [root], {}
        self.blocks, self.p_scopes = [0], [0]

    def push(self, node: _Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.of.setdefault(node.tag, []).append(at)
        if node.tag not in _INLINE:
            self.blocks.append(at)
        if node.tag in _P_SCOPE:
            self.p_scopes.append(at)

    def pop_to(self, at: int) -> None:
        """Closes the element at this place and all within it."""
        while len(self.nodes) > at:
            self.of[self.nodes.pop().tag].pop()
        for places in (self.blocks, self.p_scopes):
            while places[-1] >= at:
                places.pop()

    def last(self, tag: str) -> int:
        own = self.of.get(tag)
        return own[-1] if own else 0

    def first_after(self, tags: set[str], place: int) -> int:
        """The first open element of these tags behind a place, 0 if there is none."""
        found = 0
        for t in tags:
            own = self.of.get(t)
            if own and own[-1] > place:
                at = own[bisect_right(own, place)]
                found = at if not found else min(found, at)
        return found


def _tag_end(source: str, at: int, last_quote: dict[str, int]) -> int:
    """The place of the > that ends a tag whose name ends at `at`, or -1."""
    while True:
        m = _STOP.search(source, at)
        if m is None:
            return -1
        if m[0] == ">":
            return m.start()
        at = m.end()
        v = _VALUE.match(source, at)
        if v and v.end() <= last_quote[v[1]]:
            at = source.index(v[1], v.end()) + 1


def parse(source: str) -> _Node:
    """The body's tree (a node of its own where there is none)."""
    root = _Node("body", None, False)
    stack, at, n = _Stack(root), 0, len(source)
    last_quote, last_end = {q: source.rfind(q) for q in "\"'"}, source.rfind(">")
    while at < n:
        m = _OPEN.search(source, at, last_end + 1)
        here = stack.nodes[-1]
        if m is None:
            here.children.append(source[at:])
            break
        if m[4] is None:
            ends = {"!--": "-->", "![CDATA[": "]]>"}.get(m[1] or m[2], ">")
            end = source.find(ends, m.end())
            if m.start() > at:
                here.children.append(source[at : m.start()])
            at = n if end < 0 else end + len(ends)
            continue
        end = _tag_end(source, m.end(), last_quote)
        if end < 0:  # no tag: its < is text
            here.children.append(source[at : m.end()])
            at = m.end()
            continue
        if m.start() > at:
            here.children.append(source[at : m.start()])
        attributes, at, tag = source[m.end() : end], end + 1, m[4].lower()
        if tag in ("html", "body"):
            continue
        if m[3]:
            open_at = stack.last(tag)
            if open_at and (tag not in _INLINE or open_at > stack.blocks[-1]):
                stack.pop_to(open_at)
            elif tag == "p":
                here.children.append(_Node("p", here, False))
            continue
        if tag in _CLOSES_P and stack.last("p") > stack.p_scopes[-1]:
            stack.pop_to(stack.last("p"))
        if tag in _IMPLIED:
            open_at = stack.first_after(_IMPLIED[tag], max(stack.last(t) for t in _SCOPE[tag]))
            if open_at:
                stack.pop_to(open_at)
        here = stack.nodes[-1]
        doubt = 0 if tag in ("main", "article", "br") or not attributes else _doubt(attributes)
        node = _Node(tag, here, tag in _PRUNED or doubt == 3, max(doubt, tag == "form"))
        here.children.append(node)
        if tag in _RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(source, at)
            if tag not in _PRUNED:
                node.children.append(source[at : close.start() if close else n])
            at = close.end() if close else n
        elif tag not in _VOID and (not attributes.rstrip().endswith("/") or (not node.pruned and tag != "svg")):
            stack.push(node)
    return root


def _settle(root: _Node) -> None:
    """Prunes the elements in doubt but those that hold the page's text."""
    nodes = _order(root)
    sure = 0
    for node in reversed(nodes):
        node.own = 0  # characters that are in no doubt within this element
        for c in node.children:
            if isinstance(c, str):
                node.own += len(_SPACE.sub(" ", c).strip())
            elif not c.pruned and not c.doubt:
                node.own += c.own
    sure = root.own

    def doubtful(within: _Node) -> Iterator[_Node]:
        stack = [within]
        while stack:
            for c in stack.pop().children:
                if not isinstance(c, str) and not c.pruned:
                    if c.doubt:
                        yield c
                    else:
                        stack.append(c)

    heap = [(-x.own, k, x) for k, x in enumerate(doubtful(root))]
    heapq.heapify(heap)
    k = len(heap)
    while heap:
        _, _, node = heapq.heappop(heap)
        # an element that only wraps others in doubt is judged by the largest of them
        inner = list(doubtful(node))
        held = max([node.own, *(x.own for x in inner)]) if node.doubt == 1 else node.own
        if held > sure * (SURE if node.doubt == 2 else 1):
            sure += node.own
            for x in inner:
                k += 1
                heapq.heappush(heap, (-x.own, k, x))
        else:
            node.pruned = True


def _order(root: _Node) -> list[_Node]:
    """All nodes that aren't pruned, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if not isinstance(c, str) and not c.pruned]
    return out


def main_text(source: str | None) -> str:
    if not source or not source.strip():
        return ""
    root = parse(source)
    _settle(root)
    nodes = _order(root)
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(_SPACE.sub(" ", c).strip())
            elif not c.pruned:
                node.chars += c.chars
                node.tags += c.tags + (c.tag not in _THROUGH)
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    if not root.chars:
        return ""
    ratio = max(root.link_chars, 1) / root.chars
    for node in nodes:
        c, t = node.chars, max(node.tags, 1)
        lc, lt = max(node.link_chars, 1), max(node.link_tags, 1)
        plain = max(c - node.link_chars, 1)
        node.density = c / t * math.log(max(c / lc * t / lt, 1.0000001), math.log(c / plain * lc + ratio * c + math.e)) if c else 0.0
    for node in reversed(nodes):
        own = [c for c in node.children if not isinstance(c, str) and not c.pruned]
        node.total = sum(c.total if c.tag in _THROUGH else c.density for c in own)
        if not node.total and node.tag not in _THROUGH:
            node.total = node.density
    best = max((x for x in nodes if x.tag not in _THROUGH), key=lambda x: x.total)  # the first of equals
    path, up = [], best
    while up is not None:
        if up.tag not in _THROUGH:
            path.append(up.density)
        up = up.parent
    least = min(path)
    top: dict[int, _Node | None] = {}  # the node of the largest sum in a node's subtree
    for node in reversed(nodes):
        own = None if node.tag in _THROUGH else node
        for c in node.children:
            if not isinstance(c, str) and not c.pruned:
                other = top[id(c)]
                if other is not None and (own is None or other.total > own.total):
                    own = other
        top[id(node)] = own
    marked, stack = set(), [root]
    while stack:
        node = stack.pop()
        through = node.tag in _THROUGH
        if through or (node.density >= least and node.chars):
            if not through:
                marked.add(id(top[id(node)]))
            stack += [c for c in node.children if not isinstance(c, str) and not c.pruned]
    return _text(root, marked)


def _text(root: _Node, marked: set[int]) -> str:
    blocks, block = [], []

    def flush():
        if block:
            # as in a page: runs of white space, those of different inline elements too, are one space
            text = _SPACE.sub(" ", html.unescape("".join(block))).strip()
            if text:
                blocks.append(text)
            block.clear()

    stack: list[tuple[_Node | str | None, bool]] = [(root, False)]
    while stack:
        node, inside = stack.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            if inside:
                block.append(node)
        elif not node.pruned:
            inside = inside or id(node) in marked
            if node.tag not in _INLINE:
                flush()
                stack.append((None, False))
            stack += [(c, inside) for c in reversed(node.children)]
    flush()
    return " ".join(blocks)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text, n_chars."""
    schema = f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, `{url_col}` {pages.schema[url_col].dataType.simpleString()}, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema)


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
