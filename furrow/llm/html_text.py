"""Main text of web pages by composite text density (operator 4).

Every element gets its characters C, tags T, linked characters LC and linked
tags LT.  Its density is C / T weighed down by the share of links,

    C/T * log(C/LC * T/LT) to the base ln(C/(C - LC) * LC + LC_b/C_b * C + e)

with LC_b and C_b of the body.  Blocks are the nodes that compete: the density sum
of a block adds up the densities of the blocks right below it, where elements
inside a line only count as tags.  The densest block marks a path to the body; the
least density on that path is the threshold.  Of the blocks that reach it, the one
with the largest density sum is the main subtree.

Elements that are never article text (scripts, menus, forms, sidebars, adverts,
notices, reader comments, ...) are left out before counting, by element, role
and the words of class and id.  Such a word may also stand on a wrapper of the
whole page (has-sidebar, header-and-content), so an element named by one alone
stays if it holds the page's article, or most of the text around it while
little lies outside all named elements; its densities then decide.

The text of the subtree is taken whole: character references decoded, white
space of a block turned into one space, blocks joined by one space in page
order.  Elements inside a line don't break words.

Pages are dealt by Spark; each is parsed alone, in one pass of a tolerant
scanner that closes elements the way browsers do for paragraphs, list items and
cells.  The time grows with the length of the page, however deep it nests.

Defined cases: null or empty html and pages without text give an empty text;
unclosed and crossing elements end with their parent; an unclosed comment or
script takes the rest; text outside any block counts; repeated rows are
extracted alike; an empty table gives an empty result; further columns are not
looked at.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main "
    "menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
LEFT_OUT = frozenset(
    "script style noscript template head title nav aside footer form button select textarea input "
    "option iframe object embed svg canvas audio video map dialog menu noembed noframes".split())
LEFT_OUT_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog menu menubar "
    "toolbar alert".split())
# words of class and id that name what surrounds an article
LEFT_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense banner breadcrumb breadcrumbs "
    "comment comments commentlist comentarios disqus consent cookie cookies cookiebar copyright "
    "disclaimer footer gdpr header masthead menu menubar modal nav navbar navigation newsletter "
    "notice notices notification overlay pager pagination popup promo promoted promotion recommended "
    "related reply replies respond share sharing sidebar sidebars signup skip social sponsor "
    "sponsored sponsors subscribe subscription teaser toolbar topbar widget widgets".split())
CLOSED_BY = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")),
    "th": frozenset(("td", "th")), "option": frozenset(("option",)),
}
SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",),
         "td": ("table",), "th": ("table",), "option": ("select",)}
PARAGRAPH_SCOPE = ("td", "th", "button", "caption", "table")
ENDS_PARAGRAPH = BLOCK - frozenset("br button caption td th tr tbody thead tfoot option html body head title".split())

_MARK = re.compile(
    r"<!--|<!\[CDATA\[|<[!?]|</([A-Za-z][^\s/>]*)[^>]*>?|<([A-Za-z][^\s/>]*)"
    r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?")
# every attribute is read with its value, so that words in other values name nothing
_ATTRIBUTE = re.compile(r"([^\s\"'=/>][^\s\"'=/>]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """Element with its pieces of text and child elements in page order."""

    __slots__ = ("tag", "parent", "parts", "left_out", "named", "chars", "tags", "link_chars", "link_tags",
                 "density", "total")

    def __init__(self, tag: str, parent: Node | None, left_out: bool) -> None:
        self.tag, self.parent, self.left_out = tag, parent, left_out
        self.named = False
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _is_left_out(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in LEFT_OUT or tag == "header" and not in_article:
        # a page's header goes, an article's own holds its title
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in LEFT_OUT_ROLES:
            return True
        if name == "style" and _HIDDEN.search(value):
            return True
    return False


def _is_named(tag: str, attributes: str) -> bool:
    """Whether class or id has a word for what surrounds an article."""
    return bool(attributes) and tag not in ("html", "body", "article", "main") and any(
        name.lower() in ("class", "id") and any(w.lower() in LEFT_OUT_WORDS for w in _WORD.findall(value))
        for name, value in _ATTRIBUTE.findall(attributes))


def _leave_out_named(root: Node) -> None:
    """Leaves out the named elements that neither hold the article nor most of the text."""
    order, linked = [root], [False]
    for node, inside in zip(order, linked):  # grows while it runs
        for part in node.parts:
            if not isinstance(part, str) and not part.left_out:
                order.append(part)
                linked.append(inside or part.tag == "a")
    if not any(node.named for node in order):
        return
    # characters outside links: all, those in no named element, those of the largest article
    free, plain, article = {}, {}, {}
    for node, inside in zip(reversed(order), reversed(linked)):
        own = 0 if inside else sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        below = [p for p in node.parts if not isinstance(p, str) and not p.left_out]
        free[node] = own + sum(free[p] for p in below)
        plain[node] = own + sum(plain[p] for p in below if not p.named)
        article[node] = free[node] if node.tag in ("article", "main") else max(
            (article[p] for p in below), default=0)
    around = {root: root}
    for node in order[1:]:
        if node.parent not in around:
            continue
        outer = around[node.parent]
        if not node.named:
            around[node] = outer
        elif 2 * article[node] >= max(article[root], plain[outer], 1) or (
                free[node] and 2 * free[node] >= free[outer] and 5 * plain[outer] <= free[node]):
            around[node] = node
        else:
            node.left_out = True


class _Open:
    """The elements that are open while a page is scanned, by tag; every step is constant but for what it closes."""

    def __init__(self) -> None:
        self.root = self.node = Node("html", None, False)
        self.depth = 0
        self.by_tag: dict[str, list[tuple[int, Node]]] = {"html": [(0, self.root)]}
        self.blocks = [0]  # depths of open blocks

    def nearest(self, tags) -> int:
        """Depth of the innermost open element with one of the tags, or -1."""
        return max((self.by_tag[t][-1][0] for t in tags if self.by_tag.get(t)), default=-1)

    def close_to(self, depth: int) -> None:
        """Closes the element at ``depth`` and all inside it; the root stays."""
        while self.depth >= max(depth, 1):
            self.by_tag[self.node.tag].pop()
            if self.node.tag in BLOCK:
                self.blocks.pop()
            self.node, self.depth = self.node.parent, self.depth - 1

    def end(self, tag: str) -> None:
        depth = self.nearest((tag,))
        # an end tag of a line element doesn't reach out of its block
        if depth < 0 or tag not in BLOCK and self.blocks[-1] > depth:
            if tag == "br":
                self.node.parts.append(Node("br", self.node, False))
            return
        self.close_to(depth)

    def start(self, tag: str, attributes: str) -> None:
        if tag == "html" and self.depth == 0:
            return
        for ends, within in ([(("p",), PARAGRAPH_SCOPE)] if tag in ENDS_PARAGRAPH else []) + (
                [(CLOSED_BY[tag], SCOPE[tag])] if tag in CLOSED_BY else []):
            depth = self.nearest(ends)
            if depth > self.nearest(within):
                self.close_to(depth)
        child = Node(tag, self.node, _is_left_out(tag, attributes, self.nearest(("article", "main")) >= 0))
        child.named = not child.left_out and _is_named(tag, attributes)
        self.node.parts.append(child)
        if tag not in VOID:
            self.node, self.depth = child, self.depth + 1
            self.by_tag.setdefault(tag, []).append((self.depth, child))
            if tag in BLOCK:
                self.blocks.append(self.depth)


def parse(page: str) -> Node:
    """Tree of the page; elements that are left out keep their place but no content."""
    scan = _Open()
    at, size = 0, len(page)
    while at < size:
        found = _MARK.search(page, at)
        if found is None:
            scan.node.parts.append(page[at:])
            break
        if found.start() > at:
            scan.node.parts.append(page[at:found.start()])
        at = found.end()
        mark = found[0]
        if mark == "<!--" or mark == "<![CDATA[":
            end = page.find("-->" if mark == "<!--" else "]]>", at)
            if mark == "<![CDATA[":
                scan.node.parts.append(html.escape(page[at:end if end >= 0 else size], quote=False))
            at = end + 3 if end >= 0 else size
        elif mark in ("<!", "<?"):
            end = page.find(">", at)
            at = end + 1 if end >= 0 else size
        elif found[1] is not None:
            scan.end(found[1].lower())
        else:
            tag, attributes = found[2].lower(), found[3]
            scan.start(tag, attributes)
            if tag in RAW and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\b", re.I).search(page, at)
                scan.node.parts.append(page[at:end.start() if end else size])
                at = end.start() if end else size
    _leave_out_named(scan.root)
    return scan.root


def _measure(root: Node) -> list[Node]:
    """Counts of every element that is not left out, children before parents."""
    order: list[Node] = []
    stack = [(root, False)]
    while stack:
        node, linked = stack.pop()
        linked = linked or node.tag == "a"
        order.append(node)
        for part in node.parts:
            if isinstance(part, str):
                chars = len("".join(part.split()))
                node.chars += chars
                node.link_chars += chars if linked else 0
            elif not part.left_out:
                stack.append((part, linked))
    order.reverse()
    for node in order:
        for part in node.parts:
            if not isinstance(part, str) and not part.left_out:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags + (part.tag == "a")
    return order


def _density(node: Node, body: Node) -> float:
    if not node.chars:
        return 0.0
    chars, tags = node.chars, max(node.tags, 1)
    links, link_tags = max(node.link_chars, 1), max(node.link_tags, 1)
    rest = max(chars - node.link_chars, 1)
    base = math.log(chars / rest * node.link_chars + body.link_chars / max(body.chars, 1) * chars
                    + math.e)
    inside = max(chars / links * tags / link_tags, 1.0)
    return chars / tags * math.log(inside) / max(math.log(base), 1e-9) if base > 1.0 + 1e-9 else (
        chars / tags * math.log(inside + 1))


def main_subtree(root: Node) -> Node:
    """The block with the largest sum of densities among those that reach the threshold."""
    order = _measure(root)
    body = next((n for n in order if n.tag == "body"), root)
    below = {id(body)}
    for node in reversed(order):  # parents before children
        if node.parent is not None and id(node.parent) in below:
            below.add(id(node))
    for node in order:
        node.density = _density(node, body)
        # an element inside a line hands on what it holds
        node.total = sum(p.density if p.tag in BLOCK else p.total
                         for p in node.parts if not isinstance(p, str) and not p.left_out)
    blocks = [n for n in order if id(n) in below and (n is body or n.tag in BLOCK)]
    if not blocks:
        return body
    above = max(blocks, key=lambda n: n.density)
    threshold = above.density
    while above is not body and above.parent is not None:
        above = above.parent
        if above is body or above.tag in BLOCK:
            threshold = min(threshold, above.density)
    return max((n for n in blocks if n.density >= threshold), key=lambda n: n.total)


def text_of(node: Node) -> str:
    """Text of the subtree; blocks, like any white space, part words by one space."""
    pieces: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            pieces.append(part)
        elif part.left_out:
            if part.tag in BLOCK:
                pieces.append(" ")
        else:
            if part.tag in BLOCK:
                pieces.append(" ")
                stack.append(" ")
            stack.extend(reversed(part.parts))
    return " ".join(html.unescape("".join(pieces)).split())


def extract(page: str | None) -> str:
    """Main text of one page."""
    return text_of(main_subtree(parse(page))) if page else ""


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; takes page_id, url and html."""
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            texts = [extract(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
