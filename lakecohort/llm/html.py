"""Main text of web pages by tree scoring.

A page becomes a tree. Elements that are no article by their tag, role or class are set aside. Each paragraph gives points
for its length and commas to its parent, half to the next ancestor, less to those above; an element's points are discounted
by its link density. The best container is kept, with those of its siblings that read like text, and inside it lists of
links go.

The text: character references decoded, white space within a block turned into one space, blocks trimmed and joined in
page order by one space.

Defined results: a null or empty page, or one without text, has the empty text and 0 characters; rows with one page_id
are separate pages; a page without any paragraph gives its other text that isn't set aside.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*'|["'])*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content isn't markup.
RAW = frozenset("script style textarea title xmp noframes".split())
CLOSING = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never part of an article.
OUT = frozenset(
    "script style noscript template iframe object embed svg canvas head title nav footer aside form button select option textarea input label dialog menu audio video map xmp noframes".split()
)
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar form toolbar".split())
#: What parts of class names and ids say that an element is no article.
WORDS = frozenset(
    "ad ads advert advertisement advertising adverts adbox adsense banner breadcrumb breadcrumbs byline consent cookie cookies copyright disclaimer disqus footer gdpr header hidden login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promotion promoted recommended related share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription tags teaser toc toolbar tracking widget widgets warning alert".split()
)
CONTENT, HEADS = frozenset("article entry post story content".split()), frozenset("header masthead".split())
READERS = frozenset("comment comments commentlist reply replies respond discussion disqus".split())
#: A start tag ends an open element of these kinds, unless one of the others lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
PARAGRAPH = frozenset(["p", "pre", "td", "blockquote", "li", "dd"])
SCOPE = frozenset(["table", "td", "th", "button", "object", "html", "body"])
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "out", "readers", "points", "length", "linked")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.children: list[Node | str] = []
        self.out = self.readers = False
        self.points = 0.0
        self.length = self.linked = 0


def _set_aside(node: Node, attributes: str) -> None:
    """Judge an element by its attributes: out, if no article; readers, if what readers wrote."""
    if not attributes.strip():
        return
    names: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            names.update(x.lower() for x in PART.findall(value))
        elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            node.out = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            node.out = True
    if node.tag not in ("html", "body", "article", "main") or names & READERS:
        node.readers = bool(names & READERS)
        if names & CONTENT:
            names -= HEADS  # the head of an article, not of the page
        node.out |= node.readers or bool(names & WORDS)


def parse(html: str) -> Node:
    """A tree of elements and texts; start tags end what can't hold them, end tags without an open element are skipped."""
    root = Node("html", None)
    at, here = 0, root
    opened: dict[str, int] = {}  # open elements by tag, so that no search climbs in vain
    search, length = TOKEN.search, len(html)

    def leave(upto: Node) -> None:
        """Close the open elements below upto."""
        nonlocal here
        while here is not upto:
            opened[here.tag] -= 1
            here = here.parent

    def nearest(kinds, stops) -> Node | None:
        """The outermost open element of these kinds below the nearest stop."""
        if not any(opened.get(k) for k in kinds):
            return None
        node, last = here, None
        while node is not root and node.tag not in stops:
            if node.tag in kinds:
                last = node
            node = node.parent
        return last

    while at < length:
        m = search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            here.children.append(unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if opened.get(tag):
                node = here
                while node.tag != tag:
                    node = node.parent
                leave(node.parent)
            continue
        if tag == "html":
            continue
        if tag in BLOCK and (p := nearest(("p",), SCOPE)) is not None:
            leave(p.parent)  # a block ends an open paragraph
        if tag in ENDS and (last := nearest(*ENDS[tag])) is not None:
            leave(last.parent)
        node = Node(tag, here)
        here.children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = CLOSING[tag].search(html, at)
            at = end.end() if end else length
            node.out = True
            continue
        node.out = tag in OUT
        _set_aside(node, m[3])
        if not m[3].endswith("/") or tag in BLOCK or tag in ("a", "b", "i", "span"):
            here = node
            opened[tag] = opened.get(tag, 0) + 1
    return root


def measure(root: Node) -> list[Node]:
    """Set lengths of text and of linked text; all elements, children before parents."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if not isinstance(c, str))
    order.reverse()
    for node in order:
        size = linked = 0
        for c in node.children:
            if isinstance(c, str):
                size += len(c) - c.count(" ") if not c.isspace() else 0
            else:
                size += c.length
                linked += c.linked
        node.length, node.linked = size, size if node.tag == "a" else linked
    return order


def _joined(a: tuple[int, int, int, int], b: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    """(characters, blank ones at the start, blank ones at the end, commas) of two texts in a row."""
    return a[0] + b[0], a[1] + b[1] if a[1] == a[0] else a[1], b[2] + a[2] if b[2] == b[0] else b[2], a[3] + b[3]


def _extent(text: str) -> tuple[int, int, int, int]:
    n = len(text)
    return n, n - len(text.lstrip()), n - len(text.rstrip()), text.count(",")


def score(order: list[Node]) -> None:
    """Points of paragraphs, and of blocks that hold text themselves, go to their ancestors. Each text is looked at once."""
    extents: dict[Node, tuple[int, int, int, int]] = {}
    for node in order:
        if node.out:
            continue
        extent, longest = (0, 0, 0, 0), 0
        for c in node.children:
            if isinstance(c, str):
                own = _extent(c)
                longest = max(longest, own[0] - own[1] - own[2])
                extent = _joined(extent, own)
            elif not c.out:
                extent = _joined(extent, extents.pop(c))
        extents[node] = extent
        if not (node.tag in PARAGRAPH or node.tag in BLOCK and longest > 20) or node.tag in ("html", "body"):
            continue
        size = max(0, extent[0] - extent[1] - extent[2])
        if size < 2:
            continue
        points = (0.25 if size < 25 else 1.0) + extent[3] + min(size // 100, 3)
        if node.length:
            points *= 1 - node.linked / node.length
        above, level = node.parent, 0
        while above is not None and level < 5:
            above.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            above, level = above.parent, level + 1


def _keeps(node: Node, best: Node, least: float) -> bool:
    """Does a sibling of the best container belong to the text?"""
    if node.out or not node.length:
        return False
    density = node.linked / node.length
    if node.tag in HEADING:
        return density < 0.5
    if node.tag == best.tag and node.tag in ("article", "section") or node.points * (1 - density) >= least:
        return density < 0.5
    return node.tag in PARAGRAPH and (density < 0.25 if node.length > 65 else node.linked == 0)


def _write(node: Node, blocks: list[list[str]], title: bool = False) -> None:
    """Append an element's text; a new list begins each block. title: only headings count."""
    stack: list = [(node, title)]
    while stack:
        x, only = stack.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            if not only:
                blocks[-1].append(x)
        elif x.tag in ("br", "hr"):
            blocks[-1].append(" ")
        elif not x.out:
            if x.tag in ("ul", "ol", "table", "div", "section", "dl") and x is not node and x.length and x.linked > 0.5 * x.length:
                continue  # a list of links
            only = (only or x.tag == "header") and x.tag not in HEADING
            block = x.tag in BLOCK
            if block:
                blocks.append([])
                stack.append((None, only))
            stack.extend((c, only) for c in reversed(x.children))


def extract(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    root = parse(html)
    order = measure(root)
    total = root.length
    for node in order:
        # a class name that says no article on what holds most of the text means something else
        if node.out and not node.readers and node.tag not in OUT and node.length > 0.6 * total and node.linked < 0.3 * node.length:
            node.out = False
    for node in reversed(order):
        if node.parent is not None and node.parent.out:
            node.out = True
    score(order)
    fit = [n for n in order if not n.out and n.tag not in ("header", "p", "ul", "ol", "tr", "tbody", "thead") and n.tag in BLOCK and n.length]
    worth = lambda n: n.points * (1 - n.linked / n.length) * (1.25 if n.tag in ("article", "main") else 1)
    best = max(fit, key=worth, default=root)
    if not best.points:
        best = next((n for n in reversed(order) if n.tag in ("article", "main") and not n.out and n.length), next((n for n in order if n.tag == "body"), root))
    blocks: list[list[str]] = [[]]
    if best.parent is None or best.tag in ("html", "body"):
        _write(best, blocks)
    else:
        least = max(3.0, 0.2 * worth(best)) if best.points else float("inf")
        for x in best.parent.children:
            if x is best or not isinstance(x, str) and _keeps(x, best, least):
                _write(x, blocks)
                blocks.append([])
    return " ".join(t for t in (" ".join("".join(b).split()) for b in blocks) if t)


def main_text(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but html, if None) with text and n_chars, which replace columns of these names."""
    keep = [c for c in (pages.columns if keep is None else keep) if c not in (html, "text", "n_chars")]
    source = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(html).alias("__html"))
    schema = pages.select(*[F.col(f"`{c}`") for c in keep], F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches):
        for b in batches:
            texts = [extract(x.as_py()) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema.fieldNames())

    return common.positional(source).mapInArrow(run, schema)


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    return main_text(common.read(common.tuned(spark), sf_dir, "pages"), keep=["page_id", "url"])
