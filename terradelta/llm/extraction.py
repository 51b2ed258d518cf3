"""HTML extraction by tree scoring: paragraphs pass points to their ancestors, discounted by link density."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from terradelta.llm.tables import slices, utf8

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",  # with a quote that never ends
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
#: Elements that never hold article text.
DROPPED = RAW | frozenset("nav footer aside form button select option svg canvas object audio video menu dialog head fieldset".split())
#: Elements whose start or end parts blocks of text.
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption"
    " blockquote pre figure figcaption address hgroup header center details summary hr".split()
) | DROPPED
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element that starts ends an open one of these, up to the nearest element that may hold it.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words in class, id or role of what isn't the article.
AWAY = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside rail nav navbar navigation"
    " menu menubar breadcrumb breadcrumbs footer foot header masthead topbar comment comments disqus reply replies respond discussion"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing"
    " social related recommended recommendations widget pagination pager toolbar skip copyright legal disclaimer search form"
    " contentinfo complementary dialog hidden".split()
)
#: Words that say what kind of box a label names. Inside an article a label is that of a box beside the text only if it
#: has no other words: "comment-list" and "share-buttons-top" are, "legal-history" and "search-results-study" are not.
BOXES = frozenset(
    "area bar block body bottom box button buttons center column container content group header icon icons inner inline item items"
    " label large left link links list main message panel post posts right section slot small text title top unit widgets wrap wrapper"
    " 1 2 3 4 5".split()
)
KEPT = frozenset("html body main article".split())
DEPTH = 512  # of elements; deeper ones are laid flat, as browsers do
LINKS = 0.5  # part of the text of a sibling of the main box in links from which it is left out
MENU = 0.8  # part of a list's or box's text in links from which it is a menu


@dataclass
class Node:
    tag: str
    parent: int
    away: bool
    points: float = 0.0
    chars: int = 0
    link_chars: int = 0


@dataclass
class Block:
    node: int
    text: str
    heading: bool
    chars: int
    link_chars: int


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=lambda: [Node("#root", -1, False)])
    blocks: list[Block] = field(default_factory=list)


def _away(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not inside_article):
        return True
    if not attributes.strip() or tag in KEPT and tag != "article":
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id", "role"):
            for label in value.split():
                parts = re.split(r"[-_:]+", label)
                named = parts[0] not in ("no", "has", "with") and not AWAY.isdisjoint(parts)
                if named and (not inside_article or all(p in AWAY or p in BOXES or not p for p in parts)):
                    return True
    return False


def parse(page: str) -> Tree:
    """The elements and blocks of a page; broken markup is mended as far as it concerns blocks.

    Work is linear in the page times the depth of its elements, of which at most DEPTH are told apart.
    """
    tree = Tree()
    nodes = tree.nodes
    stack = [0]  # open elements
    text: list[str] = []
    deeper: list[bool] = []  # open blocks below DEPTH, which count as part of the one above: is it away?
    linked = [0, 0]  # links that are open, characters of links in the block
    at, end = 0, len(page)

    def add(piece: str) -> None:
        piece = html.unescape(piece)
        text.append(piece)
        if linked[0]:
            linked[1] += len("".join(piece.split()))

    def flush() -> None:
        if not text:
            return
        words = "".join(text).split()
        text.clear()
        links, linked[1] = linked[1], 0
        top = nodes[stack[-1]]
        if words and not top.away and not any(deeper):
            tree.blocks.append(Block(stack[-1], " ".join(words), top.tag in HEADINGS, sum(map(len, words)), links))

    def close_to(depth: int) -> None:
        for node in stack[depth:]:
            if nodes[node].tag == "a":
                linked[0] -= 1
        if any(nodes[n].tag in BLOCK for n in stack[depth:]):
            flush()
        del stack[depth:]

    while at < end:
        m = _MARKUP.search(page, at)
        add(page[at : m.start() if m else end]) if (m.start() if m else end) > at else None
        if not m:
            break
        at = m.end()
        tag, rest = (m["tag"] or m["tag2"] or "").lower(), m["rest"] or m["rest2"] or ""
        if not tag:
            continue
        if m["close"] or m["close2"]:
            if deeper and tag in BLOCK:
                flush()
                deeper.pop()
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag == tag:
                    close_to(depth)
                    break
            else:
                if tag in BLOCK:
                    flush()
                if tag == "br":
                    text.append(" ")
            continue
        if tag in ("br", "wbr", "img"):
            text.append(" " if tag == "br" else "")
            continue
        if tag in BLOCK:
            for depth in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if nodes[stack[depth]].tag == "p":
                    close_to(depth)
                    break
                if nodes[stack[depth]].tag in BLOCK and nodes[stack[depth]].tag not in HEADINGS:
                    break
            flush()
        if tag in IMPLIED:
            ended, holders = IMPLIED[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag in holders:
                    break
                if nodes[stack[depth]].tag in ended:
                    close_to(depth)
        if tag in VOID:
            continue
        parent = nodes[stack[-1]]
        in_article = any(nodes[n].tag in ("article", "main") for n in stack)
        away = parent.away or _away(tag, rest, in_article)
        if tag in RAW:  # its content is no markup
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
            continue
        if len(stack) > DEPTH:
            if tag in BLOCK:
                deeper.append(away)
        elif tag in BLOCK or tag == "a" or away != parent.away:
            nodes.append(Node(tag, stack[-1], away))
            stack.append(len(nodes) - 1)
            linked[0] += tag == "a"
    close_to(1)
    flush()
    return tree


def _container(nodes: list[Node], node: int) -> int:
    """The element that holds a block's paragraph."""
    while nodes[node].tag in ("p", "a", "pre", "li", "td", "th", "tr", "dd", "dt", "tbody", "thead") or nodes[node].tag in HEADINGS:
        node = nodes[node].parent
    return max(node, 0)


def score(tree: Tree) -> None:
    """Give every element its characters and the points of the paragraphs below it.

    A block of text earns 1, 1 for each comma and up to 3 for its length; its container gets all of that,
    the next ancestor half, those above a third, a quarter and so on.
    """
    nodes = tree.nodes
    for block in tree.blocks:
        points = 1 + block.text.count(",") + min(block.chars / 100, 3.0)
        up, share = _container(nodes, block.node), 1
        while up >= 0:
            if not block.heading:
                nodes[up].points += points / share
            up, share = nodes[up].parent, share + 1
        up = block.node
        while up >= 0:
            nodes[up].chars += block.chars
            nodes[up].link_chars += block.link_chars
            up = nodes[up].parent


def _density(x: Node | Block) -> float:
    return x.link_chars / x.chars if x.chars else 0.0


def _above(nodes: list[Node], node: int) -> list[int]:
    path = [node]
    while nodes[path[-1]].parent >= 0:
        path.append(nodes[path[-1]].parent)
    return path


def main_text(page: str) -> str:
    """The article of a page: its blocks in page order, joined by an empty line.

    The container with the most points, less its share of links, is found; if it lies in an ``article`` or
    ``main`` element that element is kept whole, its header and lists of links included. Else the container is
    kept, and with it all its siblings, long or short, that are not mostly links, but for menus (lists and boxes
    that are links almost alone) in them.
    """
    tree = parse(page)
    nodes, blocks = tree.nodes, tree.blocks
    if not blocks:
        return ""
    score(tree)
    holders = {n for b in blocks for n in _above(nodes, _container(nodes, b.node))}
    worth = {n: nodes[n].points * (1 - _density(nodes[n])) for n in holders}
    best = max(sorted(holders), key=worth.__getitem__)
    whole = next((n for n in _above(nodes, best) if nodes[n].tag in ("article", "main")), None)
    kept = {best if whole is None else whole}
    top = nodes[best].parent
    if whole is None and top >= 0:
        kept |= {n for n in range(len(nodes)) if nodes[n].parent == top and not nodes[n].away and _density(nodes[n]) < LINKS}
    menus = {
        n
        for n in range(len(nodes))
        if whole is None and nodes[n].tag in ("ul", "ol", "div", "table", "section") and n not in kept and nodes[n].chars and _density(nodes[n]) >= MENU
    }
    out = []
    for block in blocks:
        path = _above(nodes, block.node)
        inside = next((i for i, n in enumerate(path) if n in kept), None)
        loose = whole is None and block.node == top and _density(block) < LINKS  # text beside the kept boxes, in none of them
        if loose or inside is not None and menus.isdisjoint(path[:inside]):
            out.append(block.text)
    return "\n\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url and text, the main text of the whole html.

    A null or empty html, or one without article text, gives an empty text. Broken and cut pages are read
    as far as they go. Repeated rows give repeated results; pages are parsed where they are read and
    nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 128):
            texts = [main_text(x.decode()) for x in utf8(part.column(2))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
