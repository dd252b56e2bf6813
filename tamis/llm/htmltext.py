"""Main text of a web page by tree scoring.

A light tree is built from the whole page (implied ends of p, li and the like; raw elements skipped whole, up to
the next block where their end is missing). Elements that can't be main text by tag, role, class, id or hiding
are left out; a form, or a class that may describe a layout (`sidebar-left`), only where it holds less than half
of the page's text. Each paragraph-like block passes points for its length and commas to all its ancestors,
half as many on each level up; a container's points are discounted by its link density. The best container is
taken with what lies beside it and its ancestors, up to the enclosing main, else to what is beside the enclosing
article, else the whole page: text, headings, lists, tables and sections that are not mostly links, and other
articles that score near it. All their blocks are kept in page order.

Null and empty pages give an empty text. A page whose blocks all score nothing falls back to its article,
main or body element. The tree is walked without recursion, in time proportional to its size.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, table

TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACES = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea iframe title xmp noembed noframes".split())
RAW_MARKUP = frozenset("noscript template svg math canvas object".split())  # skipped too, but ignored where their end is missing
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Tags that a start tag ends where they are open, up to the scope's edge.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
EDGE = frozenset("ul ol menu table dl select html body article section main aside nav div blockquote td th header footer form".split())
DROP_TAG = frozenset("nav footer aside label button select menu dialog head fieldset search input datalist audio video map".split())
DROP_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
DROP_WORD = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "comment comments commentlist respond replies reply disqus discussion sidebar aside footer foot header masthead nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination related recommended widget toolbar skip hidden".split()
)
#: Words that also describe the layout of a container; no drop words where FREE comes last.
LAYOUT_WORD = frozenset("ad ads banner alert popup modal overlay share sharing social sidebar aside footer foot header nav navbar navigation menu menubar widget toolbar".split())
FREE = frozenset("free less off none disabled".split())
WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HALF = 0.5  #: share of the page's text from which a form or layout is the page itself
NEXT_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK | {'head'}, reverse=True))})\b", re.I)
LINKS = 0.5  #: from this share of linked text on, what is beside the main text is navigation
BASE = {"article": 20, "main": 15, "div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "address": -3, "li": -3}


class Node:
    __slots__ = ("tag", "up", "level", "dropped", "doubtful", "main", "link", "score", "points", "chars", "linked", "titles", "titled", "kids")

    def __init__(self, tag: str, up: Node | None, dropped: bool, link: bool):
        self.tag, self.up, self.dropped, self.link = tag, up, dropped, link
        self.level = up.level + 1 if up else 0
        self.doubtful = self.main = False  # dropped unless it holds half of the text; holds a main element
        self.score = self.points = 0.0
        self.chars = self.linked = 0
        self.titles = self.titled = 0  # headings of the first two levels, and characters within their links
        self.kids: list[Node] = []


def drop_class(name: str) -> int:
    """2 where a class or id names something to leave out, 1 where it may as well describe a container, else 0."""
    words = [w.lower() for w in WORDS.findall(name)]
    if not words or words[0] in ("has", "with", "no", "without", "is", "not") or words[-1] in FREE:
        return 0
    found = [w for w in words if w in DROP_WORD]
    return 0 if not found else 1 if words[-1] not in DROP_WORD and LAYOUT_WORD.issuperset(found) else 2


def unwanted(tag: str, attributes: str, inside: Node) -> int:
    """2: to leave out; 1: unless it holds half of the text; 0: to keep."""
    if tag in DROP_TAG:
        return 2
    if tag == "header":
        at: Node | None = inside
        while at and at.tag not in ("article", "main"):
            at = at.up
        return 2 if at is None else 0
    worst = 1 if tag == "form" else 0
    if not attributes:
        return worst
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in DROP_ROLE or name == "style" and HIDDEN.search(value):
            return 2
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            worst = max(worst, *(drop_class(c) for c in value.split()), 0)
    return worst


def blocks_of(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """All elements, parents first, and the blocks as (block element, text, characters within links), dropped parts left out."""
    root = at = Node("html", None, False, False)
    nodes = [root]
    blocks: list[tuple[Node, str, int]] = []
    pieces: list[str] = []
    linked, pos, n = 0, 0, len(page)
    endless: set[str] = set()  # raw elements that have no end from here on
    home = root  # the block element that gathers text

    def close() -> None:
        nonlocal linked
        if pieces:
            text = SPACES.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                blocks.append((home, text, linked))
            pieces.clear()
        linked = 0

    while pos < n:
        m = TAG.search(page, pos)
        if not at.dropped and (end := m.start() if m else n) > pos:
            piece = page[pos:end]
            pieces.append(piece)
            if at.link:
                linked += len(piece)
        if not m:
            break
        pos = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            node: Node | None = at
            while node and node.tag != tag and not (node.tag in EDGE and tag not in BLOCK):
                node = node.up
            if node is None or node.tag != tag or node.up is None:
                if tag in BLOCK:
                    close()
                continue
            if tag in BLOCK:
                close()
            at = node.up
        else:
            if tag in RAW or tag in RAW_MARKUP:
                if m[3].rstrip().endswith("/") and tag not in ("script", "style", "textarea", "title"):
                    continue
                e = None if tag in endless else re.compile(rf"</{tag}(?:[\s/][^>]*)?(?:>|\Z)", re.I).search(page, pos)
                if e:
                    pos = e.end()
                else:
                    endless.add(tag)
                    if tag in RAW:
                        pos = e.start() if (e := NEXT_BLOCK.search(page, pos)) else n
                continue
            if at.tag == "head" and at.up:
                at = at.up  # nothing else belongs there
            if tag in VOID:
                if tag == "br" and not at.dropped:
                    pieces.append(" ")
                elif tag == "hr":
                    close()
                continue
            if tag in BLOCK:
                close()
                if tag in ("html", "body") and (tag == "html" or any(True for k in root.kids if k.tag == "body")):
                    continue
                node = at
                while node and node.tag != "p" and node.tag not in EDGE:
                    node = node.up
                if node and node.tag == "p" and node.up:
                    at = node.up
                node, ends = at, ENDS.get(tag, ())
                while node and node.tag not in ends and node.tag not in (EDGE if tag not in ("tr", "td", "th") else ("table",)):
                    node = node.up
                if node and node.tag in ends and node.up:
                    at = node.up
                if tag == "body":
                    at = root
            judged = unwanted(tag, m[3], at)
            child = Node(tag, at, at.dropped or judged == 2, at.link or tag == "a")
            child.doubtful, child.main = judged == 1, tag == "main"
            at.kids.append(child)
            nodes.append(child)
            at = child
        node = at
        while node.tag not in BLOCK and node.up:
            node = node.up
        home = node
    close()
    return nodes, settled(nodes, blocks)


def settled(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """The blocks without those of doubtful elements that hold less than half of the page's text and no main element."""
    if not any(x.doubtful for x in nodes):
        return blocks
    chars: dict[int, int] = {}
    for node, text, _ in blocks:
        chars[id(node)] = chars.get(id(node), 0) + len(text)
    for x in reversed(nodes):
        if x.up and not x.dropped:
            chars[id(x.up)] = chars.get(id(x.up), 0) + chars.get(id(x), 0)
            x.up.main |= x.main
    least = HALF * chars.get(id(nodes[0]), 0)
    for x in nodes:
        x.dropped |= (x.up is not None and x.up.dropped) or (x.doubtful and not x.main and chars.get(id(x), 0) < least)
    return [b for b in blocks if not b[0].dropped]


def around(best: Node) -> Node:
    """The ancestor (or itself) within which everything beside the best container belongs to it."""
    main = article = None
    at = best
    while at.up:
        if at.tag == "main":
            main = at
        elif at.tag == "article":
            article = at
        at = at.up
    return main or (article and article.up) or at


def reads(x: Node) -> bool:
    """Whether an element is not mostly links; the link of its only title doesn't count."""
    return x.linked - (x.titled if x.titles == 1 else 0) < LINKS * x.chars


def scores(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> dict[int, Node]:
    """The containers that get points, with sums of characters, links and titles set on all elements."""
    scored: dict[int, Node] = {}
    for node, text, linked in blocks:
        node.chars += len(text)
        node.linked += linked
        if node.tag in ("h1", "h2"):
            node.titles, node.titled = node.titles + 1, node.titled + linked
        if len(text) >= 25 and node.tag not in ("h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "figcaption", "caption", "th"):
            points = 1 + text.count(",") + min(len(text) // 100, 3)
            up = (node.up or node) if node.tag not in ("div", "section", "article", "main", "body", "td") else node
            up.points += points
    for x in reversed(nodes):  # children before parents
        if x.points:
            scored[id(x)] = x
            x.score = x.points + BASE.get(x.tag, 0)
        if x.up:
            x.up.points += x.points / 2
            x.up.chars += x.chars
            x.up.linked += x.linked
            x.up.titles += x.titles
            x.up.titled += x.titled
    return scored


def main_text(page: str | None) -> str:
    if not page:
        return ""
    nodes, blocks = blocks_of(page)
    if not blocks:
        return ""
    scored = scores(nodes, blocks)
    fair = lambda x: x.score * (1 - min(1.0, x.linked / x.chars if x.chars else 0))
    path: set[int] = set()  # ancestors of the best container whose own text is kept
    if not scored:
        kept = [next((x for x in nodes if x.tag in ("article", "main") and x.chars), nodes[0])]
    else:
        best = max(scored.values(), key=lambda x: (fair(x), x.level))
        while best.up and best.up.up and best.up.score > 0 and len([k for k in best.up.kids if k.chars]) == 1:
            best = best.up  # a wrapper around it alone says the same
        kept, least = [best], max(10.0, 0.2 * fair(best))
        near = lambda x: id(x) in scored and fair(x) >= least
        at, top = best, around(best)
        while at is not top and at.up:
            path.add(id(at.up))
            kept += [x for x in at.up.kids if x is not at and x.chars and (near(x) or x.tag != "article" and reads(x))]
            at = at.up
        if best is top and best.up:
            kept += [x for x in best.up.kids if x is not best and x.chars and (near(x) or x.tag == "p" and reads(x))]
    inside = {id(x) for x in kept}
    for x in nodes:
        if x.up and id(x.up) in inside:
            inside.add(id(x))
    return "\n\n".join(text for node, text, linked in blocks if id(node) in inside or id(node) in path and linked < LINKS * len(text))


def extract(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(keep..., text, n_chars) of each row."""
    small_batches(pages.sparkSession)
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string, n_chars long"

    def run(batches):
        for batch in batches:
            texts = [main_text(s.as_py()) for s in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, html_column).mapInArrow(run, schema)


def op2_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html_extraction": op2_html_extraction}
SQL: dict[str, str] = {}
