"""HTML extraction by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tallygrade.llm.texts import filled, slices

# Element names of HTML, and names by which pages mark what is not the article.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
DROPPED = frozenset(
    "script style noscript template iframe object embed applet canvas svg head title nav aside footer form button select textarea"
    " input menu dialog search audio video map datalist noembed noframes".split()
)
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus"
    " footer form header login masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo"
    " related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Parts of a name that say nothing of what a block holds: the part before them does.
TAILS = frozenset(
    "area author bar body bottom box button buttons col column container content group holder icon icons inner item items left link links list meta outer panel"
    " post posts right row section slot text thread top unit wrap wrapper".split()
)
#: Parts that say what a block is beside, not what it is; and those whose header is the article's own.
BESIDE = frozenset("has is layout no not with without".split())
OWN = frozenset("article content entry post section story".split())

#: What an open element of the key is ended by, besides its own end.
ENDED_BY = {
    "p": BLOCKS - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "title"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": {"body"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
}
#: Elements out of which an implied end does not reach.
HOLDS = frozenset("table td th ul ol dl body html article section div main blockquote button".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")


class Node:
    """A block element: its inner texts and blocks in page order, and its counts."""

    __slots__ = ("chars", "density", "drop", "held", "inner", "link_chars", "link_tags", "name", "parent", "tags")

    def __init__(self, name: str, parent: Node | None, drop: bool) -> None:
        self.name, self.parent, self.drop = name, parent, drop
        self.held = _held(parent)
        self.inner: list = []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = 0.0


def _held(parent: Node | None) -> int:
    """What is around a node: 2 an article, 1 no article but the main part, 0 neither."""
    if parent is None:
        return 0
    return max(parent.held, 2 if parent.name == "article" else 1 if parent.name == "main" else 0)


def _marked(token: str) -> str:
    """The mark that a class or id holds, or nothing: its last part that is no mere tail."""
    parts = [p for p in _NAME_PARTS.split(token) if p and not p.isdigit()]
    if not parts or parts[0] in BESIDE:
        return ""
    while len(parts) > 1 and parts[-1] in TAILS and parts[-1] not in MARKS:
        parts.pop()
    if parts[-1] not in MARKS or (parts[-1] == "header" and parts[0] in OWN):
        return ""
    return parts[-1]


def _dropped(name: str, attributes: str) -> bool:
    if name in DROPPED:
        return True
    if not attributes.strip():
        return False
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    style = found.get("style", "").replace(" ", "").lower()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or found.get("role", "").lower() in ROLES:
        return True
    return any(map(_marked, f"{found.get('class', '')} {found.get('id', '')}".lower().split()))


def parsed(page: str) -> Node:
    """The tree of block elements; inline elements only leave their text, links their share of it."""
    root = Node("#", None, False)
    node, opened, links, at = root, [], 0, 0  # opened: (name, its block or None)
    places: dict[str, list[int]] = {}  # where elements of a name are open, and those that end others or stop that
    bounds: list[int] = []

    def close(to: int) -> None:
        nonlocal node, links
        while len(opened) > to:
            name, block = opened.pop()
            places[name].pop()
            if bounds and bounds[-1] == len(opened):
                bounds.pop()
            if block is not None:
                node = block.parent
            links -= name == "a"

    while at < len(page):
        m = _TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            node.inner.append((html.unescape(text), links > 0))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if places.get(name):
                close(places[name][-1])
            continue
        for k in reversed(bounds):
            if name in ENDED_BY.get(opened[k][0], ()):
                close(k)
                break
            if opened[k][0] in HOLDS:
                break
        if name in VOID:
            node.inner.append((" ", links > 0))
            node.tags += name not in ("br", "wbr")
            continue
        drop = _dropped(name, m[3])
        block = None
        if name in BLOCKS or drop:
            block = Node(name, node, drop)
            node.inner.append(block)
            node = block
        elif name == "a":
            node.link_tags += 1
            node.tags += 1
        places.setdefault(name, []).append(len(opened))
        if name in ENDED_BY or name in HOLDS:
            bounds.append(len(opened))
        opened.append((name, block))
        links += name == "a"
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
    return root


def _order(root: Node, dropped: bool = False) -> list[Node]:
    """All blocks, each before those in it; dropped: also what is not taken."""
    out, left = [], [root]
    while left:
        node = left.pop()
        out.append(node)
        left += [x for x in reversed(node.inner) if isinstance(x, Node) and (dropped or not x.drop)]
    return out


def _count(nodes: list[Node]) -> None:
    for node in nodes:
        node.tags, node.chars, node.link_chars = node.tags + 1, 0, 0
        for x in node.inner:
            if not isinstance(x, Node):
                n = len("".join(x[0].split()))
                node.chars += n
                node.link_chars += n if x[1] else 0
    for node in reversed(nodes):
        if node.parent and not node.drop:
            for field in ("chars", "link_chars", "tags", "link_tags"):
                setattr(node.parent, field, getattr(node.parent, field) + getattr(node, field))


def composite_density(node: Node, body: Node) -> float:
    """Characters per tag, made smaller the more of them are links."""
    if not node.chars:
        return 0.0
    plain = max(node.chars - node.link_chars, 1)
    base = math.log(node.chars * node.link_chars / plain + node.chars * body.link_chars / max(body.chars, 1) + math.e)
    share = node.chars / max(node.link_chars, 1) * node.tags / max(node.link_tags, 1)
    return node.chars / node.tags * max(math.log(max(share, 1.0)), 1e-3) / max(math.log(max(base, 1.0) + math.e - 1), 1e-3)


def _article_of(best: Node) -> Node:
    """The second step: the article around the densest block, or the only one in it if that has most of its elements."""
    node = best
    while node:
        if node.name == "article":
            return node
        node = node.parent
    inner = [n for n in _order(best) if n.name == "article"] or [n for n in _order(best) if n.name == "main"]
    return inner[0] if len(inner) == 1 and inner[0].chars and 2 * inner[0].tags > best.tags else best


def main_text(page: str | None) -> str:
    """The text of the article: blocks in page order, one to a line."""
    if not page:
        return ""
    root = parsed(page)
    nodes = _order(root, dropped=True)
    # a mark on what holds the article itself, or the heading inside it, doesn't take it away
    freed: set[int] = set()
    for node in reversed(nodes):
        if node.name in ("article", "main") and not (node.drop and node.held == 2):
            above = node.parent
            while above and above.name not in DROPPED and id(above) not in freed:
                freed.add(id(above))
                above.drop, above = False, above.parent
    for node in nodes:
        if node.name == "header":
            node.drop = node.drop or not node.held
        elif node.name in ("h1", "body", "html"):
            node.drop = False
    live = _order(root)
    _count(live)
    body = next((n for n in live if n.name == "body"), root)
    for node in live:
        node.density = composite_density(node, body)
    best, most = body if body.chars else root, -1.0
    for node in _order(best):
        sons = [x for x in node.inner if isinstance(x, Node) and not x.drop]
        own = Node("#text", None, False)  # the node's own text counts as one more child
        own.tags, own.chars = 1, sum(len("".join(x[0].split())) for x in node.inner if not isinstance(x, Node) and not x[1])
        total = sum(x.density for x in sons) + composite_density(own, body)
        if total > most:
            best, most = node, total
    best = _article_of(best)
    threshold, node = best.density, best
    while node is not body and node.parent:
        node = node.parent
        threshold = min(threshold, node.density)

    lines: list[str] = []
    held: list[str] = []

    def flush() -> None:
        line = " ".join("".join(held).split())
        held.clear()
        if line:
            lines.append(line)

    todo: list = [best]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, Node):
            flush()
            # Inside an article links are text; elsewhere a block of links below all of the path is noise.
            mostly_links = x is not best and not x.held and best.name not in ("article", "main") and 2 * x.link_chars > x.chars and x.density < threshold
            if not x.drop and not mostly_links:
                todo.append(None)
                todo += reversed(x.inner)
        else:
            held.append(x[0])
    flush()
    return "\n".join(lines)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html).

    Null and empty pages, and pages without text, have an empty text. Broken markup is
    read as far as it goes; nothing is cut. Null ids and repeated rows each get their
    answer; other columns are not read.
    """

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [main_text(p) for p in filled(part.column("html")).to_pylist()]
            yield pa.record_batch(
                [part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(made, "page_id long, url string, text string, n_chars long")
