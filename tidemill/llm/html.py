"""Main text of HTML pages by tree scoring.

A tolerant parser builds a small tree in one pass. Every paragraph passes points, for its length and its commas
and discounted by the share of its text that is in links, to its ancestors: all to the parent, half to the
next, a third to the one above, and so on. Tags, roles and class words that speak of menus, adverts, comments and
the like are evidence, not a verdict: they discount the points of all paragraphs below. The container with the
most points is the article, whatever is written on it and around it; siblings that look alike belong to it, up to
the article or main element that holds it, if there is one. Inside, elements with such marks are left out, unless most
of the text is in them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm.common import chunks

# fixed values: tags by their part in a page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noscript noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("nav footer aside head script style noscript template button select option optgroup textarea input label fieldset iframe object embed svg canvas audio video map menu dialog title noframes xmp".split())
ASIDE = frozenset("form header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist note".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle adbox adslot sponsor sponsored sponsors promo promos promotion promoted banner banners nav navbar navigation menu menus topbar toolbar breadcrumb breadcrumbs pagination pager sidebar sidebars aside rail widget widgets footer foot masthead header "
    "comment comments commentlist respond reply replies disqus discussion notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations form search skip hidden".split()
)
#: Words that say where or how large an element is; they don't change what it is.
PLACES = frozenset("left right top bottom upper lower main primary secondary inner outer wrapper wrap container box block section area list item items group col column row bar buttons button links icons post posts page site global text title body side first last small large sticky fixed slot unit space zone placement frame thread".split())
UNSEEN = frozenset("visually-hidden visuallyhidden sr-only screen-reader-text screen-reader-only d-none".split())
_CLOSED_BY = {  # an open element: the tags whose start ends it
    "p": BLOCK - {"body", "html"},
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}
_CLOSERS = frozenset().union(*_CLOSED_BY.values())
_TABLE = frozenset("table tbody thead tfoot tr td th caption".split())
_CELLS = frozenset("td th caption".split())
_LISTS = frozenset("ul ol menu dir dl table td th".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TITLES = frozenset("h1 h2 h3 hgroup".split())
_PARAGRAPHS = frozenset("p pre blockquote td dd dt".split())
_WHOLE = frozenset("article main".split())
_TOP = frozenset("#root html body".split())

#: What marks make of an element: nothing, a hint, something beside the article, nothing to be read.
PLAIN, HINT, BESIDE, OUT = range(4)
DISCOUNT = (1.0, 0.5, 0.1, 0.0)
#: How many levels a paragraph's points go up.
LEVELS = 5
#: Points for an article or main element, and for a page's only article.
WHOLE, ONLY = 5, 15
#: A block of nothing but so many links of so few code points each is a menu.
MENU_LINKS, MENU_LENGTH = 3, 40

_TOKEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<odd>/?[a-zA-Z][^>]*>)|[!?/][^>]*>)", re.S)
_MARK = re.compile(r"(?<![\w-])(class|id|role|style|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_UNSTYLED = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_SIZE = re.compile(r"[0-9]+(?:x[0-9]+)?")
#: What follows these in a class says what the element has beside it or lacks, not what it is: has-sidebar, no-ads; and what comes before these, too: ad-free.
_ABOUT, _WITHOUT = frozenset("has have with no without".split()), frozenset("free less".split())
_COMMAS = ",،、，"


class Node:
    __slots__ = ("tag", "parent", "kids", "mark", "points", "length", "linked", "links", "commas", "clean", "worth", "written")

    def __init__(self, tag: str, parent: Node | None, mark: int = PLAIN):
        self.tag, self.parent, self.mark = tag, parent, mark
        self.kids: list[Node | str] = []
        self.points, self.worth = 0.0, 1.0
        # code points of its text, of those in links and outside of marked elements; whether it holds a paragraph tag
        self.length = self.linked = self.links = self.commas = self.clean = 0
        self.written = False


def _of_names(value: str) -> int:
    """What the names in a class or id say."""
    out = PLAIN
    for name in value.split():
        if name.lower() in UNSEEN:
            return OUT
        words = [w for w in _SPLIT.split(_CAMEL.sub("-", name).lower()) if w]
        for i, word in enumerate(words):
            if word in _ABOUT:
                words = words[:i]
                break
        words = [w for i, w in enumerate(words) if not (w in _WITHOUT or (i + 1 < len(words) and words[i + 1] in _WITHOUT))]
        noise = [w for w in words if w in NOISE]
        if noise:
            other = [w for w in words if w not in NOISE and w not in PLACES and not _SIZE.fullmatch(w)]
            out = max(out, HINT if other and len(noise) < 2 else BESIDE)
    return out


def _mark_of(tag: str, attrs: str) -> int:
    if tag in NEVER:
        return OUT
    out = BESIDE if tag in ASIDE else PLAIN
    if not attrs or attrs.isspace():
        return out
    if _HIDDEN.search(_QUOTED.sub("", attrs)):
        return OUT
    for name, *values in _MARK.findall(attrs):
        value, name = "".join(values), name.lower()
        if name == "role":
            out = max(out, BESIDE if value.strip().lower() in ROLES else PLAIN)
        elif name == "style":
            out = OUT if _UNSTYLED.search(value) else out
        elif name == "aria-hidden":
            out = OUT if value.strip().lower() == "true" else out
        elif tag not in ("body", "html", "main"):
            out = max(out, _of_names(value))
    return out


def parse(page: str) -> Node:
    """The tree of a page; time and memory in proportion to its length."""
    root = Node("#root", None)
    path, blocks, cells = [root], [], []  # open elements; the depths of blocks and cells among them
    depths: dict[str, list[int]] = {}

    def leave(depth: int) -> None:
        while len(path) > depth:
            depths[path.pop().tag].pop()
            for kind in (blocks, cells):
                if kind and kind[-1] == len(path):
                    kind.pop()

    at, end, last = 0, len(page), page.rfind(">")
    while at < end:
        m = _TOKEN.search(page, at) if at <= last else None
        stop = m.start() if m else end
        if stop > at:
            path[-1].kids.append(page[at:stop])
        if not m:
            break
        at, tag = m.end(), m["tag"]
        if tag is None:
            if m["odd"] is None:
                continue
            odd = re.match(r"(/?)([a-zA-Z][^\s/>]*)(.*)>", m["odd"], re.S)
            closing, tag, attrs = odd[1], odd[2], odd[3]
        else:
            closing, attrs = m["end"], m["attrs"]
        tag = tag.lower()
        if closing:
            depth = depths[tag][-1] if depths.get(tag) else None
            if depth is None:
                if tag in ("p", "br"):
                    path[-1].kids.append(Node("br", path[-1]))
            # the end of an inline element doesn't reach out of a block, nor any other out of a cell
            elif not (tag not in BLOCK and tag != "a" and blocks and blocks[-1] > depth) and not (tag not in _TABLE and cells and cells[-1] > depth):
                leave(depth)
            continue
        if tag in _CLOSERS:
            while blocks and tag in _CLOSED_BY.get(path[blocks[-1]].tag, ()):
                leave(blocks[-1])
        elif tag == "a" and depths.get("a") and not (cells and cells[-1] > depths["a"][-1]):
            leave(depths["a"][-1])
        elif tag == "body" and depths.get("head"):
            leave(depths["head"][-1])
        new = Node(tag, path[-1], _mark_of(tag, attrs))
        path[-1].kids.append(new)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
        elif tag not in VOID and not (attrs.endswith("/") and tag in ("svg", "path")):  # a slash doesn't close an element of HTML
            depths.setdefault(tag, []).append(len(path))
            if tag in BLOCK:
                blocks.append(len(path))
            if tag in _CELLS:
                cells.append(len(path))
            path.append(new)
    return root


def _in_order(root: Node) -> list[Node]:
    """All elements that can be read, each before its kids, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(k for k in reversed(node.kids) if not isinstance(k, str) and k.mark != OUT)
    return out


def _measure(order: list[Node]) -> list[Node]:
    """Sets lengths, commas and what the marks above leave of a paragraph's worth; returns the elements that hold own paragraphs."""
    for node in order:
        node.worth = (node.parent.worth if node.parent else 1.0) * DISCOUNT[node.mark]
    out = []
    for node in reversed(order):
        own = 0
        for k in node.kids:
            if isinstance(k, str):
                own += len(k.strip())
                node.commas += k.count(",") if k.isascii() else sum(map(k.count, _COMMAS))
            elif k.mark != OUT:
                node.length += k.length
                node.linked += k.linked
                node.links += k.links
                node.commas += k.commas
                node.written = node.written or k.written
                node.clean += k.clean if k.mark < BESIDE else 0
        node.length += own
        node.clean += own
        if node.tag == "a":
            node.linked, node.links = node.length, 1
        node.written = node.written or (node.tag in _PARAGRAPHS and node.length > 0)
        if node.tag in _PARAGRAPHS or (own and node.tag in BLOCK and node.tag not in _HEADINGS and node.tag not in ("li", "html", "body")):
            out.append(node)
    return out


def _density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def _best(order: list[Node], paragraphs: list[Node]) -> Node | None:
    scored = set()
    for p in paragraphs:
        if not p.length:
            continue
        points = (0.2 + min(p.length / 100, 3) + p.commas) * (1 - _density(p)) * p.worth
        node, level = (p if p.tag not in _PARAGRAPHS else p.parent), 1
        while node is not None and node.tag != "#root" and level <= LEVELS:
            node.points += points / level
            scored.add(node)
            node, level = node.parent, level + 1
    only = sum(n.tag == "article" for n in order) == 1
    for node in scored:
        node.points *= 1 - _density(node)
        if node.tag in _WHOLE:
            node.points = node.points * 1.25 + (ONLY if only and node.tag == "article" else WHOLE) * node.worth
        elif node.tag in _LISTS:
            node.points *= 0.5
        elif node.tag in _TOP:
            node.points *= 0.6
    return max((n for n in order if n in scored), key=lambda n: n.points, default=None)


def _settle(node: Node) -> None:
    """Takes marks away from elements below `node` that hold most of its text."""
    stack = [node]
    while stack:
        node = stack.pop()
        if node.length and node.clean < 0.25 * node.length:
            for k in node.kids:
                if not isinstance(k, str) and k.mark == BESIDE and k.length >= 0.25 * node.length:
                    k.mark = PLAIN
        stack.extend(k for k in node.kids if not isinstance(k, str) and k.mark < BESIDE and k.length >= 0.25 * node.length)



def _kept(node: Node) -> str:
    """What of an element inside the article is read: all, titles or nothing."""
    if node.mark == OUT:
        return "nothing"
    if node.tag == "header":
        return "titles"
    if node.mark == BESIDE:
        return "nothing"
    if node.links >= MENU_LINKS and node.linked >= 0.9 * node.length and node.linked <= MENU_LENGTH * node.links and node.tag in BLOCK and node.tag not in ("p", "pre", "blockquote") and node.tag not in _HEADINGS:
        return "nothing"
    if node.mark == HINT and node.tag not in _HEADINGS:
        if node.tag in BLOCK and node.tag not in _PARAGRAPHS and not node.written and node.length < 80:
            return "titles"
        return "all" if _density(node) < 0.3 else "titles"
    return "all"


def _belongs(node: Node, best: Node, whole: bool) -> str:
    """What of a sibling of the article, or of what holds it, is read. `whole`: inside of an article or main element."""
    kept = _kept(node)
    if kept != "all" or not node.length:
        return kept if whole or node.parent.tag not in _TOP else "nothing"
    density = _density(node)
    if whole:
        return "all" if density < 0.5 else "nothing"
    if node.tag in _HEADINGS:
        return "all" if density < 0.5 else "nothing"
    if node.tag == "article" and node.length < 0.5 * best.length:  # another, smaller one
        return "nothing"
    if node.tag in ("p", "pre", "blockquote") or node.written:
        return "all" if density < 0.25 else "nothing"
    return "all" if density < 0.25 and node.points >= 0.2 * best.points else "nothing"


class _Writer:
    """Blocks of text, white space inside of them made one space."""

    def __init__(self):
        self.blocks: list[str] = []
        self.now: list[str] = []

    def end(self) -> None:
        if text := " ".join(html.unescape("".join(self.now)).split()):
            self.blocks.append(text)
        self.now.clear()

    def write(self, node: Node, titles: bool = False) -> None:
        """All of an element, or its titles only."""
        stack: list[tuple[Node | str | None, bool]] = [(node, titles)]
        while stack:
            item, only = stack.pop()
            if item is None:
                self.end()
            elif isinstance(item, str):
                if not only:
                    self.now.append(item)
            else:
                kept = "all" if item is node else _kept(item)
                only = (only or kept == "titles") and item.tag not in _TITLES
                if item.tag == "br" or kept == "nothing":
                    self.now.append(" ")
                    continue
                if item.tag in BLOCK:
                    self.end()
                    stack.append((None, only))
                stack.extend((k, only) for k in reversed(item.kids))


def main_text(page: str | None) -> str:
    """The article's blocks, joined by an empty line; empty if the page has none."""
    if not page:
        return ""
    root = parse(page)
    order = _in_order(root)
    best, out = _best(order, _measure(order)), _Writer()
    if best is None:
        out.write(root)
        out.end()
        return "\n\n".join(out.blocks)
    chain, whole = [best], None  # from the article up
    while chain[-1].parent is not None:
        chain.append(chain[-1].parent)
    for i, node in enumerate(chain):
        node.mark = PLAIN
        if node.tag in _WHOLE and whole is None:
            whole = i
    _settle(best)
    if whole is not None:
        top = whole
    else:
        # one level up, and further while there is nothing else
        top = 0
        while best.tag not in _TOP and top + 1 < len(chain):
            top += 1
            if chain[top].length > chain[top - 1].length or chain[top].tag in _TOP:
                break
    inside = set(chain[:top])
    stack: list[Node | str | None] = [chain[top]]
    while stack:
        item = stack.pop()
        if item is None:
            out.end()
        elif isinstance(item, str):
            out.now.append(item)
        elif item is best:
            out.write(best)
        elif item is chain[top] or item in inside:
            if item.tag in BLOCK:
                out.end()
                stack.append(None)
            stack.extend(k for k in reversed(item.kids) if not isinstance(k, str) or whole is not None)
        else:
            kept = _belongs(item, best, whole is not None)
            if kept != "nothing":
                out.write(item, kept == "titles")
            out.now.append(" ")
    out.end()
    return "\n\n".join(out.blocks)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """For each row: its id, url, text (the main text of the whole page; empty if none) and n_chars (its
    code points). A null or empty page has an empty text. Rows are read one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "html"):
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    out = pages.selectExpr(f"`{id_col}` AS id", f"`{url_col}` AS url", f"`{html_col}` AS html").mapInArrow(run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars bigint")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
