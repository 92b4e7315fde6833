"""Main text of web pages by composite text density.

Every DOM node has a density: its characters per tag, adjusted by how much of both stands in links, against the page's own share of link
text. The density sum of a node adds up its children's densities. The subtree with the largest sum is the core of the article; the
smallest density on the path from the body to it is the threshold, and other subtrees that reach it are content as well.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_NOT_TEXT = frozenset("script style noscript template iframe xmp head title nav footer aside form button select textarea svg math object canvas audio video dialog menu".split())
_NO_CONTENT = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|sidebar\w*|side-bar|menu\w*|nav|navbar|navigation|topbar|masthead|site-header|page-header|header|footer\w*|breadcrumb\w*|"
    r"comment|comments|commentlist|disqus\w*|replies|respond|cookie\w*|consent\w*|gdpr|notice\w*|popup\w*|modal\w*|overlay|newsletter\w*|subscribe\w*|signup|login|share\w*|sharing|social\w*|related\w*|recommend\w*|widget\w*|pagination|pager|skip|toolbar|search|copyright|legal|disclaimer)(?:$|[\s_-])",
    re.I,
)
#: Names that say what a page's layout has or lacks, not what the element holds.
_LAYOUT = re.compile(r"(?:^|(?<=[\s_-]))(?:no|has|with|without)[_-][^\s_-]+", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table article section div main body html td th blockquote".split())
#: Elements that a page's main text can be; a paragraph or an inline element alone is not.
_HOLDERS = frozenset("html body article section main div td center blockquote".split())


class Node:
    __slots__ = ("tag", "parent", "parts", "drop", "named", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, drop: bool, named: bool = False):
        self.tag, self.parent, self.drop, self.named = tag, parent, drop, named
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _boilerplate(tag: str, attributes: str, parent: Node) -> bool:
    if tag in _NOT_TEXT:
        return True
    if tag == "header":  # an article's own header has its headline
        above: Node | None = parent
        while above is not None and above.tag not in ("article", "main"):
            above = above.parent
        if above is None:
            return True
    if not attributes or tag in ("body", "html", "article", "main"):
        return False
    for name, *values in _ATTR.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "role" and value.lower() in _ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _named(tag: str, attributes: str) -> bool:
    """Whether class or id sound like boilerplate."""
    if not attributes or tag in ("body", "html", "article", "main", "p", "b", "i", "em", "strong", "span", "h1", "h2"):
        return False
    return any(name.lower() in ("class", "id") and _NO_CONTENT.search(_LAYOUT.sub("", next((v for v in values if v), ""))) for name, *values in _ATTR.findall(attributes))


def drop_named(root: Node) -> None:
    """Drops what sounds like boilerplate, but nothing that holds half of the page's text or more: that is left to density.

    On a page of a line or two an advert may hold half; there it goes if the page marks an article besides.
    """
    chars: dict[int, int] = {}
    nodes = _order(root)
    for n in reversed(nodes):
        chars[id(n)] = sum(len(p.strip()) if isinstance(p, str) else chars.get(id(p), 0) for p in n.parts)
    marked = [n for n in nodes if n.tag in ("article", "main") and chars[id(n)]]
    for n in nodes:
        if n.named:
            size = chars[id(n)]
            n.drop = n.drop or 2 * size < chars[id(root)] or size < 200 and bool(marked) and not any(id(m) in {id(x) for x in _order(n)} for m in marked)


def parse(page: str) -> Node:
    """A tree of elements and texts; unclosed elements end with what holds them, stray end tags are passed over."""
    root = Node("html", None, False)
    at, node = 0, root
    for_raw = 0
    while True:
        m = _TOKEN.search(page, for_raw)
        if m is None:
            break
        if m.start() > at:
            node.parts.append(page[at : m.start()])
        at = for_raw = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            above: Node | None = node
            while above is not None and above.tag != tag:
                above = above.parent
            if above is not None and above.parent is not None:
                node = above.parent
            elif tag in _BLOCK:
                node.parts.append(" ")
            continue
        if tag in ("html", "body") and node is root:
            if tag == "html":
                continue
        if tag in _BLOCK and tag != "br":  # a paragraph ends where a block begins
            above = node
            while above is not None and above.tag != "p" and above.tag not in _SCOPES:
                above = above.parent
            if above is not None and above.tag == "p":
                node = above.parent or root
        if tag in _CLOSES:
            above = node
            while above is not None and above.tag not in _CLOSES[tag] and above.tag not in _SCOPES:
                above = above.parent
            if above is not None and above.tag in _CLOSES[tag]:
                node = above.parent or root
        attributes = m[3] if m[3] is not None else m[6] or ""
        child = Node(tag, node, _boilerplate(tag, attributes, node), _named(tag, attributes))
        node.parts.append(child)
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = for_raw = end.end() if end else len(page)
        elif tag not in _VOID and not attributes.rstrip().endswith("/") or tag in _HOLDERS:
            node = child
    if at < len(page):
        node.parts.append(page[at:])
    return root


def _order(root: Node) -> list[Node]:
    """Nodes that may hold text, parents before children."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [c for c in reversed(n.parts) if isinstance(c, Node) and not c.drop]
    return out


def measure(root: Node) -> list[Node]:
    nodes = _order(root)
    for n in reversed(nodes):
        own = sum(len(p.strip()) for p in n.parts if isinstance(p, str))
        n.chars += own
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
        if n.parent is not None:
            p = n.parent
            p.chars, p.tags = p.chars + n.chars, p.tags + n.tags + 1
            p.link_chars, p.link_tags = p.link_chars + n.link_chars, p.link_tags + n.link_tags
    share = root.link_chars / max(root.chars, 1)
    for n in nodes:
        c, t, lc, lt = n.chars, max(n.tags, 1), n.link_chars, max(n.link_tags, 1)
        if c:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            ratio = max(c / max(lc, 1) * t / lt, 1.0)
            n.density = c / t * math.log(ratio + 1) / math.log(base + 1)
    for n in nodes:
        n.total = sum(c.density for c in n.parts if isinstance(c, Node) and not c.drop)
    return nodes


def _text(nodes: list[Node]) -> str:
    out: list[str] = []
    stack: list[Node | str] = list(reversed(nodes))
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.drop:
            out.append(" " if n.tag in _BLOCK or n.tag in _NOT_TEXT else "")
        else:
            gap = " " if n.tag in _BLOCK else ""
            stack += [gap, *reversed(n.parts), gap]
    return " ".join(_html.unescape("".join(out)).split())


def main_text(page: str | None) -> str:
    """The page's main text; blocks in page order, one space between them and for any white space within."""
    if not page:
        return ""
    root = parse(page)
    drop_named(root)
    nodes = measure(root)
    holders = [n for n in nodes if n.tag in _HOLDERS and n.chars]
    if not holders:
        return _text([root])
    best = max(holders, key=lambda n: n.total) if any(n.total for n in holders) else root
    path, n = [], best
    while n is not None:
        path.append(n)
        n = n.parent
    threshold = min(n.density for n in path if n.density)
    for n in path:  # the whole of the article that the core stands in
        if n.tag in ("article", "main") and n.density >= threshold:
            best = n
    inside, chosen = set(map(id, _order(best))) | {id(n) for n in path}, [best]
    if best.tag not in ("article", "main", "body", "html"):
        taken: set[int] = set()
        for n in nodes:
            if id(n) in inside or id(n.parent) in taken:
                taken |= {id(n)} if id(n.parent) in taken else set()
                continue
            if n.density >= threshold and n.tag in _HOLDERS and n.chars > n.link_chars * 2:
                chosen.append(n)
                taken.add(id(n))
        rank = {id(n): i for i, n in enumerate(nodes)}
        chosen.sort(key=lambda n: rank[id(n)])
    elif best.tag == "article":
        chosen = [n for n in nodes if n.tag == "article" and n.parent is best.parent and n.density >= threshold]
    return _text(chosen)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html).

    Null or empty html, and pages without any text, give an empty text. Markup may be broken: unclosed elements end with their parent. Repeated rows stay, null ids and urls are passed on; other columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    found = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(scan, "page_id bigint, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
