"""Main text of raw pages by composite text density (Sun, Song and Liao, 2011).

Every element of the page, menus and footers too, gets its characters, tags, link characters and link
tags; its density is link-adjusted characters per tag.  The subtree with the largest sum of its
children's densities is the article's core.  The least density on its path to body is the threshold:
siblings along the path that reach it belong to the article, the others do not.  Markup is only a tie
break: beside the core, sparse headings and what stands in the core's own article or main element stay
unless they are mostly links, as a page without links has so dense a body that a title falls short.
Elements whose kind never is article text are left out of what is chosen from and written.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .runtime import add_columns, texts_of

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(/?)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
RAW_END = {t: re.compile(rf"</{t}(?![a-z0-9:-])", re.I) for t in RAW}
#: What swallows the rest of a page without any further end of a tag.
TAIL = re.compile(r"<!--|<!\[CDATA\[|<[!?]")
#: Elements whose content is never part of an article.
OUT = frozenset("script style title noscript iframe template head nav footer aside form button select option textarea svg canvas audio video dialog menu annotation annotation-xml input fieldset legend datalist".split())
#: Those that are not even measured: they hold no text of the page.
UNSEEN = frozenset("script style title noscript iframe template head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody tfoot thead tr ul xmp".split())
CELLS = frozenset("td th".split())
#: What an open element is closed by, with the elements that shield it.
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: By the tag that opens: what it may close.
CLOSERS: dict[str, set[str]] = {}
for _open, _tags in CLOSED_BY.items():
    for _tag in _tags:
        CLOSERS.setdefault(_tag, set()).add(_open)
SHIELD = frozenset("ul ol dl table div section article body".split())
#: Words of class and id that speak for menus, adverts, notices, sidebars, forms and reader comments (see ``settle``).
ASIDE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|adslot|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|notices|alert|popup|modal|overlay|sidebar|side|menu|nav|navbar|navigation|breadcrumb\w*|header|masthead|topbar|toolbar|footer|foot|share|sharing|social|related|recommend\w*|subscribe|subscription|newsletter|signup|login|search|pagination|pager|comment|comments|commentlist|disqus|reply|replies|respond|widget|skip|copyright|legal|disclaimer)(?:$|[\s_-]|\d)",
    re.I,
)
#: Within article or main only names of menus, sidebars, notices, adverts, forms and sharing count.
ASIDE_INSIDE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|adslot|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|notices|popup|modal|overlay|sidebar|menu|nav|navbar|navigation|breadcrumb\w*|share|sharing|social|subscribe|subscription|newsletter|signup|login|pagination|pager|comment|comments|commentlist|disqus|reply|replies|respond)(?:$|[\s_-]|\d)",
    re.I,
)
#: Those of them that mark what readers wrote, which no layout wrapper is named by.
READERS = re.compile(r"(?:^|[\s_-])(?:comment|comments|commentlist|disqus|reply|replies|respond)(?:$|[\s_-]|\d)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())


class Node:
    __slots__ = ("tag", "parent", "items", "chars", "tags", "link_chars", "link_tags", "density", "total", "out", "named", "size", "links", "holds")

    def __init__(self, tag: str, parent: Node | None, out: bool, named: str = ""):
        self.tag, self.parent, self.out, self.named = tag, parent, out, named
        self.items: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = self.size = self.links = 0
        self.density = self.total = 0.0
        self.holds = False


def is_aside(tag: str, attrs: str, inside: bool) -> tuple[bool, str]:
    """Whether an element stands outside any article, and else what its class and id name: readers, a kind, layout or nothing.

    A class or id that is such a word as a whole names a kind, one that holds it among others a layout.
    ``inside``: within article or main, where a header holds the title.
    """
    if tag in OUT or (tag == "header" and not inside):
        return True, ""
    named = ""
    if not attrs or tag in ("body", "html", "main"):
        return False, named
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            if READERS.search(value):
                named = "readers"
            elif tag != "article" and (ASIDE_INSIDE if inside else ASIDE).search(value):
                whole = any((ASIDE_INSIDE if inside else ASIDE).fullmatch(w) for w in value.split())
                named = named or ("kind" if whole else "layout")
        elif tag == "article":
            continue
        elif name == "hidden" or name == "role" and value.lower() in ROLES:
            return True, ""
        elif name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True, ""
    return False, named


def settle(root: Node) -> None:
    """Leave out elements that are named as asides where their text agrees with the name.

    A name is no evidence on an element that holds an article or main, nor on one with most of the
    page's text unless the page has an article or main elsewhere.  What readers wrote, what is named by
    a kind alone and what is mostly links goes by its name; other text only in small elements (a quarter
    of the page's text), and not if these together are most of the page.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.items if isinstance(c, Node))
    for node in reversed(order):
        for c in node.items:
            if isinstance(c, str):
                size = len(" ".join(c.split()))
                node.size += size
                node.links += size if node.tag == "a" else 0
            else:
                node.size += c.size
                node.links += c.size if node.tag == "a" else c.links
                node.holds = node.holds or c.holds or (c.tag in ("article", "main") and not c.out and not c.named and c.size > 0)
    for node in order:
        if node.named and not node.holds and (2 * node.size <= root.size or root.holds and node.named != "layout"):
            node.out = node.out or node.named != "layout" or 2 * node.links >= node.size
    small, covered = [], set()
    for node in order:
        if node.out or node.parent is not None and id(node.parent) in covered:
            covered.add(id(node))
        elif node.named == "layout" and not node.holds and 4 * node.size <= root.size:
            covered.add(id(node))
            small.append(node)
    if 2 * sum(x.size for x in small) <= root.size:
        for x in small:
            x.out = True


def parse(html: str) -> Node:
    """Forgiving tree of a page, in one pass; unclosed and stray tags are resolved as browsers roughly do."""
    root = here = Node("html", None, False)
    opened: Counter[str] = Counter()  # open elements by tag, so that stray tags need not be searched for
    named = body = False

    def leave(upto: Node) -> Node:
        node = here
        while node is not upto:
            opened[node.tag] -= 1
            node = node.parent
        return node

    at, n = 0, len(html)
    last = html.rfind(">") + 1  # no tag ends beyond
    while at < n:
        m = TOKEN.search(html, at, last) if at < last else None
        text = html[at : m.start()] if m else html[at:last] if at < last else ""
        if text:
            here.items.append(unescape(text))
        if not m:
            rest = html[max(at, last) :]
            tail = TAIL.search(rest)
            here.items.append(unescape(rest[: tail.start()] if tail else rest))
            if tail and tail[0] == "<![CDATA[":
                here.items.append(rest[tail.end() :])
            break
        at = m.end()
        if m.end() == last and m[0].startswith("<!--") and not m[0].endswith("-->"):
            break  # a comment that never ends
        tag = (m[3] or m[7] or "").lower()
        if not tag:
            if m[1]:
                here.items.append(m[1])
            continue
        if m[2] or m[6]:  # end tag
            if opened[tag]:
                up = here
                while up.tag != tag:
                    up = up.parent
                here = leave(up.parent)
            continue
        if any(opened[t] for t in CLOSERS.get(tag, ())):
            up = here
            while up is not root and up.tag not in SHIELD:
                if tag in CLOSED_BY.get(up.tag, ()):
                    here = leave(up.parent)
                    break
                up = up.parent
        if tag == "html" or tag == "body" and body:
            continue
        body = body or tag == "body"
        inside = opened["article"] > 0 or opened["main"] > 0
        node = Node(tag, here, *is_aside(tag, m[4] or m[8] or "", inside))
        named = named or bool(node.named)
        here.items.append(node)
        if tag in RAW:
            end = RAW_END[tag].search(html, at)
            if tag == "xmp":
                node.items.append(html[at : end.start() if end else n])
            at = html.find(">", end.end()) + 1 if end else n
            if not at:
                break
        elif tag not in VOID:
            here = node
            opened[tag] += 1
    if named:
        settle(root)
    return root


def elements(root: Node) -> list[Node]:
    """All elements that may hold text, parents first, without recursion."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.items) if isinstance(c, Node) and c.tag not in UNSEEN)
    return out


def density(c: int, t: int, lc: int, lt: int, ratio: float) -> float:
    """Composite text density of c characters, t tags, lc characters and lt tags of links; ratio is body's share of link text."""
    if not c:
        return 0.0
    plain = max(c - lc, 1)
    t, lc, lt = max(t, 1), max(lc, 1), max(lt, 1)
    base = log(c / plain * lc + ratio * c + e)
    return max(0.0, c / t * log(max(c / lc * t / lt, 1e-9)) / max(log(base), 1e-9))


def measure(nodes: list[Node]) -> None:
    """Densities of all elements, and of each the sum of its children's."""
    for node in reversed(nodes):
        link = node.tag == "a"
        for c in node.items:
            if isinstance(c, str):
                size = len(" ".join(c.split()))
                node.chars += size
                node.link_chars += size if link else 0
            elif c.tag not in UNSEEN:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.chars if link else c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
    ratio = nodes[0].link_chars / max(nodes[0].chars, 1)
    for node in nodes:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, ratio)
    for node in nodes:
        node.total = sum(c.density for c in node.items if isinstance(c, Node) and not c.out and c.tag not in UNSEEN)


def article(root: Node) -> Node | None:
    """The element that holds the article, its sparse siblings marked as out."""
    nodes = elements(root)
    measure(nodes)
    open_, stack = [], [root]
    while stack:  # what is not left out, with all its ancestors
        node = stack.pop()
        open_.append(node)
        stack.extend(c for c in reversed(node.items) if isinstance(c, Node) and not c.out and c.tag not in UNSEEN)
    if not root.chars:
        return None
    best = max(open_, key=lambda x: x.total)
    if best.total <= 0:
        best = root
    least, up, own = best.density, best, None
    while up is not None:
        least = min(least, up.density)
        own = up if up.tag == "article" or up.tag == "main" and own is None else own
        up = up.parent
    top, sparse, here = best, [], best
    within = own is not None and best is not own
    while here.parent is not None:
        for c in here.parent.items:
            if isinstance(c, Node) and c is not here and c.chars and not c.out:
                if c.density >= least or (within or c.tag in HEADINGS) and 2 * c.link_chars < c.chars:
                    top = here.parent
                else:
                    sparse.append(c)
            elif isinstance(c, str) and within and c.strip():
                top = here.parent
        here = here.parent
        within = within and here is not own
    for c in sparse:
        c.out = True
    return top


def blocks(node: Node) -> Iterator[str]:
    """Texts of the blocks of a subtree in page order, white space as one space."""
    line: list[str] = []
    stack: list[Node | str | None] = [node]
    while stack:
        item = stack.pop()
        if item is None:
            text = " ".join("".join(line).split())
            line.clear()
            if text:
                yield text
        elif isinstance(item, str):
            line.append(item)
        elif not item.out:
            if item.tag in BLOCK or item.tag == "br":
                stack += [None, *reversed(item.items), None]
            elif item.tag in CELLS:
                stack += [" ", *reversed(item.items), " "]
            else:
                stack.extend(reversed(item.items))
    text = " ".join("".join(line).split())
    if text:
        yield text


def main_text(html: str | None) -> str:
    node = article(parse(html)) if html else None
    return "\n".join(blocks(node)) if node else ""


def extract_text(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Append text (empty if there is none) and n_chars (its code points) of each whole page.

    A null or empty page has the empty text. Markup that never ends swallows what a browser would
    swallow: an open comment, script or style the rest of the page; an unfinished tag is text. Repeated
    rows are read alike; all columns (or ``keep``) are carried, one named text or n_chars is replaced.
    An empty table stays empty. Pages of any length take one pass.
    """

    def make():
        def work(col: pa.Array) -> list[pa.Array]:
            found = [main_text(t) for t in texts_of(col)]
            return [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]

        return work

    return add_columns(pages, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], [html_col], make, keep)
