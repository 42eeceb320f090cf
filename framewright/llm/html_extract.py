"""Main text of HTML pages by scoring the containers of the element tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start a block of their own.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text never belongs to an article.
SKIPPED = frozenset(
    "head title script style noscript template svg math canvas iframe object embed audio video nav footer aside form "
    "button select option textarea input label fieldset dialog menu".split()
)
RAW = frozenset(("script", "style"))
#: Words of class, id or role that mark boilerplate.
UNWANTED = re.compile(
    r"(^|[\s_-])(ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|"
    r"subscri\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-?bar|aside|related|recommend\w*|share|sharing|social|"
    r"comments?|comment-?list|disqus|replies|respond|footer|foot|masthead|site-?header|page-?header|header|login|signup|"
    r"search|widget|toolbar|pagination|pager|complementary|contentinfo|alert|skip-?link|hidden)($|[\s_-])", re.I
)
WANTED = re.compile(r"article|body|content|entry|main|page|post|story|text|blog", re.I)
#: These are never dropped for their class.
SAFE = frozenset(("html", "body", "article", "main"))
CLOSED_BY = {
    "p": BLOCKS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "tbody", "tfoot")), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")),
    "option": frozenset(("option", "optgroup")),
}
#: Open inline elements end with the block around them.
WALLS = frozenset("article aside body div footer header html li main nav section table td th ul ol blockquote form".split())
SPACE = re.compile(r"\s+")
LEVELS = 16
#: Siblings of the best container that are article text by their kind, unless they are mostly links.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
TEXT_ELEMENTS = frozenset("p pre blockquote li dd td".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div section article".split())


class Node:
    __slots__ = ("tag", "parent", "children", "score", "skip", "weight")

    def __init__(self, tag: str, parent: Node | None, skip: bool = False, weight: int = 0):
        self.tag, self.parent, self.skip, self.weight = tag, parent, skip, weight
        self.children: list[Node | str] = []
        self.score = 0.0


def _attrs_of(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, int]:
    """Whether the element is boilerplate by its attributes, and the bonus of its class."""
    named = {k: v or "" for k, v in attrs}
    names = " ".join(named.get(k, "") for k in ("class", "id", "role"))
    hidden = "hidden" in named or named.get("aria-hidden") == "true" or re.search(
        r"display\s*:\s*none|visibility\s*:\s*hidden", named.get("style", "")
    )
    skip = tag not in SAFE and bool(hidden or (names and UNWANTED.search(names)))
    return skip, 25 if names and not skip and WANTED.search(names) else 0


#: One piece of markup: comment, raw element with its content, declaration, end tag, start tag; what is cut off by
#: the end of the page counts as whole.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|title|textarea|iframe)(?=[\s/>]).*?(?:</\1(?=[\s/>])[^>]*(?:>|\Z)|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</([a-z][^\s/>]*)[^>]*(?:>|\Z)|<([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))", re.I | re.S
)
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


class Tree:
    """Builds a tree from any page: unclosed paragraphs and inline elements end where their block ends."""

    def __init__(self) -> None:
        self.root = self.at = Node("#root", None)

    def feed(self, page: str) -> None:
        done = 0
        for m in MARKUP.finditer(page):
            if m.start() > done:
                self._text(page[done : m.start()])
            done = m.end()
            if m[3]:
                tag = m[3].lower()
                self._start(tag, m[4])
                if m[4].endswith("/>") and tag not in VOID:
                    self._end(tag)
            elif m[2]:
                self._end(m[2].lower())
        if done < len(page):
            self._text(page[done:])

    def _text(self, data: str) -> None:
        self.at.children.append(unescape(data) if "&" in data else data)

    def _start(self, tag: str, rest: str) -> None:
        if tag in ("html", "body") and self._open(tag) is not None:
            return
        if tag in BLOCKS:
            self._close_implied(tag)
        skip, bonus = (False, 0) if len(rest) < 3 else _attrs_of(
            tag, [(k.lower(), unescape(a or b or c)) for k, a, b, c in ATTR.findall(rest)]
        )
        # a header inside an article is its heading; elsewhere it is the page's
        skip = skip or tag in SKIPPED or (tag == "header" and self._open("article") is None and self._open("main") is None)
        node = Node(tag, self.at, skip or self.at.skip, bonus)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def _end(self, tag: str) -> None:
        node = self._open(tag)
        if node is not None and tag not in ("html", "body"):
            self.at = node.parent

    def _open(self, tag: str) -> Node | None:
        """The open element of this name; an inline element or paragraph is not sought beyond its block."""
        node: Node | None = self.at
        while node is not None:
            if node.tag == tag:
                return node
            if node.tag in WALLS and tag not in WALLS:
                return None
            node = node.parent
        return None

    def _close_implied(self, tag: str) -> None:
        node: Node | None = self.at
        while node is not None:
            if tag in CLOSED_BY.get(node.tag, ()):
                self.at = node.parent
                if node.tag == "p" or node.tag == tag:
                    return
            elif node.tag in WALLS and node.tag not in CLOSED_BY:
                return
            node = node.parent


def _tree(page: str) -> Node:
    tree = Tree()
    tree.feed(page)
    return tree.root


def _walk(root: Node) -> Iterator[Node]:
    """Elements that may hold article text, in page order."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.skip:
            continue
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))


def _score(nodes: list[Node]) -> dict[Node, tuple[int, int]]:
    """Give every container the points of the paragraphs below it; return (characters, of these in links).

    A paragraph gives one point, one per comma and one per hundred characters (at most three): all to its
    parent, half to its grandparent, then a third, a quarter and so on, ``LEVELS`` up.
    """
    size: dict[Node, tuple[int, int]] = {}
    inner: dict[Node, tuple[int, int]] = {}  # characters and commas outside nested blocks
    for node in reversed(nodes):
        chars = linked = length = commas = 0
        for c in node.children:
            if isinstance(c, str):
                n = len(c) if "  " not in c and "\n" not in c else len(SPACE.sub(" ", c))
                chars, length, commas = chars + n, length + n, commas + c.count(",")
            elif not c.skip:
                a, b = size[c]
                chars, linked = chars + a, linked + b
                if c.tag not in BLOCKS:
                    a, b = inner[c]
                    length, commas = length + a, commas + b
        size[node] = chars, chars if node.tag == "a" else linked
        inner[node] = length, commas
        if node.tag in PARAGRAPHS and length >= 25:
            points = 1 + commas + min(length // 100, 3)
            up = node.parent
            for depth in range(1, LEVELS + 1):
                if up is None:
                    break
                up.score += points / depth
                up = up.parent
    return size


def _container(nodes: list[Node]) -> list[Node]:
    """The best container; what does not belong to it is marked to be skipped.

    If the best container stands inside an article or main element, that element is the container. Otherwise it is the lowest element
    around the best container and all paragraphs that are not mostly links, with its siblings that hold text paragraphs, its inline
    siblings and the bare text beside it.
    """
    size = _score(nodes)

    def value(n: Node) -> float:
        chars, linked = size[n]
        return (n.score + (n.weight if n.score else 0)) * (1 - linked / chars if chars else 0)

    best = max(nodes, key=value, default=None)
    if best is None or value(best) <= 0:
        return nodes[:1]
    up: Node | None = best
    while up is not None:
        if up.tag in ("article", "main"):
            return [up]
        up = up.parent

    def textual(n: Node) -> bool:
        chars, linked = size[n]
        return chars >= 25 and linked < 0.33 * chars

    above, below = set(), set()  # below: elements whose way up has been walked
    up = best
    while up is not None:
        above.add(up)
        up = up.parent
    for n in nodes:
        if n.tag in TEXT_ELEMENTS and textual(n):
            up = n
            while up not in above and up not in below:
                below.add(up)
                up = up.parent
            while up in above and best is not up:
                above.discard(best)
                below.add(best)
                best = best.parent
    around = best if best.tag in ("body", "html") or best.parent is None else best.parent
    for c in around.children:
        if isinstance(c, Node) and c is not best and not c.skip and c in size:
            chars, linked = size[c]
            kind = c.score > 0 or c.tag in TEXTUAL or c.tag not in BLOCKS or any(n.tag in TEXT_ELEMENTS for n in _walk(c))
            c.skip = not (chars and kind and linked < 0.33 * chars)
    return [around]


def _blocks(tops: list[Node]) -> list[str]:
    out: list[str] = []
    text: list[str] = []

    def end() -> None:
        line = SPACE.sub(" ", "".join(text)).strip()
        text.clear()
        if line:
            out.append(line)

    for top in tops:
        stack: list[Node | str | None] = [top]
        while stack:
            item = stack.pop()
            if item is None:
                end()
            elif isinstance(item, str):
                text.append(item)
            elif not item.skip:
                if item.tag == "br":
                    text.append(" ")
                elif item.tag in BLOCKS:
                    end()
                    stack.append(None)
                stack.extend(reversed(item.children))
        end()
    return out


def main_text(html: str | None) -> str:
    """Article text of one page: blocks joined by newlines; empty for null, empty and text-free pages."""
    if not html:
        return ""
    nodes = list(_walk(_tree(html)))
    return "\n".join(_blocks(_container(nodes)))


def extract(pages: DataFrame) -> DataFrame:
    """One row per page row: ``page_id, url, text, n_chars``.

    Null html counts as empty; an empty page and one without text give an empty text. A page cut anywhere gives the text
    up to there. Nesting may be of any depth. Repeated rows give repeated results. Columns other than
    ``page_id, url, html`` are not looked at.
    """

    @F.pandas_udf("string")
    def texts(html: pd.Series) -> pd.Series:
        return html.map(main_text, na_action=None)

    text = pages.select("page_id", "url", texts("html").alias("text"))
    return text.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
