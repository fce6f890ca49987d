"""HTML read as a tree: cleaned, its main part found, written as Markdown.

The tree is built with the standard library's tokenizer. It closes elements
that HTML lets stay open; it doesn't reorder misnested ones as browsers do.
Hidden elements are known by attributes, inline styles and the page's own style
sheets (:mod:`.visibility`); a page without a marked main part has the article
that its paragraphs point to (:mod:`.readability`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from ..functions import kinds as K
from ..functions.markup import PAYWALL_ATTRIBUTES, PAYWALL_CLASSES, PAYWALL_PHRASES
from ..functions.regex import SPACES, Rx, trim_text
from ..functions.rowwise import by_row
from .readability import article, fits
from .visibility import Sheet

#: Elements removed with all they hold.
REMOVED = frozenset(
    "script style noscript iframe frame frameset object embed applet svg math canvas audio video source track map area template slot portal".split()
)
#: Selectors of what is on a page besides its content.
BOILERPLATE = (
    "header:not(article header)", "footer:not(article footer)", "nav", "aside", ".sidebar", ".navigation", ".nav", ".menu", ".header", ".footer",
    ".cookie-banner", ".cookie-consent", ".cookie-notice", ".gdpr", ".advertisement", ".ad", ".ads", ".advert", ".sponsor", ".sponsored", ".promo",
    ".promotion", ".newsletter", ".subscribe", ".subscription", ".social-share", ".share-buttons", ".related-posts", ".related-articles",
    ".recommendations", ".comments", ".comment-section", ".disqus", ".popup", ".modal", ".overlay", ".lightbox", ".toast", ".notification",
    ".alert:not(.alert-important)", '[role="banner"]', '[role="navigation"]', '[role="complementary"]', '[role="contentinfo"]', '[aria-hidden="true"]',
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
#: What an element's start closes, and where the search for it stops.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
_SCHEMES = ("javascript:", "data:", "vbscript:", "file:")
_SPACE = Rx(r"\s+").py


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None) -> None:
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def walk(self) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack += reversed(x.children)
        return "".join(out)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def above(self, tag: str) -> bool:
        node = self.parent
        while node is not None and node.tag != tag:
            node = node.parent
        return node is not None

    def drop(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.at = self.root

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCK:
            self._close({"p"}, {"button", "td", "th", "table", "li", "blockquote"})
        if tag in _CLOSES:
            self._close(*_CLOSES[tag], all_=True)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if self.at.tag == tag and tag not in _VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def _close(self, tags: set[str], stop: set[str], all_: bool = False) -> None:
        node = self.at
        while node.parent is not None and node.tag not in stop:
            if node.tag in tags:
                self.at = node.parent
                if not all_:
                    return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


_SELECTOR = re.compile(r"""(?P<tag>[a-z][a-z0-9]*|\*)?(?P<rest>(?:[.#][\w-]+|\[[\w-]+(?:=["']?[^"'\]]*["']?)?\])*)(?::not\((?P<no>[^)]*)\))?""", re.I)


def selects(selector: str, node: Node) -> bool:
    """Whether a simple selector (tag, class, id, attribute, one ``:not``) or one with an ancestor selects a node.

    Other selectors select nothing.
    """
    if " " in selector and ":not" not in selector:
        before, _, last = selector.rpartition(" ")
        up = node.parent
        while up is not None and not selects(before.strip(), up):
            up = up.parent
        return up is not None and selects(last, node)
    m = _SELECTOR.fullmatch(selector.strip())
    if not m or not m[0]:
        return False
    if m["tag"] not in (None, "*", node.tag):
        return False
    for part in re.findall(r"""[.#][\w-]+|\[[^\]]+\]""", m["rest"] or ""):
        if part[0] == "." and part[1:] not in node.classes():
            return False
        if part[0] == "#" and node.attrs.get("id") != part[1:]:
            return False
        if part[0] == "[":
            name, _, value = part[1:-1].partition("=")
            if name not in node.attrs or (value and node.attrs[name] != value.strip("\"'")):
                return False
    return not (m["no"] and selects(m["no"], node))


def find(root: Node, *selectors: str) -> Node | None:
    return next((n for n in root.walk() if any(selects(s, n) for s in selectors)), None)


def hidden(node: Node, sheet: Sheet) -> bool:
    return sheet.hides(node) or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true" or node.attrs.get("data-hidden") == "true"


def style_sheet(root: Node) -> Sheet:
    """The rules of a page's ``style`` elements."""
    return Sheet("\n".join(n.text() for n in root.walk() if n.tag == "style"), selects)


def sanitize(root: Node, boilerplate: bool = True, remove: tuple[str, ...] = (), preserve: tuple[str, ...] = ()) -> None:
    """Removes what runs, what is around the content and what is hidden; drops event handlers and unsafe links."""
    kept = {id(n) for n in root.walk() if any(selects(s, n) for s in preserve)}

    def spared(node: Node) -> bool:
        while node is not None:
            if id(node) in kept:
                return True
            node = node.parent
        return False

    sheet = style_sheet(root)
    plain = {s for s in BOILERPLATE if re.fullmatch("[a-z]+", s)} if boilerplate else set()
    classes = {s[1:] for s in BOILERPLATE if re.fullmatch(r"\.[\w-]+", s)} if boilerplate else set()
    odd = [s for s in (BOILERPLATE if boilerplate else ()) if not re.fullmatch(r"\.?[\w-]+", s)] + list(remove)
    for node in list(root.walk()):
        out = node.tag in REMOVED or node.tag in plain or not classes.isdisjoint(node.classes()) or hidden(node, sheet) or any(selects(s, node) for s in odd)
        if out and not spared(node):
            node.drop()
    for node in root.walk():
        for name in list(node.attrs):
            value = node.attrs[name].lower().strip()
            if name.startswith("on") or name == "style" or (name in ("href", "src", "action", "formaction") and value.startswith(_SCHEMES)):
                del node.attrs[name]


def paywalled(root: Node) -> bool:
    if any(not set(PAYWALL_CLASSES).isdisjoint(n.classes()) or any(a in n.attrs for a in PAYWALL_ATTRIBUTES) for n in root.walk()):
        return True
    text = (find(root, "body") or root).text().lower()
    return any(p in text for p in PAYWALL_PHRASES)


# --- Markdown -------------------------------------------------------------------


class _Writer:
    def __init__(self, tables: bool, code: bool) -> None:
        self.tables, self.code = tables, code

    def children(self, node: Node) -> str:
        """Blocks apart by blank lines, text between them on one line."""
        out = ""
        for c in node.children:
            piece = _SPACE.sub(" ", _escaped(c)) if isinstance(c, str) else self.element(c)
            if isinstance(c, Node) and c.tag in _BLOCK:
                piece = piece.strip("\n")
                if piece.strip(SPACES):
                    out = f"{out.rstrip(SPACES)}\n\n{piece}\n\n"
            else:
                out += piece.lstrip(" ") if out.endswith(("\n", " ")) or not out else piece
        return out

    def element(self, node: Node) -> str:
        tag = node.tag
        if tag == "pre":
            if not self.code:
                return "[Code block removed]"
            inner = find(node, "code")
            language = re.search(r"language-(\w+)", " ".join(inner.classes())) if inner else None
            return f"```{language[1] if language else ''}\n{node.text()}\n```"
        if tag == "table":
            return self.table(node) if self.tables else "[Table content removed]"
        if tag == "br":
            return "  \n"
        if tag == "hr":
            return "* * *"
        if tag == "img":
            src, alt = node.attrs.get("src", ""), node.attrs.get("alt", "")
            return f"![{alt}]({src})" if src else ""
        if tag == "code":
            text = node.text()
            return f"`{text}`" if text.strip() else ""
        inside = self.children(node)
        bare = trim_text(inside)
        if not bare:
            return " " if inside and tag not in _BLOCK else ""
        if tag[0] == "h" and tag[1:].isdigit():
            return f"{'#' * int(tag[1:])} {_SPACE.sub(' ', bare)}"
        if tag in ("strong", "b", "em", "i", "del", "s", "strike"):
            mark = {"strong": "**", "b": "**", "em": "*", "i": "*"}.get(tag, "~")
            return f"{' ' * inside.startswith(' ')}{mark}{bare}{mark}{' ' * inside.endswith(' ')}"
        if tag == "a" and node.attrs.get("href"):
            return f"[{bare}]({node.attrs['href']})"
        if tag == "blockquote":
            return "\n".join(f"> {x}".rstrip() for x in bare.split("\n"))
        if tag in ("ul", "ol"):
            return self.items(node)
        return bare if tag in _BLOCK else inside

    def items(self, node: Node) -> str:
        lines, number = [], int(node.attrs.get("start") or 1) if (node.attrs.get("start") or "1").isdigit() else 1
        for item in node.children:
            if not isinstance(item, Node):
                continue
            mark = f"{number}.  " if node.tag == "ol" else "-   "
            number += 1
            body = re.sub(r"\n{2,}(?=[ ]*(?:-|\d+\.) )", "\n", trim_text(self.children(item)))
            lines.append(mark + body.replace("\n", "\n" + " " * 4))
        return "\n".join(lines)

    def table(self, node: Node) -> str:
        """A header row, a rule and the rows, all as wide as the widest; without header cells the first row heads."""
        rows = [n for n in node.walk() if n.tag == "tr" and _nearest(n, "table") is node]
        cells = [[_SPACE.sub(" ", trim_text(c.text())).replace("|", "\\|") for c in r.walk() if c.tag in ("td", "th") and _nearest(c, "tr") is r] for r in rows]
        width = max(map(len, cells), default=0)
        if not width:
            return ""
        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in cells]
        return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def _nearest(node: Node, tag: str) -> Node | None:
    up = node.parent
    while up is not None and up.tag != tag:
        up = up.parent
    return up


def _escaped(text: str) -> str:
    return re.sub(r"([\\*_`\[\]])", r"\\\1", text)


def to_markdown(node: Node, tables: bool = True, code: bool = True) -> str:
    return _Writer(tables, code).children(node)


def tidy(text: str) -> str:
    for pattern, by in ((r"\n{3,}", "\n\n"), (r"(?m)[ \t]+$", ""), (r"(?m)^[•◦▪▸►]\s*", "- "), (r"\[([^\]]+)\]\(\s*\)", r"\1"), (r"(?m)^#{1,6}[ \t]*$", "")):
        text = re.sub(pattern, by, text)
    return trim_text(text)


def _attribute(root: Node, name: str, *selectors: str) -> str:
    for s in selectors:
        node = find(root, s)
        if node is not None and node.attrs.get(name):
            return node.attrs[name]
    return ""


def extract(html: str, remove: tuple[str, ...] = (), tables: bool = True, code: bool = True) -> dict:
    """Title, Markdown, text and metadata of a page: of ``main``, ``article`` or the main role, else of the article found, if it fits, else of its body."""
    root = parse(html)
    warnings = ["Content appears to be paywalled"] if (wall := paywalled(root)) else []
    sanitize(root, remove=tuple(remove))
    body = find(root, "body") or root
    main, read_words = find(root, "main", "article", '[role="main"]'), None
    whole_words = len((main or body).text().split())
    if main is None:
        main, parts = body, article(body)
        read_words = sum(len(p.text().split()) for p in parts)
        if fits(whole_words, read_words):
            main = Node("div")
            main.children = parts
    title = find(root, "title")
    page = find(root, "html")
    return dict(
        title=_attribute(root, "content", '[property="og:title"]') or (trim_text(title.text()) if title else ""),
        site_name=_attribute(root, "content", '[property="og:site_name"]'),
        author=_attribute(root, "content", '[name="author"]', '[property="article:author"]'),
        published_at=_attribute(root, "content", '[property="article:published_time"]') or _attribute(root, "datetime", "time[datetime]"),
        language=page.attrs.get("lang", "") if page else "",
        markdown=tidy(to_markdown(main, tables, code)), text=main.text(), excerpt=main.text()[:200], paywalled=wall, warnings=warnings, whole_words=whole_words, read_words=read_words,
    )


EXTRACTED = K.struct(
    title=K.STRING, site_name=K.STRING, author=K.STRING, published_at=K.STRING, language=K.STRING, markdown=K.STRING, text=K.STRING,
    excerpt=K.STRING, paywalled=K.BOOL, warnings=K.STRINGS, whole_words=K.LONG, read_words=K.LONG,
)


def extract_column(html, remove: tuple[str, ...] = (), tables: bool = True, code: bool = True):
    """:func:`extract` as a column of structs; null for null."""

    @by_row(EXTRACTED)
    def run(page: str | None) -> dict:
        return extract(page, remove, tables, code) if isinstance(page, str) else dict.fromkeys(EXTRACTED.names)

    return run(html)
