"""Layout-aware text of HTML pages.

A tree builder with implied end tags reads the markup, visibility rules drop what a browser would
not show, and a renderer writes all visible text: blocks on lines of their own, paragraphs set apart
by an empty line, list items with their mark and indent, table cells padded to columns.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Generator, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard, by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe object embed svg math canvas audio video datalist noembed noframes area base link meta param source track title dialog".split())
BLOCK = frozenset("address article aside blockquote body center details dd dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table ul caption tr thead tbody tfoot select".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr menu dir".split())
#: Start tags that close an open p.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
#: A start tag closes an open element of these, up to the given boundaries.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
}
#: End tags do not reach out of these.
SCOPE = frozenset("table td th caption button template".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)|([^<]+|<)", re.S)
_SPECIAL = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_GONE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|content-visibility\s*:\s*hidden)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
#: Selectors of style rules that are followed: a name, classes and an id on one element.
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str] | None = None) -> None:
        self.name, self.attrs, self.children = name, attrs or {}, []


class Ends:
    """Where tags end: at the first > outside quotes, or with the page; a tag whose quote stays open is none.

    Work is linear in the page, whatever is in it: quotes from which no tag can end are remembered, and so is
    the sign that was found next.
    """

    def __init__(self, html: str) -> None:
        self.html, self.failed = html, set()
        self.seen, self.next = 0, -1  # from seen on, the next sign is at next

    def _special(self, at: int) -> int:
        if not self.seen <= at <= self.next:
            m = _SPECIAL.search(self.html, at)
            self.seen, self.next = at, m.start() if m else len(self.html)
        return self.next

    def of(self, at: int) -> int | None:
        """The place of the > that ends a tag whose attributes begin here, the page's length, or None."""
        passed, n = [], len(self.html)
        while True:
            i = self._special(at)
            if i == n or self.html[i] == ">":
                return i
            passed.append(i)
            close = -1 if i in self.failed else self.html.find(self.html[i], i + 1)
            if close < 0:
                self.failed.update(passed)
                return None
            at = close + 1


class Open:
    """The stack of open elements, with the places of each name in it, so that no tag walks through it."""

    def __init__(self) -> None:
        self.root = Node("#root")
        self.nodes, self.at, self.scopes = [self.root], {}, [0]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.name, []).append(len(self.nodes))
        if node.name in SCOPE:
            self.scopes.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, to: int) -> None:
        """Closes the element at this place and all in it."""
        while len(self.nodes) > to:
            name = self.nodes.pop().name
            self.at[name].pop()
            if name in SCOPE:
                self.scopes.pop()

    def last(self, name: str) -> int:
        """The place of the innermost element of a name; 0 for none."""
        places = self.at.get(name)
        return places[-1] if places else 0

    def begin(self, name: str) -> None:
        """Closes what a start tag of this name closes."""
        if name in IMPLIED:
            names, stops = IMPLIED[name]
            stop = max(map(self.last, stops))
            if name in ("li", "dd", "dt", "option", "td", "th"):  # the innermost one
                place = max(map(self.last, names))
            else:  # all up to the boundary
                inside = (self.at[x][bisect_right(self.at[x], stop)] for x in names if self.last(x) > stop)
                place = min(inside, default=0)
            if place > stop:
                self.cut(place)
        if name in CLOSES_P and (place := self.last("p")) > self.scopes[-1]:
            self.cut(place)

    def end(self, name: str) -> None:
        top = self.nodes[-1].children
        if name == "br":
            top.append(Node("br"))
            return
        place = self.last(name)
        if place and (place >= self.scopes[-1] or name in ("table", "tr", "tbody", "thead", "tfoot", "td", "th")):
            self.cut(place)
        elif name == "p":  # a lone </p> is an empty paragraph
            top.append(Node("p"))


def parse(html: str) -> Node:
    """A tree of Nodes and strings; unclosed and misnested tags are repaired, nothing raises. Time is linear in the
    page's length, also where quotes and tags stay open: a tag whose quote is never closed is text."""
    open_, ends = Open(), Ends(html)
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.match(html, at)
        begun, at = at, m.end()
        top = open_.nodes[-1].children
        text = m.group(4)
        if text is not None:
            top.append(unescape(text))
            continue
        if m.group(1) is not None:
            top.append(m.group(1))
            continue
        name = m.group(3)
        if name is None:
            continue
        end = ends.of(at)
        if end is None:
            top.append("<")
            at = begun + 1
            continue
        raw, at = html[at:end], min(end + 1, n)
        name = name.lower()
        if m.group(2):
            open_.end(name)
            continue
        attrs = {k.lower(): unescape(a or b or c) for k, a, b, c in reversed(_ATTRIBUTE.findall(raw))} if raw.strip(" \n\t/") else {}
        open_.begin(name)
        node = Node(name, attrs)
        open_.nodes[-1].children.append(node)
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            body = html[at : close.start() if close else n]
            node.children.append(unescape(body) if name in ("textarea", "title") else body)
            at = close.end() if close else n
            continue
        if name == "plaintext":
            node.children.append(html[at:])
            break
        open_.push(node)
    return open_.root


class Styles:
    """What the page's style elements say of display and visibility, by simple selectors: element names, classes and
    ids of one element, in lists. Rules inside @media and the like, other selectors and style sheets of
    other files are not read; a later rule wins over an earlier one, whatever its weight, and a style attribute over both."""

    def __init__(self, root: Node) -> None:
        self.rules: list[tuple[str, frozenset[str], str, str]] = []
        stack = [root]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                continue
            if node.name == "style":
                self._read(_COMMENT.sub("", "".join(c for c in node.children if isinstance(c, str))))
            stack.extend(reversed(node.children))

    def _read(self, css: str) -> None:
        plain, depth = [], 0  # nested blocks are cut out, with the @rule that opens them
        for part in re.split(r"(@[^{};]*(?:;|\{)|[{}])", css):
            if part.startswith("@"):
                depth += part.endswith("{")
            elif depth:
                depth += (part == "{") - (part == "}")
            else:
                plain.append(part)
        for selectors, body in _RULE.findall("".join(plain)):
            if not (_GONE.search(body) or _VISIBILITY.search(body) or re.search(r"(?:^|;)\s*display\s*:", body, re.I)):
                continue
            for one in selectors.split(","):
                if (m := _SELECTOR.fullmatch(one.strip())) and one.strip():
                    names = re.findall(r"[.#][\w-]+", m[2])
                    self.rules.append(((m[1] or "*").lower(), frozenset(n[1:] for n in names if n[0] == "."), next((n[1:] for n in names if n[0] == "#"), ""), body))

    def of(self, node: Node) -> list[str]:
        """Declarations that hold for a node, the strongest last."""
        a = node.attrs
        found = []
        if self.rules:
            classes = set(a.get("class", "").split())
            found = [body for name, want, id_, body in self.rules if name in ("*", node.name) and want <= classes and id_ in ("", a.get("id", ""))]
        return [*found, a["style"]] if "style" in a else found


def hidden(node: Node, styles: Styles | None = None) -> bool:
    """Whether a node and all in it go: by its element, an attribute or display."""
    a, gone = node.attrs, False
    for body in styles.of(node) if styles else [a["style"]] if "style" in a else ():
        if _GONE.search(body):
            gone = True
        elif re.search(r"(?:^|;)\s*display\s*:", body, re.I):
            gone = False
    return (
        gone
        or node.name in HIDDEN and not (node.name == "dialog" and "open" in a)
        or "hidden" in a
        or node.name == "input" and a.get("type", "").lower() == "hidden"
    )


def unseen(node: Node, styles: Styles, before: bool) -> bool:
    """Whether a node's own text is invisible; nodes in it may be made visible again."""
    for body in styles.of(node):
        if m := _VISIBILITY.search(body):
            before = m[1].lower() != "visible"
    return before


class Lines:
    """Text under construction: lines, with pending spaces and empty lines. Text comes to nothing while unseen."""

    def __init__(self, styles: Styles, unseen: bool = False) -> None:
        self.styles, self.unseen = styles, unseen
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0  # line breaks asked for before the next text
        self.indent, self.mark = "", ""

    def text(self, s: str, keep: bool = False) -> None:
        if self.unseen:
            return
        if keep:
            for i, part in enumerate(s.replace("\r\n", "\n").split("\n")):
                if i:
                    self.line()
                if part:
                    self._put(part)
            return
        for i, word in enumerate(_SPACE.split(s)):
            if i:
                self.space = True
            if word:
                self._put((" " if self.space and self.now else "") + word)
                self.space = False

    def _put(self, s: str) -> None:
        if not self.now:
            if self.lines and self.gap > 1 and self.lines[-1]:
                self.lines.append("")
            self.now.append(self.indent + self.mark)
            if self.mark:
                self.indent += " " * len(self.mark)
                self.mark = ""
        self.gap = 0
        self.now.append(s)

    def line(self) -> None:
        """A forced break (br)."""
        self.lines.append("".join(self.now).rstrip(" "))
        self.now, self.space = [], False

    def block(self, gap: int) -> None:
        if self.now:
            self.line()
        self.gap = max(self.gap, gap)
        self.space = False

    def done(self) -> str:
        self.block(1)
        return "\n".join(self.lines).strip("\n")


def _width(s: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


#: Rendering of a part: yields that of each part inside it, for _run.
Steps = Generator["Steps"]


def _run(steps: Steps) -> None:
    """Carries out steps on a stack of its own, so pages may be nested as deeply as they like."""
    stack = [steps]
    while stack:
        if (inner := next(stack[-1], None)) is None:
            stack.pop()
        else:
            stack.append(inner)


def _table(node: Node, out: Lines) -> Steps:
    """Rows of cells; each column is as wide as its widest cell, cells part by two spaces."""
    rows: list[list[list[str]]] = []
    carried: dict[int, int] = {}  # column: rows that a cell from above still covers

    def visit(at: Node) -> Steps:
        for c in at.children:
            if isinstance(c, str):
                if c.strip():
                    out.text(c)
            elif hidden(c, out.styles):
                continue
            elif c.name == "tr":
                cells: list[list[str]] = []
                covered, carried_now = set(carried), {}
                for d in c.children:
                    if isinstance(d, str):
                        if d.strip() and not out.unseen:
                            cells.append([" ".join(d.split())])
                        continue
                    if hidden(d, out.styles):
                        continue
                    while len(cells) in covered:
                        cells.append([""])
                    inner = Lines(out.styles, unseen(c, out.styles, out.unseen))
                    yield _render(d, inner, as_cell=True)
                    span = int(d.attrs["colspan"]) if d.attrs.get("colspan", "").isdecimal() else 1
                    down = int(d.attrs["rowspan"]) if d.attrs.get("rowspan", "").isdecimal() else 1
                    for k in range(min(max(span, 1), 1000)):
                        if down > 1:
                            carried_now[len(cells)] = min(down, 65534) - 1
                        cells.append(inner.done().split("\n") if not k else [""])
                for k in covered:  # a row goes by, whether or not it has cells beyond the covered column
                    carried[k] -= 1
                    if not carried[k]:
                        del carried[k]
                carried.update(carried_now)
                rows.append(cells)
            elif c.name in ("thead", "tbody", "tfoot", "colgroup"):
                yield visit(c)
            elif c.name == "caption":
                out.block(1)
                yield _children(c, out)
                out.block(1)
            else:
                yield _render(c, out)

    yield visit(node)
    out.block(1)
    wide = max(map(len, rows), default=0)
    widths = [max((_width(x) for r in rows if k < len(r) for x in r[k]), default=0) for k in range(wide)]
    for r in rows:
        for i in range(max(map(len, r), default=0)):
            parts = [(c[i] if i < len(c) else "") for c in r]
            line = "  ".join(p + " " * (w - _width(p)) for p, w in zip(parts, widths, strict=False)).rstrip()
            if line.strip():
                out.text(line, keep=True)
                out.block(1)


def _children(node: Node, out: Lines, keep: bool = False) -> Steps:
    for c in node.children:
        if isinstance(c, str):
            out.text(c, keep)
        else:
            yield _render(c, out, keep)


def _render(node: Node, out: Lines, keep: bool = False, as_cell: bool = False) -> Steps:
    name = node.name
    if hidden(node, out.styles):
        return
    before, out.unseen = out.unseen, unseen(node, out.styles, out.unseen)
    yield _visible(node, out, keep, as_cell)
    out.unseen = before


def _visible(node: Node, out: Lines, keep: bool, as_cell: bool) -> Steps:
    name = node.name
    if name == "br":
        out.line()
        return
    if name == "hr":
        out.block(2)
        return
    if name == "img":
        if alt := node.attrs.get("alt", "").strip():
            out.text(alt)
        return
    if name == "input":
        if node.attrs.get("type", "text").lower() in ("button", "submit", "reset", "text", "") and (v := node.attrs.get("value", "").strip()):
            out.text(f" {v} ")
        return
    if name == "wbr":
        return
    gap = 0 if as_cell or name not in BLOCK else 2 if name in SPACED else 1
    nested = name in ("ul", "ol", "menu", "dir") and bool(out.indent)
    if gap:
        out.block(1 if nested else gap)
    held = out.indent
    if name == "table":
        yield _table(node, out)
    elif name in ("ul", "ol", "menu", "dir"):
        start = node.attrs.get("start", "")
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
        for c in node.children:
            if isinstance(c, str):
                out.text(c, keep)
                continue
            if c.name == "li" and not hidden(c, out.styles):
                out.block(1)
                before, seen = out.indent, out.unseen
                out.unseen = unseen(c, out.styles, seen)
                out.mark = f"{number}. " if name == "ol" else "- "
                number += name == "ol"
                yield _children(c, out, keep)
                out.block(1)
                out.mark, out.indent, out.unseen = "", before, seen
            else:
                yield _render(c, out, keep)
    else:
        if name in ("blockquote", "dd"):
            out.indent += "    "
        if name == "q":
            out.text('"')
        yield _children(node, out, keep or name in ("pre", "textarea", "listing"))
        if name == "q":
            out.text('"')
    if gap:
        out.block(1 if nested else gap)
    out.indent = held


def visible_text(html: str | None) -> str:
    """All visible text of a page; empty for null, empty and wholly hidden pages."""
    if not html:
        return ""
    root = parse(html)
    out = Lines(Styles(root))
    _run(_children(root, out))
    return out.done()


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, title (of the first title element, spaces collapsed), text.

    Null and empty pages give empty texts. Repeated rows give repeated rows; an empty table none. Malformed tags and
    attributes are read as far as they go, and a page may be of any length and nested to any depth. Style
    rules hide what simple selectors name (see Styles).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages_ = [x.as_py() for x in b.column(1)]
            titles = [" ".join(unescape(m[1]).split()) if p and (m := re.search(r"<title[^>]*>(.*?)</title", p, re.S | re.I)) else "" for p in pages_]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(titles, pa.string()), pa.array(map(visible_text, pages_), pa.string())], names=["page_id", "title", "text"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, title string, text string")
