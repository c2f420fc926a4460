"""Visible text of web pages with its layout: a tree with implied tags, then a rendering of it.

The tree builder closes what HTML lets authors leave open (paragraphs, list items, table cells)
and ignores end tags that close nothing. Scripts, styles, the head, closed dialogs and hidden elements
aren't rendered; ``visibility`` is inherited and may be turned on again inside. Text of drawings and formulas
is kept. Blocks start new lines, paragraphs and headings stand apart, list items get a mark and
their level's indent, cells of a table are padded to the width of their column (wide letters count twice), and
preformatted text keeps its blanks. The time grows in proportion to the page, whatever is left open in it.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("textarea title".split())
UNSEEN = frozenset("head script style noscript template iframe noembed noframes object audio video canvas datalist title annotation annotation-xml".split())
#: Parts of a drawing that aren't drawn.
UNDRAWN = frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split())
BLOCKS = frozenset(("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer "
                    "form header hgroup html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul "
                    "h1 h2 h3 h4 h5 h6").split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure".split())
CLOSES_P = BLOCKS - frozenset("body html li option dd dt tbody tfoot thead tr legend summary".split()) | {"hr"}
#: An opening tag ends open elements of these kinds, unless one of the second set is between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, set()),
}
#: Elements that belong to the head; anything else ends it.
HEAD = frozenset("base link meta script style template title noscript".split())
_SCOPE = frozenset("table td th caption button object body html".split())
_NAME_END = re.compile(r"[\s/>]|\Z")
_SPECIAL = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
_LONG_REFERENCE = re.compile(r"&#0*[0-9]{8,};?")
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "visible", "drawn", "level")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        own = _VISIBILITY.findall(attrs.get("style", "")) if attrs else None
        self.visible = own[-1].lower() == "visible" if own else parent is None or parent.visible
        self.drawn = tag == "svg" or parent is not None and parent.drawn
        #: lists and tables from the root to here
        self.level = (parent.level if parent is not None else 0) + (tag in ("ul", "ol", "menu", "table"))


def _unescape(text: str) -> str:
    return html.unescape(_LONG_REFERENCE.sub("\ufffd", text)) if "&" in text else text


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): _unescape(next((g for g in m.groups()[1:] if g is not None), "")) for m in _ATTR.finditer(text)}


class Tree:
    """Builds the element tree of one page; text is a str among the children.

    ``path`` holds the open elements and ``depths`` where in it each kind stands, so that what a tag
    closes is found without climbing.
    """

    def __init__(self):
        self.root = Node("html", {}, None)
        self.path = [self.root]
        self.depths: dict[str, list[int]] = {}

    @property
    def at(self) -> Node:
        return self.path[-1]

    def _pop(self) -> None:
        self.depths[self.path.pop().tag].pop()

    def _deepest(self, kinds) -> int:
        return max((self.depths[k][-1] for k in kinds if self.depths.get(k)), default=0)

    def _close(self, kinds, stop) -> bool:
        depth = self._deepest(kinds)
        if depth <= self._deepest(stop):
            return False
        while len(self.path) > depth:
            self._pop()
        return True

    def open(self, tag: str, attrs: dict, alone: bool) -> None:
        if tag == "html":
            return
        if self.at.tag == "head" and tag not in HEAD:
            self._pop()
        if tag in CLOSES_P:
            self._close({"p"}, _SCOPE)
        if tag in IMPLIED:
            kinds, stop = IMPLIED[tag]
            while self._close(kinds, stop):
                pass
        node = Node(tag, attrs, self.at)
        self.at.children.append(node)
        if not (alone or tag in VOID):
            self.depths.setdefault(tag, []).append(len(self.path))
            self.path.append(node)

    def close(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        stop = {"table"} if tag not in ("table",) and tag not in APART | {"div", "article", "section", "main", "body"} else set()
        self._close({tag}, stop)

    def text(self, value: str) -> None:
        if self.at.tag == "head" and value.strip():
            self._pop()
        if self.at.visible:
            self.at.children.append(value)


class Tags:
    """Finds the tags of one page from left to right.

    Whether a tag that starts at some place ever ends depends only on the first blank after its name and on the
    quotes from there on; places from which no end is reached are remembered, so no part is searched twice.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.name_end = -1
        self.dead: set[int] = set()
        self.first = -1

    def end(self, at: int) -> int:
        """Position of the first ``>`` from ``at`` outside quotes; -1 without one."""
        met = []
        # tags come from left to right: up to the last one's first mark there is none
        if at <= self.first:
            at = self.first
        else:
            m = _SPECIAL.search(self.page, at)
            self.first = at = m.start() if m else len(self.page)
        while True:
            m = _SPECIAL.search(self.page, at)
            if not m or m.start() in self.dead:
                break
            if m[0] == ">":
                return m.start()
            met.append(m.start())
            close = self.page.find(m[0], m.end())
            if close < 0:
                break
            at = close + 1
        self.dead.update(met)
        return -1

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, whether it closes, attributes) of the next tag; comments have no name."""
        page = self.page
        while True:
            start = page.find("<", at)
            if start < 0:
                return None
            at = start + 1
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), "", False, ""
            if start >= self.last:
                start = page.find("<!--", at)
                return (start, len(page), "", False, "") if start >= 0 else None
            if page[at] in "!?":
                return start, page.find(">", at) + 1, "", False, ""
            closes = page[at] == "/"
            name = at + closes
            if not (page[name:name + 1].isascii() and page[name:name + 1].isalpha()):
                continue
            if self.name_end <= name:
                self.name_end = _NAME_END.search(page, name).start()
            end = self.end(self.name_end)
            if end >= 0:
                return start, end + 1, page[name:self.name_end].lower(), closes, page[self.name_end:end]


def build(page: str) -> Node:
    tree, tags, at = Tree(), Tags(page), 0
    while True:
        found = tags.next(at)
        chunk = page[at:found[0] if found else len(page)]
        if chunk:
            tree.text(_unescape(chunk))
        if not found:
            return tree.root
        _, at, tag, closes, inside = found
        if not tag:
            continue
        if closes:
            tree.close(tag)
            continue
        tree.open(tag, _attributes(inside) if inside.strip(" /\n\t") else {},
                  inside.rstrip().endswith("/") and tag not in BLOCKS)
        if tree.at.tag == tag and (tag in RAW or tag in ESCAPABLE):
            end = re.compile(rf"</{tag}[\s/>]|\Z", re.I).search(page, at)
            held = page[at:end.start()]
            tree.text(_unescape(held) if tag in ESCAPABLE else held)
            tree.close(tag)
            close = page.find(">", end.start())
            at = close + 1 if close >= 0 else len(page)


def _hidden(node: Node) -> bool:
    a = node.attrs
    return (node.tag in UNSEEN or node.drawn and node.tag in UNDRAWN or node.tag == "dialog" and "open" not in a
            or bool(a) and ("hidden" in a or bool(_NONE.search(a.get("style", ""))) or (
                node.tag == "input" and a.get("type", "").lower() == "hidden")))


#: Blanks before a cell: a column that starts farther off is reached by this many. It holds for every cell
#: alike, whatever the size of its table, and bounds the blanks by the number of lines in cells.
GAP = 200


class Page:
    """Lines of a rendering; blanks between inline text are collapsed across elements."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False
        self.apart = 0

    def inline(self, text: str) -> None:
        text = _BLANKS.sub(" ", text)
        if text.startswith(" "):
            self.gap, text = self.gap or bool(self.now), text[1:]
        if not text:
            return
        ends = text.endswith(" ")
        text = text.rstrip(" ")
        if self.gap and self.now:
            self.now.append(" ")
        self.now.append(text)
        self.gap = ends

    def line(self, apart: bool = False) -> None:
        if self.now:
            self._put("".join(self.now))
        self.now, self.gap = [], False
        if apart and self.lines:
            self.apart = 1

    def _put(self, text: str) -> None:
        if self.apart and self.lines:
            self.lines.append("")
        self.apart = 0
        self.lines.append(text)

    def verbatim(self, lines: list[str]) -> None:
        self.line()
        for x in lines:
            self._put(x)


def _width(text: str) -> int:
    """Places that a line takes: none for marks that combine, two for wide letters."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _span(cell: Node, name: str, most: int) -> int:
    """The attribute's value within what HTML allows; 1 where it is absent or no number."""
    digits = cell.attrs.get(name, "")
    if not (digits.isascii() and digits.isdecimal()):
        return 1
    return min(int(digits), most) if len(digits) < 10 else most


def _columns(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, list[str]]]]:
    """Cells (lines, columns, rows) with the column at which each starts: places under a cell of several rows are taken."""
    placed: list[list[tuple[int, list[str]]]] = []
    taken: list[tuple[int, int, int]] = []  # from column, to column, first free row
    for r, row in enumerate(rows):
        if not row:
            placed.append([])
            continue
        taken = [x for x in taken if x[2] > r]
        col, k, cells, kept = 0, 0, [], []
        for lines, across, down in row:
            while k < len(taken) and taken[k][0] <= col:
                col = max(col, taken[k][1])
                kept.append(taken[k])
                k += 1
            cells.append((col, lines))
            until = min(r + down, len(rows)) if down else len(rows)
            if until > r + 1:
                if kept and kept[-1][1:] == (col, until):
                    kept[-1] = (kept[-1][0], col + across, until)
                else:
                    kept.append((col, col + across, until))
            col += across
        taken = sorted(kept + taken[k:])
        placed.append(cells)
    return placed


def _table(node: Node) -> list[str]:
    rows: list[list[tuple[list[str], int, int]]] = []
    captions: list[str] = []

    stack: list = list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str) or _hidden(c):
            if isinstance(c, str) and c.strip():
                captions.append(_BLANKS.sub(" ", c).strip())
        elif c.tag == "tr":
            cells: list[tuple[list[str], int, int]] = []
            for d in c.children:
                if isinstance(d, str):
                    if d.strip():
                        cells.append(([_BLANKS.sub(" ", d).strip()], 1, 1))
                elif not _hidden(d):
                    cells.append((_trimmed(_lines(d)), max(_span(d, "colspan", 1000), 1), _span(d, "rowspan", 65534)))
            rows.append(cells)
        elif c.tag in ("caption", "td", "th"):
            captions.extend(_trimmed(_lines(c)))
        else:
            stack.extend(reversed(c.children))
    # a column in which no cell starts takes no place
    widths: dict[int, int] = {}
    placed = _columns(rows)
    for row in placed:
        for col, lines in row:
            widths[col] = max(widths.get(col, 0), max(map(_width, lines), default=0))
    start, left = {}, 0
    for col in sorted(widths):
        start[col], left = left, left + widths[col] + 2
    out = captions
    for row in placed:
        for k in range(max((len(lines) for _, lines in row), default=0)):
            parts, used = [], 0
            for col, lines in row:
                if k < len(lines) and lines[k]:
                    gap = min(max(start[col] - used, 2 if parts else 0), GAP)
                    parts += [" " * gap, lines[k]]
                    used += gap + _width(lines[k])
            out.append("".join(parts))
    return out


def _trimmed(lines: list[str]) -> list[str]:
    """Without blank lines at either end; those between stay."""
    held = [i for i, x in enumerate(lines) if x]
    return lines[held[0]:held[-1] + 1] if held else []


def _lines(node: Node) -> list[str]:
    page = Page()
    _render(node, page)
    page.line()
    return page.lines


def _render(top: Node, page: Page) -> None:
    """Walks without recursion over inline and block elements; lists, tables and quotes are laid out
    on their own, nested ones deeper than 50 levels as plain blocks."""
    stack: list = [(c, 0) for c in reversed(top.children)]
    while stack:
        item, done = stack.pop()
        if isinstance(item, str):
            page.inline(item)
            continue
        tag = item.tag
        if done:
            page.line(tag in APART)
            continue
        if _hidden(item):
            continue
        if tag == "br":
            if not page.now and page.lines:
                page.apart = 1
            page.line()
        elif tag == "hr":
            page.line(True)
        elif tag == "pre":
            page.line(True)
            page.verbatim([x.rstrip() for x in _plain(item).strip("\n").split("\n")])
            page.line(True)
        elif tag == "table" and item.level < 50:
            page.line(True)
            page.verbatim(_table(item))
            page.line(True)
        elif tag in ("ul", "ol", "menu") and item.level < 50:
            page.line(item.parent is None or item.parent.tag != "li")
            page.verbatim(_list(item))
            page.line(item.parent is None or item.parent.tag != "li")
        elif tag in ("td", "th") or item.drawn and tag == "text":
            page.inline(" ")
            stack.extend((c, 0) for c in reversed([*item.children, " "]))
        else:
            if tag in BLOCKS:
                page.line(tag in APART)
                stack.append((item, 1))
            stack.extend((c, 0) for c in reversed(item.children))


def _list(node: Node) -> list[str]:
    out: list[str] = []
    first = node.attrs.get("start", "1")
    n = int(first) if re.fullmatch(r"-?[0-9]{1,9}", first) else 1
    for c in node.children:
        if isinstance(c, str):
            if c.strip():
                out.append("  " + _BLANKS.sub(" ", c).strip())
            continue
        if _hidden(c):
            continue
        lines = _trimmed(_lines(c))
        if c.tag != "li":
            holder = Node("div", {}, None)
            holder.children = [c]
            out += ["  " + x if x else "" for x in _trimmed(_lines(holder))]
            continue
        value = c.attrs.get("value", "")
        n = int(value) if re.fullmatch(r"-?[0-9]{1,9}", value) else n
        mark = f"{n}. " if node.tag == "ol" else "- "
        n += 1
        out += [(mark if i == 0 else " " * len(mark)) + x if x else "" for i, x in enumerate(lines)]
    return out


def _plain(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append("\n")
        elif not _hidden(x):
            stack.extend(reversed(x.children))
    return "".join(out)


def visible_text(page: str | None) -> str | None:
    if page is None:
        return None
    return "\n".join(_lines(build(page.replace("\r\n", "\n").replace("\x00", ""))))


@F.pandas_udf(T.StringType())
def _visible(pages: pd.Series) -> pd.Series:
    return pd.Series([visible_text(p) for p in pages], dtype=object)


def page_text(page: Column) -> Column:
    return _visible(page)


def extract(pages: DataFrame, html_col: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the visible text. NULL stays NULL, an empty page gives ''; rows stay as they
    are, repeated ones too; a column that already has the name is replaced."""
    return pages.withColumn(into, page_text(F.col(html_col)))
