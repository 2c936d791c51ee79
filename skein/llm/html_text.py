"""HTML extraction by layout-aware rendering (operator 3).

A tree is built from the tags with the end tags that HTML implies (a paragraph ends where a block begins, a list item
where the next begins, a cell or row likewise, a head where its body begins). What HTML or inline CSS hides is left out,
and ends by the same rules: hidden elements and those of ``display:none`` with all that is in them; ``visibility:hidden``
up to where a descendant is made visible again; of svg all but its text elements. All other text is emitted, options of
a select, formulas and an object's fallback among it.

Blocks stand on lines of their own, paragraphs, headings, lists and tables with an empty line around them; list items
get a bullet or number and are indented by level; cells of a table's column are aligned, with regard to cells that span
columns or rows. A column is as wide as the widest of its cells of at most ``WIDEST`` characters; longer cells stand whole.

Time and memory are in proportion to the page: tags are scanned forwards once, the open elements that a tag may end are
looked up, not searched, and rendering keeps a stack of its own, so nesting may have any depth.

Defined results: null and empty html give ''. Unclosed and stray tags are tolerated; a ``<`` that begins no tag, or a tag
without ``>``, is text. Repeated rows are rendered one by one; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import slices

WIDEST = 40
#: HTML's own limits for the columns and rows of a cell.
COLUMNS, ROWS = 1_000, 65_534

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style template noscript noembed noframes iframe canvas audio video datalist".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes template xmp".split())
#: Parts of svg and math that aren't shown.
UNDRAWN = frozenset("defs symbol clippath mask pattern marker desc metadata annotation annotation-xml".split())
#: What a head may hold; any other tag ends it.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Tags that end an svg or math which they stand in.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog div dt figcaption footer form header html legend li main nav section summary caption".split())
#: Lines of their own that end no paragraph.
LINES = BLOCK | {"select", "option", "optgroup", "text"}
GROUPS = frozenset({"thead", "tbody", "tfoot"})
LISTS = frozenset({"ul", "ol"})

_OPAQUE = (HIDDEN - {"head"}) | {"svg", "math", "object", "select"}
_SPECIAL = BLOCK | frozenset("td th tr thead tbody tfoot object select svg math html head".split())
#: Classes of tags behind which nothing is ended.
_BEHIND = {
    "#list": LISTS | _OPAQUE,
    "#terms": _OPAQUE | {"dl"},
    "#select": (_OPAQUE - {"select"}) | {"select"},
    "#table": _OPAQUE | {"table"},
    "#around-p": BLOCK | _OPAQUE | {"td", "th"},
    "#cells": frozenset({"table"}),
    "#special": _SPECIAL | {"table"},
    "#rows": frozenset({"tr", "table"}),
}
#: A tag, the open tags that it ends, and the class behind which they stay.
_ENDS = {
    "li": (("li",), "#list"), "dt": (("dt", "dd"), "#terms"), "dd": (("dt", "dd"), "#terms"),
    "option": (("option",), "#select"), "optgroup": (("option", "optgroup"), "#select"),
    "td": (("td", "th"), "#table"), "th": (("td", "th"), "#table"), "tr": (("tr",), "#table"),
    "thead": (tuple(GROUPS), "#table"), "tbody": (tuple(GROUPS), "#table"), "tfoot": (tuple(GROUPS), "#table"),
}

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_GONE = re.compile(r"display\s*:\s*none")
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class _Classes(dict):
    def __missing__(self, tag: str) -> tuple[str, ...]:
        value = (tag, *(c for c, tags in _BEHIND.items() if tag in tags))
        if len(self) < 10_000:
            self[tag] = value
        return value


_CLASSES = _Classes()


class Node:
    """An open or closed element. ``gone``: not shown, with all in it; ``seen``: its own text is visible; ``kind``: in svg,
    in math or in neither; ``rows``: a row of a table is in it."""

    __slots__ = ("children", "columns", "down", "gone", "kind", "rows", "seen", "start", "tag", "up")

    def __init__(self, tag: str, up: Node | None = None):
        self.tag, self.up, self.children, self.start, self.columns, self.down, self.rows = tag, up, [], 1, 1, 1, False
        self.gone, self.seen, self.kind = (up.gone, up.seen, up.kind) if up else (False, True, "")


def tokens(page: str) -> Iterator[tuple[str, str, int, int]]:
    """(name, attributes, start, end) of each tag, comment ('') or declaration (''), in order; a name begins with / at an end tag.

    ``send`` a position to go on from there (behind raw text)."""
    at, size, unpaired = 0, len(page), set()
    while at < size and (start := page.find("<", at)) >= 0:
        if page.startswith(("!", "?"), start + 1):
            comment = page.startswith("<!--", start)
            end = page.find("-->" if comment else ">", start + (4 if comment else 2))
            name, raw, end = "", "", size if end < 0 else end + (3 if comment else 1)
        elif found := _NAME.match(page, start + 1):
            end = found.end()
            while stop := _STOP.search(page, end):
                end = stop.end()
                if stop[0] == ">":
                    break
                before = end - 2  # a quote opens a value only behind =
                while page[before].isspace():
                    before -= 1
                if page[before] == "=" and stop[0] not in unpaired:
                    close = page.find(stop[0], end)
                    if close < 0:
                        unpaired.add(stop[0])
                    else:
                        end = close + 1
            if not stop:  # no tag ends any more
                return
            name, raw = page[start + 1 : found.end()].lower(), page[found.end() : end - 1]
        else:
            at = start + 1
            continue
        at = (yield name, raw, start, end) or end


def _number(text: str, least: int, most: int, default: int = 1) -> int:
    text = text.strip()
    return min(max(int(text), least), most) if text.lstrip("-").isdecimal() and len(text) < 10 else default


def tree(page: str) -> Node:
    """The visible part of the page: nodes with children that are nodes or strings.

    A hidden element is open like any other, so that the same end tags are implied in it, but is no child of its parent."""
    root = Node("body")
    stack, where, at = [root], {}, 0

    def text(raw: str) -> None:
        if not raw:
            return
        if stack[-1].tag == "head" and raw.strip(" \t\n\r\f"):
            cut(len(stack) - 1)
        top = stack[-1]
        if not top.gone and top.seen and top.kind != "svg":
            top.children.append(html.unescape(raw) if "&" in raw else raw)

    def push(node: Node) -> None:
        for c in _CLASSES[node.tag]:
            where.setdefault(c, []).append(len(stack))
        stack.append(node)

    def cut(i: int) -> None:
        while len(stack) > i:
            for c in _CLASSES[stack.pop().tag]:
                where[c].pop()

    def last(names) -> int:
        return max((w[-1] for n in names if (w := where.get(n))), default=0)

    def close(tags, *behind: str) -> None:
        i = last(tags)
        if i and i >= last(behind):
            cut(i)

    def child(node: Node) -> None:
        if not node.gone:
            node.up.children.append(node)
            if node.tag == "tr":
                up = node.up
                while up is not None and not up.rows and up.tag != "table":
                    up.rows, up = True, up.up

    found = tokens(page)
    step, go = next(found, None), None
    while step:
        name, raw, start, end = step
        text(page[at:start])
        at, go = end, None
        if name.startswith("/"):
            tag, top = name[1:], stack[-1]
            if tag == "p" and not top.gone and not where.get("p"):
                child(Node("p", top))
            behind = () if tag in ("table", "body", "html") else ("#cells",)
            close((tag,), *behind, *(("#special",) if top.gone and tag not in _SPECIAL else ()))
        elif name:
            go = opened(name, raw, page, end, stack, push, cut, close, last, child, text)
            at = go or end
        try:
            step = found.send(go)
        except StopIteration:
            step = None
    text(page[at:])
    return root


def opened(tag: str, raw: str, page: str, end: int, stack, push, cut, close, last, child, text) -> int | None:
    """A start tag; the position behind its raw text, if it has such."""
    attributes = {}
    if "=" in raw or "hidden" in raw.lower() or tag == "dialog":
        attributes = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}
    if stack[-1].kind and tag in BREAKOUT:
        cut(last(("svg", "math")))
    if tag in BLOCK:
        close(("p",), "#around-p")
    if tag in _ENDS:
        if tag in GROUPS:
            close(("tr",), "#table")
        close(_ENDS[tag][0], _ENDS[tag][1])
        if tag in ("td", "th") and (i := last(("#rows",))) and stack[i].tag == "table":
            row = Node("tr", stack[-1])
            child(row)
            push(row)
    if tag == "body" or (stack[-1].tag == "head" and tag not in IN_HEAD):
        close(("head",))
    top = stack[-1]
    node = Node(tag, top)
    style = attributes.get("style", "").lower() if attributes else ""
    if tag in HIDDEN or (top.kind and tag in UNDRAWN) or "hidden" in attributes or (tag == "dialog" and "open" not in attributes) or _GONE.search(style):
        node.gone = True
    if shown := _VISIBILITY.findall(style):
        node.seen = shown[-1] == "visible"
    if tag in ("svg", "math"):
        node.kind = tag
    elif top.kind == "svg" and tag in ("text", "foreignobject"):
        node.kind = "drawn" if tag == "text" else ""
    if (node.kind or top.kind) and raw.endswith("/"):
        return None
    if tag in RAW and not top.kind:
        stop = _RAW_END[tag].search(page, end)
        if not node.gone:
            child(node)
            push(node)
            text(page[end : stop.start() if stop else len(page)])
            cut(len(stack) - 1)
        return stop.end() if stop else len(page)
    if tag in VOID:
        child(node)
        return None
    if tag in ("html", "body") and not node.gone and node.seen:
        return None
    if attributes:
        node.start = _number(attributes.get("start", ""), -(10**9), 10**9) if tag == "ol" else 1
        if tag in ("td", "th"):
            node.columns = _number(attributes.get("colspan", ""), 1, COLUMNS)
            node.down = _number(attributes.get("rowspan", ""), 0, ROWS) or ROWS
    child(node)
    push(node)
    return None


class Lines:
    """Collects lines of text with pending blanks and breaks."""

    def __init__(self):
        self.lines: list[str] = []
        self.now, self.indent, self.mark, self.gap = [], "", "", False

    def add(self, text: str) -> None:
        text = _BLANKS.sub(" ", text)
        if not self.now or self.now[-1].endswith(" "):
            text = text.lstrip(" ")
        if text:
            self.now.append(text)

    def end(self, spaced: bool = False) -> None:
        if line := "".join(self.now).rstrip(" "):
            self.put(line)
        self.now = []
        self.gap |= spaced

    def put(self, line: str) -> None:
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        indent = self.indent[: len(self.indent) - len(self.mark)] if self.mark else self.indent
        self.lines.append(indent + self.mark + line)
        self.mark = ""

    def begin(self, indent: str, mark: str) -> None:
        self.end()
        self.indent, self.mark = indent, mark


def _parts(table: Node) -> Iterator[Node | str]:
    """Rows of the table, whatever they are wrapped in, and all that is no row."""
    todo = list(reversed(table.children))
    while todo:
        node = todo.pop()
        if isinstance(node, Node) and (node.tag in GROUPS or (node.tag not in ("tr", "table") and node.rows)):
            todo.extend(reversed(node.children))
        else:
            yield node


def _aligned(rows: list[list[tuple[int, int, Lines]]], out: Lines) -> None:
    """Put the rows of a table; a row is a list of (column, columns that it spans, lines)."""
    first = sorted({column for cells in rows for column, _, _ in cells})  # columns in which no cell begins take no room
    wide = [0] * len(first)
    placed = []
    for cells in rows:
        placed.append([])
        for column, columns, own in cells:
            i, j = bisect_left(first, column), bisect_left(first, column + columns)
            placed[-1].append((i, j, own.lines or [""]))
            if j - i == 1:
                wide[i] = max([wide[i], *(len(x) for x in own.lines if len(x) <= WIDEST)])
    before = [0]
    for w in wide:
        before.append(before[-1] + w + 3)
    for cells in placed:
        for k in range(max((len(lines) for _, _, lines in cells), default=0)):
            parts, at = [], 0
            for i, j, lines in cells:
                parts.extend(" " * w for w in wide[at:i])
                line = lines[k] if k < len(lines) else ""
                parts.append(line.ljust(before[j] - before[i] - 3) if j < len(first) else line)
                at = j
            line = " | ".join(parts)
            if line.strip(" |"):
                out.put(line.rstrip(" "))
    out.end(True)


def _table(node: Node, out: Lines, todo: list[tuple]) -> None:
    """Work for a table, in reverse: captions and stray content, the cells into lines of their own, the alignment."""
    out.end(True)
    work: list[tuple] = []
    rows: list[list[tuple[int, int, Lines]]] = []
    busy: list[tuple[int, int, int]] = []  # columns taken from above: first, behind the last, until row
    parts = list(_parts(node))
    for part in parts:
        if isinstance(part, str) or part.tag != "tr":
            work += [(_open, part, out), (Lines.end, out)]
    for part in parts:
        if isinstance(part, str) or part.tag != "tr":
            continue
        cells, column, down = [], 0, []
        busy = sorted(b for b in busy if b[2] > len(rows))
        taken = iter(busy)
        block = next(taken, None)
        for cell in part.children:
            own, inner, columns = Lines(), [cell], 1
            if isinstance(cell, Node) and cell.tag in ("td", "th"):
                inner, columns = cell.children, cell.columns
            elif isinstance(cell, str) and not cell.strip(" \t\n\r\f"):
                continue
            work += [(_open, c, own) for c in inner]
            work.append((Lines.end, own))
            while block and block[0] <= column:
                column, block = max(column, block[1]), next(taken, None)
            cells.append((column, columns, own))
            if isinstance(cell, Node) and cell.down > 1:
                down.append((column, column + columns, len(rows) + cell.down))
            column += columns
        busy += down
        rows.append(cells)
    todo.append((_aligned, rows, out))
    todo.extend(reversed(work))


def _open(node: Node | str, out: Lines, todo: list[tuple]) -> None:
    """Render a node: what is to be done after it and for its children goes on the stack ``todo``."""
    if isinstance(node, str):
        out.add(node)
        return
    tag = node.tag
    if tag == "br":
        out.end()
        return
    if tag == "table":
        _table(node, out, todo)
        return
    if tag == "pre":
        out.end(True)
        for line in _plain(node).strip("\n").split("\n"):
            out.put(line.rstrip()) if line.strip() else out.lines.append("")
        out.end(True)
        return
    spaced = tag in SPACED and not (tag in LISTS and out.indent)  # lists in lists stand close
    if tag in LINES:
        out.end(spaced)
    before, number = out.indent, node.start
    if tag == "blockquote" or tag == "dd":
        out.indent += "  "
    work: list[tuple] = []
    for child in node.children:
        if tag in LISTS and isinstance(child, Node) and child.tag == "li":
            mark = f"{number}. " if tag == "ol" else "- "
            number += 1
            work += [(Lines.begin, out, before + " " * len(mark), mark), (_open, child, out), (Lines.begin, out, before, "")]
        else:
            work.append((_open, child, out))
    work.append((_close, tag, before, spaced, out))
    todo.extend(reversed(work))


def _close(tag: str, before: str, spaced: bool, out: Lines) -> None:
    out.indent = before
    if tag in LINES:
        out.end(spaced)
    elif tag in ("td", "th"):
        out.add(" ")


def _plain(node: Node) -> str:
    todo, parts = list(reversed(node.children)), []
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            parts.append(node)
        elif node.tag == "br":
            parts.append("\n")
        else:
            todo.extend(reversed(node.children))
    return "".join(parts)


def rendered(page: str | None) -> str:
    """The text that a reader of the page would see."""
    if not page:
        return ""
    out = Lines()
    todo: list[tuple[Callable, ...]] = [(_open, tree(page), out)]
    while todo:
        do, *what = todo.pop()
        do(*what, todo) if do is _open else do(*what)
    out.end()
    return "\n".join(out.lines).strip("\n")


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = [rendered(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], names=["page_id", "text"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id and visible text of each row of ``pages`` (page_id, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(_run, "page_id long, text string")
