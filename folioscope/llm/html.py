"""Layout-aware text of HTML pages: a tree builder with implied tags, visibility rules and a block renderer.

All visible text is emitted: blocks on lines of their own (paragraph-like ones with blank lines around them, adjoining
margins collapsed), list items with markers and indents, table cells padded to their columns' widths with colspan and
rowspan, preformatted text as it is. Hidden are head, script, style, template, noscript and the like, elements with a
hidden attribute or display: none or visibility: hidden, and hidden inputs, at any depth of nesting.

Scanning, building and rendering take time in proportion to the page, whatever its markup: no step looks back over the
open elements, and nothing recurses but nested tables. So that the output stays in proportion too, items nested deeper
than INDENTS lists are indented like the last of them, and tables inside TABLES others have their cells one under
another, and a table that alignment would make more than PADDING times longer is emitted without it; none of these
changes which text is emitted, and very long pages are rendered whole.

A null page gives an empty text, as does one without visible text; broken markup never fails. A null page_id is
carried through, repeated rows are rendered each, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import common

INDENTS, TABLES, PADDING = 40, 12, 64
# Classes of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = set("head script style template noscript title iframe noembed noframes object audio video canvas svg math datalist meta link".split())
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure hr fieldset".split())
BLOCKS = PARAGRAPHS | set("html body div section article aside main nav header footer address form li dt dd tr td th thead tbody tfoot caption figcaption details summary center legend option optgroup menu dir".split())
CLOSES_P = PARAGRAPHS | set("div section article aside main nav header footer address form details figcaption center menu dir".split())
#: A start tag closes an open element of these kinds, unless one of the bounds stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, set()),
}
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def get(self, name: str) -> str | None:
        for m in ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None

    def hidden(self) -> bool:
        if self.tag in HIDDEN:
            return True
        if not self.attributes:
            return False
        if self.tag == "input" and (self.get("type") or "").lower() == "hidden":
            return True
        return self.get("hidden") is not None or bool(UNSEEN.search(self.get("style") or ""))


class Scanner:
    """Markup of a page from left to right; what a search misses once it isn't searched again."""

    def __init__(self, page: str):
        self.page, self.missing, self.failed = page, {}, set()

    def find(self, what: str, at: int) -> int:
        if at >= self.missing.get(what, len(self.page)):
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing[what] = at
        return found

    def tag_end(self, at: int) -> int:
        """Where a start tag's > stands: outside quotes, or the first one if a quote stays open."""
        first, opened, k = self.find(">", at), [], at
        while (m := STOP.search(self.page, k)) is not None:
            if m[0] == ">":
                return m.start()
            # A quote from which an earlier scan came to no end leads to none now.
            end = -1 if m.start() in self.failed else self.find(m[0], m.end())
            opened.append(m.start())
            if end < 0:
                break
            k = end + 1
        self.failed.update(opened)
        return first

    def tokens(self):
        """("text", s), ("start", name, attributes, end) and ("end", name); send(position) goes on from there."""
        page, since, at = self.page, 0, 0
        while (at := page.find("<", at)) >= 0:
            mark, stop, token = page[at + 1 : at + 2], -1, None
            if mark in ("!", "?"):
                if page.startswith("<!--", at):
                    stop = self.find("-->", at + 4)
                    stop = stop + 2 if stop >= 0 else len(page) - 1
                else:
                    stop = self.find(">", at)
            elif self.find(">", at) < 0:
                break
            elif mark == "/":
                if m := NAME.match(page, at + 2):
                    stop, token = self.find(">", m.end()), ("end", m[0].lower())
            elif m := NAME.match(page, at + 1):
                stop = self.tag_end(m.end())
                token = ("start", m[0].lower(), page[m.end() : stop], stop + 1)
            if stop < 0:
                at += 1
                continue
            if at > since:
                yield "text", page[since:at]
            since = at = stop + 1
            if token:
                onward = yield token
                if onward is not None:
                    since = at = onward
                    yield None
        if since < len(page):
            yield "text", page[since:]


class Open:
    """The open elements, with their places by tag, so that no search walks over them."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {root.tag: [0]}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            self.places[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        """The innermost place of the tags; -1 for none."""
        return max((own[-1] for t in tags if (own := self.places.get(t))), default=-1)

    def close(self, kinds, bounds) -> None:
        """Closes the outermost open element of the kinds that no bound shuts in."""
        bound, first = max(0, self.last(bounds)), []
        for tag in kinds:
            own = self.places.get(tag, [])
            # A bound of the same kind is closed itself where nothing stands between.
            k = bisect_left(own, bound if tag not in bounds else bound + 1)
            if k < len(own) and own[k] > 0:
                first.append(own[k])
        if first:
            self.cut(min(first))


def parse(page: str) -> Node:
    """The tree of a page; text is kept as unescaped strings."""
    root = Node("html")
    stack, scanner = Open(root), Scanner(page)
    tokens = scanner.tokens()
    for token in tokens:
        top = stack.nodes[-1]
        if token[0] == "text":
            if top.tag == "head" and not token[1].isspace():  # text ends the head
                stack.cut(len(stack.nodes) - 1)
            stack.nodes[-1].children.append(html.unescape(token[1]))
            continue
        name = token[1]
        if token[0] == "end":
            if name == "p" and not stack.places.get("p"):
                top.children.append(Node("p"))
                continue
            at = stack.last([name])
            inner = name in ("table", "tr", "td", "th", "thead", "tbody", "tfoot", "body", "html")
            if at > 0 and (inner or at >= stack.last(("table", "td", "th"))):  # an end tag in a cell closes nothing around the table
                stack.cut(at)
            continue
        attributes, end = token[2], token[3]
        if name in ("html", "body") and stack.places.get(name):
            continue
        if name in CLOSES_P:
            stack.close({"p"}, {"table", "td", "th", "button", "object"})
        if stack.nodes[-1].tag == "head" and name in BLOCKS:
            stack.cut(len(stack.nodes) - 1)
        if name in IMPLIED:
            stack.close(*IMPLIED[name])
        node = Node(name, attributes)
        stack.nodes[-1].children.append(node)
        if name in RAW:
            stop = re.compile(rf"</{name}\s*+/?>|\Z", re.I).search(page, end)
            if stop.start() > end:
                raw = page[end : stop.start()]
                node.children.append(html.unescape(raw) if name in ("textarea", "title") else raw)
            tokens.send(stop.end())
        elif name not in VOID and not (attributes.endswith("/") and name not in BLOCKS):
            stack.push(node)
    return root


class Flow:
    """Lines one under another with collapsed margins, the indents of open items, and the line that is being filled."""

    def __init__(self):
        self.out: list[str] = []
        self.gap = 0
        self.line: list[str] = []
        self.indents, self.marks = [""], []  # of open items; marks of those that have no line yet

    def end_line(self, margin: int = 0) -> None:
        if self.line:
            joined = re.sub(" +", " ", "".join(self.line))
            self.line = []
            lines = [x.strip(" ") for x in joined.split("\0")]
            lo, hi = 0, len(lines)
            while hi > lo and not lines[hi - 1]:
                hi -= 1
            while lo < hi and not lines[lo]:
                lo += 1
            self.emit([x.replace("\1", " ").replace("\2", "\t") for x in lines[lo:hi]])
        self.gap = max(self.gap, margin)

    def emit(self, lines: list[str]) -> None:
        if not lines:
            return
        if self.out:
            self.out.append("\n\n" if self.gap else "\n")
        self.gap = 0
        lead = self.indents[-1 - len(self.marks)] + "".join(self.marks)
        self.marks = []
        self.out.append(lead + lines[0])
        own = self.indents[-1]
        self.out += [f"\n{own}{x}" if x else "\n" for x in lines[1:]]

    def open_item(self, mark: str) -> None:
        self.end_line()
        self.indents.append(self.indents[-1] + (" " * len(mark) if len(self.indents) <= INDENTS else ""))
        self.marks.append(mark)

    def close_item(self) -> None:
        self.end_line()
        self.indents.pop()
        if self.marks:
            self.marks.pop()


def render(node: Node, pre: bool = False, tables: int = 0) -> str:
    """The text of a node's children; tables counts those around it."""
    flow = Flow()
    # Open elements: their children yet to come, pre, the number of the next item or None, and what ends them.
    stack = [[iter(node.children), pre, _first_number(node), node.tag, None]]
    while stack:
        children, pre, number, tag, _ = top = stack[-1]
        child = next(children, None)
        if child is None:
            end = stack.pop()[4]
            if end == "item":
                flow.close_item()
            elif end is not None:
                flow.end_line(end)
            continue
        if isinstance(child, str):
            if pre:
                child = child.replace("\r\n", "\n")
                flow.line.append(child.replace(" ", "\1").replace("\t", "\2").replace("\n", "\0"))
            else:
                flow.line.append(SPACE.sub(" ", child.replace("\0", "").replace("\1", " ").replace("\2", " ")))
        elif child.hidden():
            continue
        elif child.tag == "br":
            flow.line.append("\0")
        elif child.tag == "input":
            flow.line.append(SPACE.sub(" ", (child.get("value") or "") if (child.get("type") or "text").lower() not in ("checkbox", "radio", "password") else ""))
        elif child.tag in ("li", "dd"):
            mark = "  " if child.tag == "dd" else "- " if number is None else f"{number}. "
            if child.tag == "li" and number is not None:
                top[2] = number + 1
            flow.open_item(mark)
            stack.append([iter(child.children), pre, None, child.tag, "item"])
        elif child.tag == "table" and tables < TABLES:
            flow.end_line(1)
            flow.emit(_table(child, tables + 1))
            flow.gap = 1
        elif child.tag in BLOCKS:
            margin = int(child.tag in PARAGRAPHS and not (tag == "li" and child.tag in ("ul", "ol")))
            flow.end_line(margin)
            stack.append([iter(child.children), pre or child.tag == "pre", _first_number(child), child.tag, margin])
        else:
            stack.append([iter(child.children), pre and child.tag != "textarea", number, tag, None])
    flow.end_line()
    return "".join(flow.out)


def _first_number(node: Node) -> int | None:
    if node.tag != "ol":
        return None
    start = node.get("start") or ""
    return int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1


def _span(cell: Node, name: str, most: int) -> int:
    """A cell's colspan or rowspan; a rowspan of 0 reaches to the end of its group."""
    raw = (cell.get(name) or "1").strip()
    n = int(raw) if re.fullmatch(r"\d{1,6}", raw) else 1
    return most if n == 0 and name == "rowspan" else max(1, min(n, most))


def _table(table: Node, tables: int) -> list[str]:
    """The lines of a table: loose text, captions, then rows with cells padded to the widths of their columns."""
    rows: list[list[tuple[int, int, str]]] = []  # cells as first column, column after the last, text
    captions, loose = [], []
    held: list[list[int]] = []  # columns that cells of earlier rows reach into: first, after the last, rows left

    def row(node: Node) -> None:
        nonlocal held
        cells, fresh, at, k = [], [], 0, 0
        for cell in node.children:
            if isinstance(cell, str):
                body, span, down = SPACE.sub(" ", cell).strip(), 1, 1
                if not body:
                    continue
            elif cell.hidden():
                continue
            else:
                span, down = _span(cell, "colspan", 1000), _span(cell, "rowspan", 65534)
                body = render(cell, tables=tables) if cell.tag in ("td", "th") else _whole(cell, tables)
            while k < len(held) and held[k][0] < at + span:
                cells.append((held[k][0], held[k][1], ""))
                at = max(at, held[k][1])
                k += 1
            cells.append((at, at + span, body))
            if down > 1:
                fresh.append([at, at + span, down])
            at += span
        cells += [(a, b, "") for a, b, _ in held[k:]]
        rows.append(cells)
        merged: list[list[int]] = []
        for a, b, n in sorted([*held, *fresh]):
            if n > 1 and merged and merged[-1][1] == a and merged[-1][2] == n - 1:
                merged[-1][1] = b
            elif n > 1:
                merged.append([a, b, n - 1])
        held = merged

    todo = [iter(table.children)]
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
            held = []  # cells don't reach beyond their group
        elif isinstance(child, str):
            if child.strip():
                loose.append(SPACE.sub(" ", child).strip())
        elif child.hidden():
            continue
        elif child.tag == "tr":
            row(child)
        elif child.tag == "caption":
            captions.append(render(child, tables=tables))
        elif child.tag in ("thead", "tbody", "tfoot", "colgroup", "col"):
            held = []
            todo.append(iter(child.children))
        else:
            loose.append(_whole(child, tables))
    widths: dict[int, int] = {}
    for cells in rows:
        for a, b, body in cells:
            if b == a + 1:
                widths[a] = max(widths.get(a, 0), max(map(len, body.split("\n"))))
    columns, ends = sorted(widths), [0]
    for c in columns:
        ends.append(ends[-1] + widths[c] + 3)
    lines = [y for x in [*loose, *captions] if x for y in x.split("\n")]
    size = sum(len(body) + 8 for cells in rows for _, _, body in cells if body)
    wide = [ends[bisect_left(columns, max((a for a, _, body in cells if body), default=0))] for cells in rows]
    tall = [max((body.count("\n") + 1 for _, _, body in cells), default=0) for cells in rows]
    if sum(w * n for w, n in zip(wide, tall, strict=True)) > PADDING * size:
        rows, ends = [[c for c in cells if c[2]] for cells in rows], [0] * len(ends)
    for cells in rows:
        parts = [(body.split("\n"), max(0, ends[bisect_left(columns, b)] - ends[bisect_left(columns, a)] - 3)) for a, b, body in cells]
        for k in range(max((len(c) for c, _ in parts), default=0)):
            line = " | ".join((c[k] if k < len(c) else "").ljust(w) for c, w in parts).rstrip(" ")
            if line.strip(" |"):
                lines.append(line)
    return lines


def _whole(node: Node, tables: int) -> str:
    """A node's text, itself included."""
    holder = Node("div")
    holder.children.append(node)
    return render(holder, tables=tables)


def extract(page: str | None) -> str:
    return render(parse(page)) if page else ""


def texts(pages: DataFrame) -> DataFrame:
    """(page_id, text) of every row of pages (page_id, html)."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([extract(x.as_py()) for x in batch.column(1)], pa.string())], names=["page_id", "text"])

        return work

    return common.map_batches(pages.select(F.col("page_id").cast("long"), "html"), ["page_id", "html"], make, "page_id long, text string")
