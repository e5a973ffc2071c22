"""Layout-aware text of web pages: a tree builder with implied tags, visibility rules, and a text renderer.

The builder follows the main rules of HTML: void elements, raw text elements, start tags that close a paragraph, list item,
definition, option, table cell, row or section, end tags that close what is open inside them, and table parts that imply
rows. Nothing is shown of head, script, style, template and similar elements, of elements with the attribute hidden (unless
their style sets another display) or display:none, of closed dialogs, of closed details but for their summary, and of
comments. Text below visibility:hidden is left out, but not that of elements inside it which are visible again. Styles are those
of style attributes; style sheets are not read.

The renderer collapses white space outside pre and textarea, sets blocks on lines of their own and paragraphs, headings,
lists, tables and the like apart by an empty line, marks list items ("- ", or numbers from start, value and reversed) with the
text of nested lists indented, breaks lines at br, and lays tables out in aligned columns two spaces apart, cells of several
lines included; wide East Asian characters take two places, combining ones none. What stands in a table outside its cells
comes before it. A cell that spans columns widens the last of them if need be; one that spans rows keeps its columns free in
these, up to the end of its row group.

Defined cases: a null page gives a null text, an empty one an empty text; broken markup never fails (what follows a tag or
comment that never ends is dropped, as browsers do); nesting is walked without recursion, and below MAX_DEPTH open elements
what an element holds is laid out beside it, with its visibility kept (browsers have such a bound too; without it the indents of a
page of nested quotes, or the cells of nested tables, would grow with the square of the page); repeated rows are extracted each; other columns are
not looked at.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspect.session import load

MAX_DEPTH = 400

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes title datalist object audio video canvas map meta link base source track param area rp".split())
#: What is not drawn of svg and math, whose other text is shown.
UNDRAWN = frozenset("desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient filter annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table blockquote pre figure hr fieldset xmp listing".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog dir div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary tr caption thead tbody tfoot".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre search section summary table ul xmp".split())
TABLE_PARTS = frozenset("caption colgroup thead tbody tfoot tr td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag closes the nearest open element of these, if none of the second kind is open inside which it stands.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("optgroup", "option"), ("select",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr", "caption", "colgroup"), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "body": (("head",), ("html",)),
}
SCOPE = frozenset("table td th caption html body".split())

#: Attributes as the standard's tokenizer reads them: a quote opens a value right after "=" only, elsewhere it is a character.
_WS = r"\t\n\f\r "
_NAME = rf"[^{_WS}/>][^{_WS}/>=]*+"
_VALUE = rf"\"[^\"]*+\"|'[^']*+'|[^{_WS}>\"'][^{_WS}>]*+"
_TAG = re.compile(rf"<(/?)([A-Za-z][^{_WS}/>]*+)((?:[{_WS}/]++|{_NAME}(?:[{_WS}]*+=[{_WS}]*+(?:{_VALUE}|(?=>))|(?![{_WS}]*+=)))*+)>")
_ATTR = re.compile(rf"({_NAME})(?:[{_WS}]*+=[{_WS}]*+({_VALUE})?+)?+")
_SLASH_IN_VALUE = re.compile(rf"=[{_WS}]*+[^{_WS}\"'][^{_WS}]*\Z")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "kids", "styles")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []
        self.styles = {m[1].lower(): m[2].lower() for m in _STYLE.finditer(attrs["style"])} if "style" in attrs else {}


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        v = m[2] or ""
        out.setdefault(m[1].lower(), html.unescape(v[1:-1] if v[:1] in "\"'" and v[:1] else v))
    return out


def hidden(node: Node) -> bool:
    a = node.attrs
    return (
        node.tag in UNSEEN
        or bool(a)
        and (node.styles.get("display", "none" if "hidden" in a else "") == "none" or node.tag == "input" and a.get("type", "").lower() == "hidden")
        or node.tag == "dialog"
        and "open" not in a
    )


def tree(page: str) -> Node:
    """The page's elements; texts are str children, with entities resolved."""
    root = Node("#root", {})
    stack = [root]
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack elements of a tag are open

    def nearest(names: tuple[str, ...] | frozenset) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def close(names: tuple[str, ...] | frozenset, stop: tuple[str, ...] | frozenset) -> None:
        at = nearest(names)
        if at and at >= nearest(stop):
            while len(stack) > at:
                pop()

    def pop() -> None:
        places[stack.pop().tag].pop()

    def open_(tag: str, attrs: dict[str, str]) -> None:
        node, outer = Node(tag, attrs), stack[-1]
        deep = len(stack) >= MAX_DEPTH and tag not in VOID
        if not deep or tag not in TABLE_PARTS | {"table"}:
            outer.kids.append(node)
        else:  # cells become words, rows become lines
            outer.kids.append(" " if tag in ("td", "th") else Node("div", {}))
        if tag in VOID:
            return
        if deep:  # its content goes beside it, nowhere if it is hidden, or into a run of its visibility
            inside = [] if hidden(node) else outer.kids
            if inside and "visibility" in node.styles:
                inside.append(run := Node("span", {"style": f"visibility:{node.styles['visibility']}"}))
                inside = run.kids
            node = Node(tag, attrs)
            node.kids = inside
        places[tag].append(len(stack))
        stack.append(node)

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            stack[-1].kids.append(html.unescape(page[at:lt]))
        if lt == n:
            break
        nxt = page[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            if nxt.isascii() and nxt.isalpha() or nxt == "/" and page[lt + 2 : lt + 3].isascii() and page[lt + 2 : lt + 3].isalpha():
                break  # a tag that never ends
            if nxt == "/":
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                stack[-1].kids.append("<")
                at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag == "br":
                open_("br", {})
            elif tag == "p" and not places.get("p"):
                open_("p", {})
                pop()
            elif tag in HEADINGS:
                close(HEADINGS, SCOPE)
            else:
                close((tag,), () if tag in SCOPE else SCOPE)
            continue
        attrs = attributes(m[3]) if m[3].strip(" /\n\t\r\f") else {}
        if nearest(("svg", "math")):
            if tag in UNDRAWN:
                attrs["hidden"] = ""
            if m[3].endswith("/") and not _SLASH_IN_VALUE.search(m[3]):  # such an element is empty there
                stack[-1].kids.append(Node(tag, attrs))
                continue
        if tag in CLOSES_P:
            close(("p",), SCOPE | {"button"})
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            pop()
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            open_("tr", {})
        if tag in ("html", "body") and places.get(tag):
            continue
        open_(tag, attrs)
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            upto = end.start() if end else n
            if tag in ("title", "textarea"):
                if tag == "textarea":  # its first line feed is none of its text
                    at += 2 if page.startswith("\r\n", at) else page.startswith(("\n", "\r"), at)
                stack[-1].kids.append(html.unescape(page[at:upto]))
            elif tag == "xmp":
                stack[-1].kids.append(page[at:upto])
            if stack[-1].tag == tag:
                pop()
            gt = page.find(">", upto)
            at = n if gt < 0 else gt + 1
        elif tag in ("pre", "listing"):
            at += 2 if page.startswith("\r\n", at) else page.startswith(("\n", "\r"), at)
    return root


class Page:
    """Lines of text under construction. Blocks ask for line ends and empty lines; they appear when text follows."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0  # empty lines wanted before the next text
        self.indents: list[str] = []
        self.mark = ""

    def end_line(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []
        self.space = False

    def apart(self, empty: int) -> None:
        self.end_line()
        self.gap = max(self.gap, empty)

    def word(self, s: str) -> None:
        if not self.now:
            if self.gap and self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            pad = "".join(self.indents)
            if self.mark:
                pad, self.mark = "".join(self.indents[:-1]) + self.mark, ""
            self.now.append(pad)
            self.space = False
        if self.space:
            self.now.append(" ")
        self.now.append(s)
        self.space = False

    def text(self, s: str) -> None:
        words = [w for w in _SPACE.split(s) if w]
        if s[:1] in " \t\n\r\f" and self.now and len(self.now) > 0:
            self.space = True
        if words:
            self.word(" ".join(words))
            self.space = s[-1] in " \t\n\r\f"

    def verbatim(self, s: str) -> None:
        for i, line in enumerate(s.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if i:
                if not self.now:
                    self.word("")
                self.end_line()
            if line:
                self.word(line)

    def done(self) -> str:
        self.end_line()
        return "\n".join(self.lines)


def _number(value: str | None, default: int) -> int:
    try:
        return int(value)
    except (TypeError, ValueError):
        return default


def places(s: str) -> int:
    """How many places of a line a string takes."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) or unicodedata.category(c) in ("Me", "Mn", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def laid_out(rows: list[list[tuple[str, int, int]]], groups: list[int]) -> list[str]:
    """Lines of a table from rows of (cell text, columns and rows it spans); groups: the rows that begin a row group."""
    placed: list[list[tuple[int, int, list[str]]]] = []
    below: list[tuple[int, int, int]] = []  # (column, end, last row) of cells that reach into rows to come
    starts, edges = sorted({*groups, len(rows)}), {0}
    for no, row in enumerate(rows):
        while starts and starts[0] <= no:
            starts.pop(0)
        below = sorted(x for x in below if x[2] >= no) if row else below
        col, k, cells = 0, 0, []
        for text, across, down in row:
            while k < len(below) and below[k][0] <= col:
                col, k = max(col, below[k][1]), k + 1
            cells.append((col, col + across, text.split("\n")))
            edges |= {col, col + across}
            col += across
        last = [min(no + down, starts[0]) - 1 if down else starts[0] - 1 for _, _, down in row]
        below += [(a, b, upto) for (a, b, _), upto in zip(cells, last) if upto > no]
        placed.append(cells)
    # Columns that no cell begins or ends between count as one.
    column = {edge: n for n, edge in enumerate(sorted(edges))}
    widths = [0] * len(column)
    wide = []
    for cells in placed:
        for a, b, lines in cells:
            if column[b] == column[a] + 1:
                widths[column[a]] = max(widths[column[a]], *map(places, lines))
            else:
                wide.append((column[b] - column[a], column[a], max(map(places, lines))))
    for n, a, need in sorted(wide):
        widths[a + n - 1] += max(0, need - sum(widths[a : a + n]) - 2 * (n - 1))
    left = [0]
    for w in widths:
        left.append(left[-1] + w + 2)
    out = []
    for cells in placed:
        for k in range(max((len(lines) for _, _, lines in cells), default=0)):
            line = ""
            for a, _, lines in cells:
                if k < len(lines) and lines[k]:
                    line += " " * (left[column[a]] - places(line)) + lines[k]
            out.append(line.rstrip())
    return out


class Table:
    def __init__(self):
        self.rows: list[list[tuple[str, int, int]]] = []
        self.groups: list[int] = []


def render(root: Node) -> str:
    """The visible text. Tables are laid out from the inside: a cell is a page of its own."""
    page = Page()
    # Work: (what, node, state). Pages, list counters and tables nest as the stacks below.
    pages, lists, tables, pre = [page], [], [], 0
    work: list[tuple[str, object, bool]] = [("enter", root, True)]
    while work:
        what, node, seen = work.pop()
        page = pages[-1]
        if what == "text":
            if seen:
                (page.verbatim if pre else page.text)(node)
            continue
        if what == "enter":
            if hidden(node):
                continue
            tag, seen = node.tag, node.styles.get("visibility", "visible" if seen else "hidden") not in ("hidden", "collapse")
            if tag == "br":
                if not seen:
                    continue
                if not page.now:
                    page.word("")
                page.end_line()
                continue
            if tag == "hr":
                page.apart(1)
                continue
            if tag == "table":
                page.apart(1)
                tables.append(Table())
            elif tag in ("thead", "tbody", "tfoot") and tables:
                tables[-1].groups.append(len(tables[-1].rows))
            elif tag == "tr" and tables:
                tables[-1].rows.append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1].rows:
                    tables[-1].rows.append([])
                pages.append(Page())
                lists.append(None)
            elif tag in ("ul", "ol", "menu", "dir"):
                page.apart(0 if any(x is not None for x in lists[-1:]) else 1)
                step = -1 if "reversed" in node.attrs else 1
                first = 1 if step > 0 else sum(not isinstance(kid, str) and kid.tag == "li" for kid in node.kids)
                lists.append([_number(node.attrs.get("start"), first), step] if tag == "ol" else [])
            elif tag == "li":
                page.end_line()
                counter = lists[-1] if lists and lists[-1] is not None else []
                mark = "- "
                if counter:
                    value = _number(node.attrs.get("value"), counter[0])
                    mark, counter[0] = f"{value}. ", value + counter[1]
                page.indents.append(" " * len(mark))
                page.mark = mark if seen else ""
            elif tag in ("blockquote", "dd"):
                page.apart(1 if tag == "blockquote" else 0)
                page.indents.append("    " if tag == "dd" else "> ")
            elif tag in BLOCK:
                page.apart(1 if tag in SPACED else 0)
            elif tag == "q" and seen:
                page.text('"')
            if tag in ("pre", "textarea", "listing", "xmp"):
                pre += 1
            work.append(("leave", node, seen))
            kids = node.kids
            if tag == "details" and "open" not in node.attrs:
                kids = [kid for kid in kids if not isinstance(kid, str) and kid.tag == "summary"][:1]
            for kid in reversed(kids):
                work.append(("text" if isinstance(kid, str) else "enter", kid, seen))
            continue
        tag = node.tag
        if tag in ("pre", "textarea", "listing", "xmp"):
            pre -= 1
        if tag == "table":
            done = tables.pop()
            lines = laid_out(done.rows, done.groups)
            page.apart(1)
            for line in lines:
                page.word(line)
                page.end_line()
            page.apart(1)
        elif tag in ("td", "th") and tables:
            lists.pop()
            text = pages.pop().done()
            across, down = min(1000, max(1, _number(node.attrs.get("colspan"), 1))), min(65534, max(0, _number(node.attrs.get("rowspan"), 1)))
            tables[-1].rows[-1].append((text, across, down))
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
            page.apart(0 if any(x is not None for x in lists[-1:]) else 1)
        elif tag == "li":
            page.end_line()
            page.indents.pop()
            page.mark = ""
        elif tag in ("blockquote", "dd"):
            page.apart(1 if tag == "blockquote" else 0)
            page.indents.pop()
        elif tag in BLOCK and not (tag == "tr" and tables):
            page.apart(1 if tag in SPACED else 0)
        elif tag == "q" and seen:
            page.text('"')
    return pages[0].done()


def text_of(page: str | None) -> str | None:
    return None if page is None else render(tree(page))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars, n_lines for each row of pages (page_id, html)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, htmls = batch.column(0).slice(at, 256), batch.column(1).slice(at, 256)
                texts = [text_of(h.as_py()) for h in htmls]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(texts, pa.string()), pa.array([None if t is None else len(t) for t in texts], pa.int64()), pa.array([None if t is None else len(t.split("\n")) if t else 0 for t in texts], pa.int64())],
                    names=["page_id", "text", "n_chars", "n_lines"],
                )

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, text string, n_chars long, n_lines long")


def op8_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))
