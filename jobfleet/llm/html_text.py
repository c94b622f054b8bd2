"""HTML to text the way a browser lays it out.

A tokenizer splits a page into tags and text; a tree builder adds the tags that HTML lets authors
leave out (a paragraph ends before a block, items, rows and cells end before their next, formatting that
was left open ends with its block) and ignores end tags that close nothing. A cell outside a row gets a row, and what may
not stand between the cells of a table is put before the table, as browsers do. Rendering walks the tree: what is never
shown (scripts, styles, templates, comments, hidden or ``display:none`` elements, closed dialogs and popovers, closed details but for
their summary, what stands in for media and frames, in
drawings all but their texts, in formulas their annotations) is skipped; an element of ``visibility:hidden`` keeps its place and
loses its text, but for elements in it that are visible again. Runs of
white space become one space outside ``pre``, blocks start on lines of their own, paragraphs, headings, lists and
tables are set off by an empty line, list items carry a bullet or their number and are indented, options stand on lines of their own
under their group's label, ``br`` breaks the line, images give their alternative text, input fields and buttons their values.

Table cells are padded to aligned columns, where wide characters take two places and combining ones none. A cell stands in the first
column that no cell from above reaches into and spans columns and rows as it says, up to the end of its row group;
a span ends before a column that is taken, so no two cells share a place. Columns in which no cell starts take no room.

All visible text is kept, navigation and advertisements too, and what is hidden from screen readers only. Nothing here recurses, so nesting depth is not limited.

Defined results: null and empty pages give the empty text; pages are read whole; a tag or comment that
never ends runs to the end of the page; repeated rows are rendered each; an empty table gives an empty
result; all columns are kept, and a column ``text`` is replaced.
"""

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import accumulate
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe object audio video canvas datalist noembed noframes title meta link".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul caption".split()
)
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
#: An open element on the left ends before a start tag on the right, unless one of its limits stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
}
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}
HEAD = frozenset("html head base basefont bgsound link meta title script style template noscript noframes".split())
#: Never drawn inside svg and math.
UNDRAWN = {
    "svg": frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split()),
    "math": frozenset({"annotation", "annotation-xml"}),
}
#: Tags of HTML that end a drawing that was left open.
NOT_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p "
    "pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: Where a part of a table may stand; what is open above ends before it.
ROW_GROUPS = frozenset({"tbody", "thead", "tfoot"})
TABLE_PARTS = ROW_GROUPS | {"table", "tr"}
CONTEXT = {
    **dict.fromkeys(("caption", "colgroup", "col", *ROW_GROUPS), frozenset({"table"})),
    "tr": ROW_GROUPS | {"table"},
    **dict.fromkeys(("td", "th"), TABLE_PARTS),
}
SCOPE = frozenset({"table", "td", "th", "caption", "html", "button"})
CELL_GAP = "  "
#: Input fields that show no value, and the most columns and rows that a cell spans.
NO_VALUE = frozenset("hidden checkbox radio color range password file image".split())
MAX_SPAN = {"colspan": 1000, "rowspan": 65534}
MAX_COLUMN = 40  # a wider cell is not padded to, so one long cell does not blow up the others
INDENT = "  "

_TOKEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NONE = re.compile(r"display\s*:\s*none\b", re.IGNORECASE)
_VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*(hidden|collapse|visible)\b", re.IGNORECASE)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), unescape(double or single or bare))
    return found


def parse(page: str) -> Node:
    """The tree of a page under a root node."""
    root = Node("#root", {})
    stack, at = [root], 0
    opened: Counter[str] = Counter()
    parted = False  # since the last content put before a table, white space or a part of the table came

    def put(child: Node | str) -> None:
        """Append to the innermost open element; before the table what a table, row group or row cannot hold."""
        nonlocal parted
        top = len(stack) - 1
        while stack[top].tag in TABLE_PARTS and stack[top].tag != "table":
            top -= 1
        if stack[top].tag != "table":
            stack[-1].children.append(child)
        elif isinstance(child, str) and not child.strip(" \t\n\r\f"):
            parted = True
        else:  # an open table is the last child of what holds it
            stack[top - 1].children[-1:-1] = [" ", child] if parted else [child]
            parted = False

    def clear(context: frozenset[str]) -> bool:
        """End what is open inside the innermost of these, if there is one."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in context:
                opened.subtract(x.tag for x in stack[i + 1 :])
                del stack[i + 1 :]
                return True
            if stack[i].tag == "template":
                return False
        return False

    def between_cells() -> bool:
        """Whether a table is open and no cell or caption of it."""
        inner = next(x.tag for x in reversed(stack) if x.tag in TABLE_PARTS or x.tag in ("td", "th", "caption", "template", "#root"))
        return inner in TABLE_PARTS

    def text(upto: int) -> None:
        if upto > at:
            content = unescape(page[at:upto])
            if opened["head"] and stack[-1].tag == "head" and content.strip():
                close({"head"}, ())
            if not opened["svg"] or opened["text"] or opened["foreignobject"]:
                put(content)

    def close(names: set[str], limits) -> bool:
        """End the innermost open element of these names, and what is open in it."""
        if not any(opened[n] for n in names):
            return False
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                opened.subtract(x.tag for x in stack[i:])
                del stack[i:]
                return True
            if stack[i].tag in limits:
                return False
        return False

    position = 0
    while (m := _TOKEN.search(page, position)) is not None:
        text(m.start())
        at = position = m.end()
        slash, name, rest = m.groups()
        if name is None:
            continue
        name = name.lower()
        if slash:
            parted = parted or name in CONTEXT
            if name == "br":
                put(Node("br", {}))
            elif name == "p" and not close({"p"}, SCOPE):
                put(Node("p", {}))
            elif name != "p":
                close({name}, SCOPE - {name} if name not in ("table", "tr", "tbody", "thead", "tfoot") else {"html"})
            continue
        if (name in BLOCKS and name != "html") or (stack[-1].tag == "head" and name not in HEAD):
            close({"head"}, ())
        if name in NOT_SVG and opened["svg"] and not (opened["foreignobject"] or opened["desc"]):
            close({"svg"}, ())
        if name in CLOSES_P:
            close({"p"}, SCOPE)
        if name == "table" and opened["table"] and between_cells():
            close({"table"}, ())
        if name in CONTEXT and opened["table"] and clear(CONTEXT[name]):
            parted = True
            if name in ("td", "th") and stack[-1].tag != "tr":
                row = Node("tr", {})
                stack[-1].children.append(row)
                stack.append(row)
                opened["tr"] += 1
        elif name in IMPLIED:
            names, limits = IMPLIED[name]
            while close(names, limits):
                pass
        node = Node(name, attributes(rest) if rest.strip(" /\n\t\r") else {})
        if any(opened[x] and name in names for x, names in UNDRAWN.items()):
            node.attrs["hidden"] = ""
        if name == "text" and opened["svg"]:
            put(" ")
        inside = stack[-1].tag in TABLE_PARTS and opened["table"]
        if name in CONTEXT or (inside and (name in ("script", "style", "template", "form") or unseen_input(node))):
            stack[-1].children.append(node)
        else:
            put(node)
        if (opened["svg"] or opened["math"] or name in ("svg", "math")) and rest.endswith("/"):
            continue
        if name in VOID or (inside and name in ("colgroup", "form")):  # such a form or column group holds nothing
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.IGNORECASE).search(page, at)
            stop = end.start() if end else len(page)
            raw = page[at:stop]
            node.children.append(unescape(raw) if name in ("title", "textarea") else raw)
            at = position = stop
        stack.append(node)  # the end tag of raw text, if any, comes next
        opened[name] += 1
    text(len(page))
    return root


def unseen_input(node: Node) -> bool:
    return node.tag == "input" and node.attrs.get("type", "").lower() == "hidden"


def unseen(node: Node) -> bool:
    attrs = node.attrs
    return (
        node.tag in UNSEEN
        or "hidden" in attrs
        or "popover" in attrs
        or (node.tag == "dialog" and "open" not in attrs)
        or unseen_input(node)
        or bool(attrs.get("style") and _NONE.search(attrs["style"]))
    )


class Canvas:
    """Lines of text with pending spaces and line breaks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.gap = 0  # empty lines due before the next text
        self.mark = ""  # bullet or number of the next line
        self.indent = 0

    def write(self, text: str, keep: bool) -> None:
        if keep:
            for i, line in enumerate(text.split("\n")):
                if i:
                    self.line(force=True)
                if line:
                    self._put(line)
            return
        text = _SPACE.sub(" ", text)
        if text.startswith(" "):
            self.space = True
        if text := text.strip(" "):
            ends = text
            if self.space and self.parts:
                self._put(" ")
            self.space = False
            self._put(ends)

    def trailing(self, text: str) -> None:
        if text[-1:] in " \t\n\r\f":
            self.space = True

    def _put(self, text: str) -> None:
        if not self.parts:
            if self.gap and self.lines:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            if self.mark:
                self.parts.append(INDENT * max(0, self.indent - 1) + self.mark)
                self.mark = ""
            elif self.indent:
                self.parts.append(INDENT * self.indent)
        self.parts.append(text)

    def line(self, force: bool = False) -> None:
        if self.parts:
            self.lines.append("".join(self.parts).rstrip(" "))
            self.parts = []
        elif force and self.lines:
            self.lines.append("")
        self.space = False

    def block(self, spaced: bool) -> None:
        self.line()
        if spaced and self.lines and not self.mark:
            self.gap = 1

    def text(self) -> str:
        self.line()
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        return "\n".join(self.lines)


def settle(root: Node) -> None:
    """Take out of the tree what closed details hold but their summary, and what invisible elements show themselves."""
    todo = [(root, True)]
    while todo:
        node, visible = todo.pop()
        if stated := _VISIBILITY.findall(node.attrs.get("style", "")):
            visible = stated[-1].lower() == "visible"
        if node.tag == "details" and "open" not in node.attrs:
            node.children = [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
        if not visible:
            node.children = [" " if isinstance(c, str) and c else c for c in node.children]
            for name in ("alt", "value", "label"):
                node.attrs.pop(name, None)
            if node.tag == "li":
                node.tag = "div"
        todo += [(c, visible) for c in node.children if isinstance(c, Node)]


def span(cell: Node, name: str) -> int:
    """How many columns or rows a cell spans; 0 rows are all that are left."""
    stated = re.match(r"[ \t\n\r\f]*\+?([0-9]+)", cell.attrs.get(name, ""))
    count = min(int(stated[1][:9]), MAX_SPAN[name]) if stated else 1
    return count if count or name == "rowspan" else 1


def rows_of(table: Node) -> list[tuple[int, list[Node]]]:
    """Rows of a table with the number of their row group."""
    rows, todo, groups = [], [(table, 0)], 0
    while todo:
        node, group = todo.pop()
        if node.tag == "tr" and node is not table:
            rows.append((group, [c for c in node.children if isinstance(c, Node) and c.tag in ("td", "th") and not unseen(c)]))
        elif node is table or node.tag in ROW_GROUPS:
            groups += 1
            todo += [(c, groups) for c in reversed(node.children) if isinstance(c, Node) and not unseen(c)]
    return rows


def placed(rows: list[tuple[int, list[Node]]]) -> list[tuple[Node, int, int, int, int]]:
    """(cell, first row, row after the last, first column, column after the last) for every cell, by row and column."""
    group_end = {group: r + 1 for r, (group, _) in enumerate(rows)}
    out, above = [], []  # above: (first column, column after the last, row after the last) of cells that reach down
    for r, (group, cells) in enumerate(rows):
        above = [x for x in above if x[2] > r]
        here, k, column = [], 0, 0
        for cell in cells:
            while k < len(above) and above[k][0] <= column:
                column = max(column, above[k][1])
                k += 1
            to = column + span(cell, "colspan")
            if k < len(above):
                to = min(to, above[k][0])
            end = min(group_end[group], r + span(cell, "rowspan")) if span(cell, "rowspan") else group_end[group]
            out.append((cell, r, end, column, to))
            if end > r + 1:
                here.append((column, to, end))
            column = to
        if here:
            joined: list[tuple[int, int, int]] = []
            for x in sorted(above + here):  # neighbours that reach equally far are one
                if joined and joined[-1][1] == x[0] and joined[-1][2] == x[2]:
                    joined[-1] = (joined[-1][0], x[1], x[2])
                else:
                    joined.append(x)
            above = joined
    return out


def places(text: str) -> int:
    """How many places of a line a text takes."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def grid_lines(rows: list[tuple[int, list[Node]]], done: dict[int, str]) -> list[str]:
    """The lines of a table's rows; a cell that spans rows runs through their lines, and the last one grows if need be."""
    cells = [(flow(c, done).split("\n"), r, end, a, b) for c, r, end, a, b in placed(rows)]
    starts = {a: k for k, a in enumerate(sorted({x[3] for x in cells}))}
    order = sorted(starts)
    cells = [(lines, r, end, starts[a], bisect_left(order, b)) for lines, r, end, a, b in cells]
    width = [0] * len(order)
    for lines, _, _, a, b in sorted(cells, key=lambda x: x[4] - x[3]):
        wanted = min(MAX_COLUMN, max(map(places, lines)))
        held = sum(width[a : min(b, a + MAX_COLUMN)]) + len(CELL_GAP) * (b - a - 1)
        width[b - 1] += max(0, wanted - held)
    left = [0, *accumulate(w + len(CELL_GAP) for w in width)]
    height = [0] * len(rows)
    for lines, r, end, _, _ in sorted(cells, key=lambda x: x[2] - x[1]):
        missing, row = len(lines), r
        while missing > 0 and row < end:
            missing -= height[row]
            row += 1
        height[end - 1] += max(0, missing)
    top = [0, *accumulate(height)]
    out: list[list[tuple[int, int, str]]] = [[] for _ in range(top[-1])]
    for lines, r, _, a, b in cells:
        for i, line in enumerate(lines):
            if line:
                out[top[r] + i].append((a, b, line))
    return [laid_out(sorted(parts), left) for parts in out]


def laid_out(parts: list[tuple[int, int, str]], left: list[int]) -> str:
    """One line; a text wider than its columns moves what follows."""
    line, at, moved = [], 0, 0
    for a, b, text in parts:
        start = left[a] + moved
        line += [" " * (start - at), text]
        at = start + places(text)
        moved += max(0, at - start - (left[b] - left[a] - len(CELL_GAP)))
    return "".join(line).rstrip(" ")


def render(root: Node) -> str:
    """Visible text; tables are rendered innermost first, each cell once."""
    settle(root)
    done: dict[int, str] = {}
    tables, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "table":
            tables.append(node)
        todo += [c for c in node.children if isinstance(c, Node) and not unseen(c)]
    for table in reversed(tables):  # inner tables come after outer ones in this list
        out = grid_lines(rows_of(table), done)
        captions = [c for c in table.children if isinstance(c, Node) and c.tag == "caption" and not unseen(c)]
        above = [t for t in [flow(c, done) for c in captions] if t]
        done[id(table)] = "\n".join(above + out)
    return flow(root, done)


def flow(top: Node, tables: dict[int, str]) -> str:
    """Text of an element's content outside its tables, which are given."""
    canvas = Canvas()
    numbers: list[int | None] = []
    keep = 0
    todo: list[tuple[Node | str, bool]] = [(c, False) for c in reversed(top.children)]
    while todo:
        node, leaving = todo.pop()
        if isinstance(node, str):
            canvas.write(node, keep > 0)
            if not keep:
                canvas.trailing(node)
            continue
        tag = node.tag
        if leaving:
            if tag in ("ul", "ol", "menu", "dir"):
                numbers.pop()
                canvas.indent -= 1
            elif tag in ("blockquote", "dd"):
                canvas.line()
                canvas.indent -= 1
            elif tag == "pre":
                keep -= 1
            canvas.block(tag in SPACED and not (tag in ("ul", "ol") and numbers))
            if tag == "li":
                canvas.mark = ""
            continue
        if unseen(node):
            continue
        if tag == "br":
            canvas.line(force=True)
        elif tag == "img":
            if node.attrs.get("alt", "").strip():
                canvas.write(node.attrs["alt"], False)
        elif tag == "input":
            if node.attrs.get("value", "").strip() and node.attrs.get("type", "").lower() not in NO_VALUE:
                canvas.write(f" {node.attrs['value']} ", False)
                canvas.trailing(" ")
        elif tag == "table":
            canvas.block(True)
            if tables.get(id(node)):
                canvas.write(tables[id(node)], True)
            canvas.block(True)
        elif tag == "svg":
            todo += [(" ", False), *((c, False) for c in reversed(node.children)), (" ", False)]
        elif tag == "option" and node.attrs.get("label", "").strip():
            canvas.block(False)
            canvas.write(node.attrs["label"], False)
            canvas.block(False)
        elif tag in BLOCKS:
            canvas.block(tag in SPACED and not (tag in ("ul", "ol") and numbers))
            if tag in ("ul", "ol", "menu", "dir"):
                first = node.attrs.get("start", "1")
                numbers.append(int(first) if tag == "ol" and re.fullmatch("-?[0-9]{1,9}", first) else 1 if tag == "ol" else None)
                canvas.indent += 1
            elif tag == "li":
                number = numbers[-1] if numbers else None
                if number is not None:
                    numbers[-1] = number + 1
                canvas.mark = "- " if number is None else f"{number}. "
            elif tag in ("blockquote", "dd"):
                canvas.indent += 1
            elif tag == "pre":
                keep += 1
            elif tag == "optgroup" and node.attrs.get("label", "").strip():
                canvas.write(node.attrs["label"], False)
                canvas.line()
            todo.append((node, True))
            todo += [(c, False) for c in reversed(node.children)]
        else:
            todo += [(c, False) for c in reversed(node.children)]
    return canvas.text()


def page_text(page: str | None) -> str:
    return render(parse(page)) if page else ""


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text``."""

    @F.pandas_udf("string")
    def rendered(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([page_text(p) for p in batch], dtype=object)

    return pages.withColumn("text", rendered(F.col(html)))
