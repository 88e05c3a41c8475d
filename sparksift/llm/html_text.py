"""Visible text of HTML pages, laid out as a browser would: a tree with implied tags, visibility rules, blocks, lists and aligned tables.

`tree` reads tags with one pattern and keeps a stack of open elements. Start tags close what the standard says they imply (a paragraph before a block,
list items, cells, rows, options), end tags close up to their match, unmatched ones are ignored. In a table,
section or row a form is closed at once, and all but parts of tables goes in front of the table. `render` walks the tree without recursion. Not
visible: head, script, style, templates and other elements without a rendering, comments, elements with `hidden` or an inline style of `display: none`,
and under `visibility: hidden` all but elements that are visible again; closed dialogs; what a closed `details` holds besides its summary.

Layout: white space is collapsed but in `pre` and `textarea`; blocks start a line, paragraphs, headings, lists, quotes, tables and `pre` have an empty
line around them; `br` ends a line, `hr` is a line of dashes; list items have their bullet or number and are indented by level; table
cells are padded to the widest of their column, columns are two spaces apart; a cell of several columns takes the first of them, and of several rows keeps its
columns free in the rows below. Wide characters count as two. Of several declarations in a style the last one counts.

Defined cases: null or blank pages give an empty text; broken markup never fails; an unclosed element ends with its page; a page of any length is
read whole; rows with one id are rendered each. Pages are rows of one Arrow batch at a time, a few megabytes.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_arrays import slices

# The elements that the rules speak of.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noembed noframes iframe xmp".split())
UNSEEN = set("head script style template noscript title meta link base object iframe audio video canvas datalist noembed noframes param source track area".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td text tfoot th thead tr ul xmp caption".split())  # text is one of svg
SPACED = set("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 ol p pre table ul xmp hr".split())
ENDS_PARAGRAPH = set("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul xmp".split())
# A start tag closes open elements of these names, up to an element of the second list.
IMPLIED = {
    "li": (["li"], ["ul", "ol", "menu", "dir"]),
    "dt": (["dt", "dd"], ["dl"]),
    "dd": (["dt", "dd"], ["dl"]),
    "option": (["option"], ["select", "datalist"]),
    "optgroup": (["option", "optgroup"], ["select"]),
    "td": (["td", "th"], ["tr", "table"]),
    "th": (["td", "th"], ["tr", "table"]),
    "tr": (["td", "th", "tr", "caption", "colgroup"], ["table"]),
    "tbody": (["td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"], ["table"]),
    "thead": (["td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"], ["table"]),
    "tfoot": (["td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"], ["table"]),
    "rt": (["rt", "rp"], ["ruby"]),
    "rp": (["rt", "rp"], ["ruby"]),
}
SCOPE = set("html table td th caption template button object".split())  # end tags don't reach through these
SECTIONS = ("tbody", "thead", "tfoot")
TABLE_PARTS = set("caption colgroup col tbody thead tfoot tr td th".split())
# In a table, section or row these stay; all else goes in front of the table.
TABLE_CONTEXT = {"table", "tr", *SECTIONS}
IN_TABLE = TABLE_PARTS | set("script style template form".split())
# How far a part's start tag ends what is open in its table.
PART_CONTEXT = {"td": ("tr", *SECTIONS), "th": ("tr", *SECTIONS), "tr": SECTIONS, "col": ("colgroup",)}
# Elements of svg and math that are not rendered.
FOREIGN_UNSEEN = {"svg": set("desc metadata defs symbol clippath mask marker pattern".split()), "math": set("annotation annotation-xml".split())}
HEAD_ONLY = set("title meta link base style script noscript template".split())

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)(\s*!\s*important)?", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)(\s*!\s*important)?", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")
MOST_SPAN = 1000


class Node:
    __slots__ = ("tag", "attributes", "children", "parent")

    def __init__(self, tag: str, attributes: dict, parent: "Node | None"):
        self.tag, self.attributes, self.children, self.parent = tag, attributes, [], parent


def attributes_of(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def tree(page: str) -> Node:
    """The elements of a page under one root; text is held as strings."""
    root = Node("html", {}, None)
    stack, count, at = [root], {"html": 1}, 0

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            count[stack.pop().tag] -= 1

    def table_at() -> int:
        """The depth of the innermost table if no cell, caption or template is open in it, else 0."""
        if count.get("table"):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "table":
                    return depth
                if stack[depth].tag in ("td", "th", "caption", "template"):
                    break
        return 0

    def place(item: "Node | str") -> Node:
        """Adds to the open element, or in front of the table that can't hold the item; returns the parent."""
        depth = table_at() if stack[-1].tag in TABLE_CONTEXT else 0
        if not depth:
            stack[-1].children.append(item)
            return stack[-1]
        parent = stack[depth].parent
        at = len(parent.children) - 1
        while parent.children[at] is not stack[depth]:
            at -= 1
        parent.children.insert(at, item)
        return parent

    def push(tag: str, attributes: dict) -> Node:
        if stack[-1].tag == "colgroup" and tag not in ("col", "template"):
            pop_to(len(stack) - 1)
        node = Node(tag, attributes, stack[-1])
        if tag in IN_TABLE:
            stack[-1].children.append(node)
        else:
            node.parent = place(node)
        if tag not in VOID:
            stack.append(node)
            count[tag] = count.get(tag, 0) + 1
        return node

    def close(names, stops) -> None:
        """Closes the open elements of these names above the nearest stop."""
        if not any(count.get(n) for n in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in stops or stack[depth].tag == "template":
                return
            if stack[depth].tag in names:
                pop_to(depth)
                close(names, stops)
                return

    def leave_head() -> None:
        if count.get("head") and stack[-1].tag == "head":
            pop_to(len(stack) - 1)

    while at < len(page):
        found = TOKEN.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text:
            if text.strip():
                leave_head()
                if stack[-1].tag == "colgroup":
                    pop_to(len(stack) - 1)
                place(html.unescape(text))
            else:
                stack[-1].children.append(html.unescape(text))
        if not found:
            break
        at = found.end()
        end, name, rest = found.groups()
        if not name:
            continue
        name = name.lower()
        if end:
            if name == "p" and not count.get("p"):
                leave_head()
                push("p", {})
            if name == "br":
                push("br", {})
            if count.get(name) and name != "html":
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == name:
                        pop_to(depth)
                        break
                    if stack[depth].tag in SCOPE and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "template"):
                        break
            continue
        if name in ("html", "body") and (name == "html" or count.get("body")):
            for key, value in attributes_of(rest).items():
                next((n for n in stack if n.tag == name), root).attributes.setdefault(key, value)
            continue
        if name not in HEAD_ONLY:
            leave_head()
        if name in ENDS_PARAGRAPH:
            close(["p"], SCOPE)
        if name in IMPLIED:
            close(*IMPLIED[name])
        if count.get("table") and name in TABLE_PARTS:
            close(["td", "th", "caption"], ["table"])
            depth = table_at()
            if depth:
                last = len(stack) - 1
                while last > depth and stack[last].tag not in PART_CONTEXT.get(name, ()):
                    last -= 1
                pop_to(last + 1)
        elif name == "table" and table_at():  # one without a cell around it ends the table before
            pop_to(table_at())
        if name in ("td", "th") and stack[-1].tag not in ("tr",) and count.get("table"):
            if stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                push("tr", {})
        node = push(name, attributes_of(rest) if rest.strip(" /") else {})
        if any(count.get(k) and name in v for k, v in FOREIGN_UNSEEN.items()):
            node.attributes["hidden"] = ""
        if rest.endswith("/") and name not in VOID and (count.get("svg") or count.get("math")):
            pop_to(len(stack) - 1)
        elif name == "form" and node.parent.tag in TABLE_CONTEXT:
            pop_to(len(stack) - 1)
        elif name in RAW:
            closing = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>|</{re.escape(name)}\Z", re.I).search(page, at)
            body = page[at : closing.start() if closing else len(page)]
            node.children.append(html.unescape(body) if name in ("textarea", "title") else body)
            at = closing.end() if closing else len(page)
            pop_to(len(stack) - 1)
    return root


class Lines:
    """Text put out line by line."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = False  # an empty line is due before the next text
        self.space = False
        self.indent = 0
        self.marker = ""

    def write(self, text: str, pre: bool) -> None:
        if pre:
            for k, part in enumerate(text.split("\n")):
                if k:
                    self.end(keep=True)
                if part:
                    self.put(part)
            return
        words = SPACES.sub(" ", text)
        if words.startswith(" "):
            self.space, words = True, words[1:]
        if not words:
            return
        self.put((" " if self.space and self.now else "") + words.rstrip(" "))
        self.space = words.endswith(" ")

    def put(self, text: str) -> None:
        if not self.now:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            lead = " " * max(0, self.indent - len(self.marker)) + self.marker
            self.marker = ""
            if lead:
                self.now.append(lead)
        self.now.append(text)

    def end(self, keep: bool = False) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
        elif keep and self.lines and not self.blank:
            self.lines.append("")
        self.now, self.space = [], False

    def paragraph(self) -> None:
        self.end()
        self.blank = True

    def text(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


def declared(pattern: re.Pattern, style: str) -> str:
    """The value that counts of those a style gives: the last one, or the last important one; empty if there is none."""
    found = pattern.findall(style)
    strong = [value for value, important in found if important]
    return (strong or [value for value, _ in found] or [""])[-1].lower()


def style_of(node: Node, seen: bool) -> tuple[bool, bool]:
    """(whether it is rendered at all, whether its own text is visible)."""
    if node.tag in UNSEEN or "hidden" in node.attributes or (node.tag == "dialog" and "open" not in node.attributes) or (node.tag == "input"):
        return False, seen
    style = node.attributes.get("style", "")
    if style:
        if declared(DISPLAY, style) == "none":
            return False, seen
        visibility = declared(VISIBILITY, style)
        if visibility:
            seen = visibility == "visible"
    return True, seen


def cells_of(table: Node) -> tuple[list[Node], list[list[Node]]]:
    """(captions, rows of cells) of a table, without those of tables inside it."""
    captions, rows, waiting = [], [], [table]
    while waiting:
        node = waiting.pop()
        inner = []
        for child in node.children:
            if isinstance(child, str) or not style_of(child, True)[0]:
                continue
            if child.tag == "caption":
                captions.append(child)
            elif child.tag == "tr":
                rows.append([c for c in child.children if isinstance(c, Node) and c.tag in ("td", "th") and style_of(c, True)[0]])
            elif child.tag in ("tbody", "thead", "tfoot"):
                inner.append(child)
        for child in inner:
            rows += [[c for c in r.children if isinstance(c, Node) and c.tag in ("td", "th") and style_of(c, True)[0]] for r in child.children if isinstance(r, Node) and r.tag == "tr" and style_of(r, True)[0]]
            captions += [c for c in child.children if isinstance(c, Node) and c.tag == "caption"]
    return captions, rows


def span(node: Node, name: str) -> int:
    """How many columns or rows a cell takes; 0 rows are all that follow."""
    try:
        n = int(node.attributes.get(name, 1))
    except ValueError:
        return 1
    return MOST_SPAN if n == 0 and name == "rowspan" else min(max(1, n), MOST_SPAN)


def width(text: str) -> int:
    """Places that a line takes where wide characters take two."""
    return len(text) if text.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def table_lines(rows: list[list[list[str]]], spans: list[list[tuple[int, int]]]) -> list[str]:
    """Rows of cells, each a list of lines, with their columns aligned; spans: (columns, rows) of each cell."""
    widths: dict[int, int] = {}
    taken: dict[int, int] = {}  # columns that cells of earlier rows still take, and for how many rows
    placed = []
    for row, span_ in zip(rows, spans, strict=True):
        at, here, new = 0, [], {}
        for cell, (n, down) in zip(row, span_, strict=True):
            while taken.get(at, 0):
                at += 1
            here.append((at, cell))
            if n == 1:
                widths[at] = max([widths.get(at, 0), *map(width, cell)])
            if down > 1:
                new |= {at + i: down for i in range(n)}
            at += n
        placed.append(here)
        taken = {c: left - 1 for c, left in (taken | new).items() if left > 1}
    last = max((at for here in placed for at, _ in here), default=0)
    offset = [0]
    for c in range(last):
        offset.append(offset[-1] + widths.get(c, 0) + 2)
    out = []
    for here in placed:
        for k in range(max((len(cell) for _, cell in here), default=0)):
            line, size = "", 0
            for at, cell in here:
                text = cell[k] if k < len(cell) else ""
                if text:
                    # what takes more than its columns pushes the next cell on
                    gap = max(offset[at] - size, 2 if size else 0)
                    line, size = line + " " * gap + text, size + gap + width(text)
            out.append(line.rstrip())
    return out


def render(page: str | None) -> str:
    """The visible text of a page."""
    # One frame for each text that is being laid out: the page, or a cell of a table. steps: what is left to do, last first.
    Frame = list
    tables: list[tuple[Node, Lines, list, list, list]] = []
    done = Lines()
    frames: list[Frame] = [[done, [("open", tree(page or ""), True, False, None)]]]
    while frames:
        lines, steps = frames[-1]
        if not steps:
            frames.pop()
            if frames:
                tables[-1][2][-1].append(lines.text().split("\n"))
            continue
        kind, node, seen, pre, extra = steps.pop()
        if kind == "text":
            if seen:
                lines.write(node, pre)
        elif kind == "close":
            if extra:
                lines.indent -= extra
            if node.tag == "li":  # an item without text has no line
                lines.marker = ""
            if node.tag in SPACED and not (node.tag in ("ul", "ol") and lines.indent):
                lines.paragraph()
            elif node.tag in BLOCK:
                lines.end()
        elif kind == "cells":  # the next cell of the innermost table, or its end
            table, outer, rows, spans, left = tables[-1]
            if left and left[0]:
                cell = left[0].pop(0)
                spans[-1].append((span(cell, "colspan"), span(cell, "rowspan")))
                steps.append(("cells", node, seen, pre, None))
                frames.append([Lines(), [("open", cell, seen, pre, "cell")]])
            elif left:
                left.pop(0)
                if left:
                    rows.append([])
                    spans.append([])
                steps.append(("cells", node, seen, pre, None))
            else:
                tables.pop()
                outer.paragraph()
                for line in table_lines(rows, spans):
                    if line:
                        outer.put(line)
                        outer.end()
                outer.paragraph()
        else:
            shown, seen = style_of(node, seen)
            if not shown:
                continue
            tag = node.tag
            if tag == "br":
                lines.end(keep=True)
                continue
            if tag == "hr":
                lines.paragraph()
                lines.put("---")
                lines.paragraph()
                continue
            if tag == "table":
                captions, rows = cells_of(node)
                if rows:
                    lines.paragraph()
                    tables.append((node, lines, [[]], [[]], [list(r) for r in rows]))
                    steps.append(("cells", node, seen, pre, None))
                    steps += [("open", c, seen, pre, None) for c in reversed(captions)]
                    continue
            spaced = tag in SPACED and not (tag in ("ul", "ol") and lines.indent)
            if spaced:
                lines.paragraph()
            elif tag in BLOCK:
                lines.end()
            indent = 0
            if tag in ("ul", "ol", "menu", "dir"):
                indent = 3 if tag == "ol" else 2
            elif tag in ("blockquote", "dd"):
                indent = 2
            lines.indent += indent
            children = node.children
            if tag == "li":
                parent = node.parent
                if parent is not None and parent.tag == "ol":
                    place = sum(1 for c in parent.children[: parent.children.index(node)] if isinstance(c, Node) and c.tag == "li") if extra is None else extra
                    start = parent.attributes.get("start", "")
                    lines.marker += f"{(int(start) if re.fullmatch(r'-?[0-9]{1,9}', start) else 1) + place}. "
                else:
                    lines.marker += "- "
            if tag == "details" and "open" not in node.attributes:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            pre = pre or tag in ("pre", "textarea", "xmp")
            steps.append(("close", node, seen, pre, indent))
            ahead, number = [], 0
            for child in children:
                if isinstance(child, str):
                    ahead.append(("text", child, seen, pre, None))
                elif child.tag == "li":
                    ahead.append(("open", child, seen, pre, number))
                    number += 1
                else:
                    ahead.append(("open", child, seen, pre, None))
            steps += reversed(ahead)
    return done.text()


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array([render(p) for p in batch.column(1).to_pylist()], pa.string())], ["page_id", "text"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, text string")
