"""Text of web pages by layout: a tree with implied tags, visibility rules, then block by block.

A small tree builder reads tags, closes what HTML lets authors leave open, and skips what no browser shows (head, scripts,
styles, templates, elements that are hidden by attribute or inline style). Rendering emits all visible text: blocks apart by a
blank line or a line's end, list items with bullets or numbers and indents, table cells aligned in columns that heed colspan and
rowspan, preformatted text with its own spaces and blank lines, white space folded elsewhere. A cell of a table with several
columns is folded into lines of WIDEST characters; a longer word stays whole and pushes what follows on its line.

Null or empty html: an empty text. Repeated rows, and ties of any kind: a row each. Empty table: no rows. Columns of other names never
reach the operator. Pages of any length and nesting are rendered whole; broken markup never fails: what is no tag is text.
"""

from __future__ import annotations

import html as entities
import re
import sys
import textwrap
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

TAG = re.compile(r"<!--(?:.*?-->|.*)|<![^>]*>?|<\?[^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
#: What attributes that matter have; only then they are parsed.
MAYBE = re.compile(r"hidden|none|visib|space|span|start|value|&", re.I)
#: What may hold a semicolon or a colon inside a declaration.
OPAQUE = re.compile(r"/\*.*?\*/|\"[^\"]*\"|'[^']*'|\([^)]*\)", re.S)
#: Fixed by HTML: elements without content, of raw text, never shown, of blocks; what an opening tag ends, and within what.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
UNSEEN = frozenset("head script style template noscript iframe object svg select datalist audio video canvas title meta link".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
LINES = frozenset("address article aside body caption dd details div dt fieldset figcaption footer form header html legend li main nav section summary tbody td tfoot th thead tr".split())
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
WIDEST = 60
#: HTML's own limits of spans.
SPANS = {"colspan": 1000, "rowspan": 65534}


def attributes_of(raw: str) -> dict[str, str]:
    """Names in lower case to values; of a name that repeats, the first counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    return out


def style_of(text: str) -> dict[str, str]:
    """Properties to values; the last declaration counts, an important one before others."""
    style: dict[str, tuple[bool, str]] = {}
    for part in OPAQUE.sub(" ", text).lower().split(";"):
        name, _, value = part.partition(":")
        value, mark, _ = value.partition("!")
        if bool(mark) >= style.get(name.strip(), (False, ""))[0]:
            style[name.strip()] = bool(mark), value.strip()
    return {k: v for k, (_, v) in style.items()}


class Node:
    """hidden: with all it holds, by the attribute hidden, display:none, or as a hidden input. visible: what it says about itself, None
    if nothing, as descendants may say otherwise. aria-hidden text is displayed."""

    __slots__ = ("children", "hidden", "numbers", "pre", "tag", "visible")

    def __init__(self, tag: str, raw: str = ""):
        self.tag, self.children, self.numbers = tag, [], {}
        self.hidden, self.visible, self.pre = tag in UNSEEN, None, True if tag in ("pre", "textarea", "listing") else None
        if raw and MAYBE.search(raw):
            self.read(attributes_of(raw))

    def read(self, own: dict[str, str]) -> None:
        style = style_of(own["style"]) if "style" in own else {}
        self.hidden |= "hidden" in own or (self.tag == "input" and own.get("type", "").strip().lower() == "hidden") or style.get("display") == "none"
        self.visible = {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility", ""), self.visible)
        if "white-space" in style:
            self.pre = style["white-space"].startswith("pre")
        for name in ("start", "value", *SPANS):
            if m := re.match(r"\s*([+-]?\d{1,9})", own.get(name, "")):
                self.numbers[name] = int(m[1])

    def span(self, name: str) -> int:
        return min(max(1, self.numbers.get(name, 1)), SPANS[name])


def tree(page: str) -> tuple[Node, int]:
    """The root, and how deep the tree is."""
    root = Node("html")
    stack, at, depth = [root], 0, 1
    open_ = Counter()  # so that the stack is only searched for what is there

    def cut(i: int) -> None:
        open_.subtract(n.tag for n in stack[i:])
        del stack[i:]

    def close(tags, within) -> None:
        while any(open_[t] > 0 for t in tags):
            i = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag in tags or stack[i].tag in within or not i)
            if stack[i].tag not in tags:
                return
            cut(i)

    while at < len(page):
        m = TAG.search(page, at)
        if m is None:
            stack[-1].children.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name == "p" and open_["p"] <= 0:
                stack[-1].children.append(Node("p"))
            for i in range(len(stack) - 1, 0, -1) if open_[name] > 0 else ():
                if stack[i].tag == name:
                    cut(i)
                    break
                if stack[i].tag in ("table", "td", "th") and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
        elif m[2]:
            name = m[2].lower()
            if name in ("html", "body"):
                if name == "body":
                    cut(1)
                    root.read(attributes_of(m[3]))
                continue
            if name in PARAGRAPHS or name in LINES:
                close({"p"}, {"table", "td", "th", "li", "div", "blockquote"} - {name})
            if name in ENDS:
                close(*ENDS[name])
            node = Node(name, m[3])
            stack[-1].children.append(node)
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                if name == "textarea":
                    node.children.append(entities.unescape(page[at : end.start() if end else len(page)]))
                at = end.end() if end else len(page)
            elif name not in VOID:
                stack.append(node)
                open_[name] += 1
                depth = max(depth, len(stack))
    return root, depth


class Layout:
    """Lines so far, and what is due before the next text: 0 nothing, 1 a space, 2 a new line, 3 a blank line. breaks: line ends that
    the author has set, which add up."""

    def __init__(self) -> None:
        self.lines, self.due, self.breaks = [""], 0, 0

    def gap(self, size: int) -> None:
        self.due = max(self.due, size)

    def put(self, text: str) -> None:
        ends = max(self.due - 1, self.breaks)
        if ends > 0 and (len(self.lines) > 1 or self.lines[0]):
            self.lines += [""] * ends
        elif self.due == 1 and self.lines[-1]:
            self.lines[-1] += " "
        self.lines[-1] += text
        self.due = self.breaks = 0

    def text(self, node: Node, depth: int = 0, seen: bool = True, pre: bool = False) -> None:
        seen = seen if node.visible is None else node.visible
        pre = pre if node.pre is None else node.pre
        number, first = node.numbers.get("start", 1), True
        for child in node.children:
            if isinstance(child, str):
                if seen:
                    self.verbatim(child.removeprefix("\n") if first and node.tag in ("pre", "textarea") else child) if pre else self.folded(child)
                first = False
                continue
            first = False
            if child.hidden:
                continue
            tag = child.tag
            gap = 3 if tag in PARAGRAPHS else 2 if tag in LINES else 0
            if tag in ("ul", "ol") and depth:
                gap = 2
            if tag == "br":
                self.breaks += 1
            elif tag == "hr":
                self.gap(3)
            elif tag == "table":
                self.gap(3)
                self.table(child, seen, pre)
                self.gap(3)
            elif tag == "li":
                self.gap(2)
                inner = Layout()
                inner.text(child, depth + 1, seen, pre)
                number = child.numbers.get("value", number)
                mark = f"{number}. " if node.tag == "ol" else "- "
                number += 1
                if seen or inner.done():
                    self.block([(mark if not i else " " * len(mark)) + line if line else mark * (not i) for i, line in enumerate(inner.done().split("\n"))])
            else:
                self.gap(gap)
                self.text(child, depth, seen, pre)
                self.gap(gap)

    def folded(self, s: str) -> None:
        words = s.split()
        if not words:
            self.gap(bool(s))
            return
        if s[0].isspace():
            self.gap(1)
        self.put(" ".join(words))
        if s[-1].isspace():
            self.gap(1)

    def verbatim(self, s: str) -> None:
        for i, line in enumerate(s.split("\n")):
            self.breaks += bool(i)
            if line:
                self.put(line)

    def block(self, lines: list[str]) -> None:
        """Lines of their own; empty ones stay."""
        for line in lines:
            self.put(line)
            self.gap(2)

    def cells(self, node: Node, seen: bool, pre: bool) -> list[list[tuple[str, int, int]]]:
        """(text, columns, rows) of each cell, row by row; what is in no row or cell is a row of its own."""
        rows, todo = [], [(c, seen, pre) for c in reversed(node.children)]
        while todo:
            c, seen, pre = todo.pop()
            if isinstance(c, str):
                if seen and c.strip():
                    rows.append([(" ".join(c.split()), 1, 1)])
                continue
            if c.hidden:
                continue
            if c.tag in ("tbody", "thead", "tfoot"):
                inside = seen if c.visible is None else c.visible
                todo += [(x, inside, pre) for x in reversed(c.children)]
                continue
            row, inside = [], seen if c.visible is None else c.visible
            for x in c.children if c.tag == "tr" else [c]:
                inner = Layout()
                if isinstance(x, str):
                    if inside:
                        inner.folded(x)
                elif not x.hidden:
                    inner.text(x, 1, inside, pre) if x.tag != "table" else inner.table(x, inside, pre)
                cell = not isinstance(x, str) and x.tag in ("td", "th") and not x.hidden
                if inner.done() or cell:
                    row.append((inner.done(), x.span("colspan"), x.span("rowspan")) if cell else (inner.done(), 1, 1))
            if row:
                rows.append(row)
        return rows

    def table(self, node: Node, seen: bool = True, pre: bool = False) -> None:
        rows, placed, taken = self.cells(node, seen, pre), [], {}
        for row in rows:  # taken: column -> rows that a cell from above still takes there
            at, here = 0, []
            below = {c: n - 1 for c, n in taken.items() if n > 1}
            for text, across, down in row:
                while taken.get(at, 0) > 0:
                    at += 1
                here.append((at, across, text))
                if down > 1:
                    below.update(dict.fromkeys(range(at, at + across), down - 1))
                at += across
            placed.append(here)
            taken = below
        several = any(at > 0 for row in placed for at, _, _ in row)
        lines = [[(at, across, fold(text) if several else text.split("\n")) for at, across, text in row] for row in placed]
        width: dict[int, int] = {}
        for wide in sorted({across for row in lines for _, across, _ in row}):
            for at, across, own in (cell for row in lines for cell in row if cell[1] == wide):
                longest = max((len(x) for x in own if len(x) <= WIDEST), default=0)
                short = longest - sum(width.get(c, 0) + 2 for c in range(at, at + across)) + 2
                last = at + across - 1
                width[last] = width.get(last, 0) + max(0, short)
        starts, x = {}, 0
        for c in range(max((at + across for row in lines for at, across, _ in row), default=0)):
            starts[c] = x
            x += width.get(c, 0) + 2 * (c in width)
        for row in lines:
            for i in range(max((len(own) for _, _, own in row), default=0)):
                line = ""
                for at, _, own in row:
                    if i < len(own) and own[i]:
                        line = line.ljust(starts[at]) if len(line) <= starts[at] else line + "  "
                        line += own[i]
                self.block([line.rstrip()])

    def done(self) -> str:
        return "\n".join(x.rstrip() for x in self.lines).strip("\n")


def fold(text: str) -> list[str]:
    """Lines of WIDEST characters at most, but for longer words."""
    if len(text) <= WIDEST and "\n" not in text:
        return [text]
    return [x for line in text.split("\n") for x in (textwrap.wrap(line, WIDEST, break_long_words=False, break_on_hyphens=False, drop_whitespace=True, replace_whitespace=False, expand_tabs=False) if len(line) > WIDEST else [line])]


def rendered(page: str | None) -> str:
    if not page:
        return ""
    (root, depth), out = tree(page), Layout()
    # calls of Python functions take no stack but memory
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * depth + 1000))
    if not root.hidden:
        out.text(root)
    return out.done()


def page_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_lines for every row of pages."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [rendered(h) for h in b.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_lines"])

    url = pages["url"].cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), url.alias("url"), pages["html"].alias("html"))
    return rows.mapInArrow(batches(run), "page_id long, url string, text string, n_chars long, n_lines long")
