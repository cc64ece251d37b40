"""Layout-aware text of web pages: a small tree builder and a renderer of its visible text."""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinweave.llm.common import map_arrow

# The element classes of the HTML standard that matter for visible text.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = set("head script style template datalist area audio video canvas iframe object math svg noembed noframes".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset article section nav menu".split())
BLOCK = SPACED | set(
    "html body div li dt dd tr td th thead tbody tfoot caption header footer main aside address form details summary figcaption "
    "legend dialog center hgroup search option optgroup".split()
)
#: An opening tag closes these open elements, up to one of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
CLOSES_P = BLOCK - {"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "html", "body", "option", "optgroup", "legend"}
HEAD_ONLY = set("base link meta title style script noscript template".split())
#: Deeper elements are not nested any further; browsers stop at the same depth.
DEPTH = 512

_SPACES = re.compile(r"[ \t\n\r\f]+")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?""")
_UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        if value[:1] in "\"'":
            value = value[1:-1]
        found.setdefault(name.lower(), unescape(value))
    return found


def _tag_end(html: str, at: int) -> int:
    """Place of the > that ends a tag; those inside quoted values do not. Without an end: the text's end."""
    end = html.find(">", at)
    while end >= 0:
        part = html[at:end]
        if "=" not in part:
            return end
        rest = re.sub(r"""=\s*(?:"[^"]*"|'[^']*')""", "=", part)
        opened = re.search(r"""=\s*(["'])""", rest)
        if not opened:
            return end
        close = html.find(opened[1], end)
        if close < 0:
            return end
        end = html.find(">", close)
    return len(html)


def parse(html: str) -> Node:
    """Tree of a page. Missing end tags are implied as browsers do for paragraphs, list items, definitions,
    table parts and options; end tags without a start are passed over."""
    root = Node("html", {})
    stack, at, n = [root], 0, len(html)

    def add(text: str) -> None:
        if text:
            stack[-1].children.append(unescape(text) if "&" in text else text)

    def close(names: set[str], until: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in until:
                return
            if stack[k].tag in names:
                del stack[k:]

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            add(html[at:])
            break
        if lt > at:
            text = html[at:lt]
            if stack[-1].tag == "head" and text.strip():
                stack.pop()  # text ends the head
            add(text)
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        ending = html.startswith("</", lt)
        name = _NAME.match(html, lt + 1 + ending)
        if not name:
            if ending:  # a bogus comment
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                add("<")
                at = lt + 1
            continue
        end = _tag_end(html, name.end())
        tag, inside = name[0].lower(), html[name.end() : end]
        at = min(n, end + 1)
        if ending:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
                continue
            barrier = {"table"} if tag != "table" else set()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in barrier or (tag in ("li", "dd", "dt") and stack[k].tag in ("ul", "ol", "dl")):
                    break
            else:
                if tag == "p":
                    stack[-1].children.append(Node("p", {}))
            continue
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            stack.pop()
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in CLOSES_P:
            close({"p"}, {"table", "td", "th", "button", "object", "html"})
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr", {})
            stack[-1].children.append(row)
            stack.append(row)
        attrs = _attributes(inside) if inside.strip(" \t\n\r\f/") else {}
        if tag in ("html", "body"):
            if not any(x.tag == tag for x in stack):
                node = Node(tag, attrs)
                stack[-1].children.append(node)
                stack.append(node)
            else:
                next(x for x in stack if x.tag == tag).attrs.update(attrs)
            continue
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            text = html[at : stop.start() if stop else n]
            node.children.append(unescape(text) if tag in ("textarea", "title") else text)
            at = n if not stop else min(n, html.find(">", stop.end()) + 1 or n)
        elif tag not in VOID and len(stack) < DEPTH:
            stack.append(node)
    return root


def _unseen(node: Node) -> bool:
    a = node.attrs
    if node.tag in HIDDEN:
        return True
    if not a:
        return node.tag == "dialog"
    return (
        "hidden" in a or bool(_UNSEEN.search(a.get("style", ""))) or (node.tag == "input" and a.get("type", "").lower() == "hidden")
        or (node.tag == "dialog" and "open" not in a)
    )


class Page:
    """Lines under construction: collapsed inline text, pending blank lines, list indent and marker."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap, self.indent, self.marker = 0, "", ""

    def text(self, s: str, pre: bool = False) -> None:
        if pre:
            first, *others = s.split("\n")
            self.now.append(first)
            for line in others:
                self.flush(True)
                self.now.append(line)
            return
        s = _SPACES.sub(" ", s)
        if s[:1] == " " and (not self.now or self.now[-1][-1:] in (" ", "")):
            s = s[1:]
        if s:
            self.now.append(s)

    def flush(self, keep: bool = False) -> None:
        line = "".join(self.now)
        self.now = []
        line = line if keep else line.rstrip(" ")
        if line or keep:
            if self.gap == 2 and self.lines:
                self.lines.append("")
            self.gap = 0
            lead = self.indent
            if self.marker:
                lead = self.indent[: len(self.indent) - len(self.marker)] + self.marker
                self.marker = ""
            self.lines.append((lead + line).rstrip(" "))

    def block(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.flush()
        return [x.replace("\xa0", " ") for x in self.lines]


def _number(text: str | None, otherwise: int) -> int:
    return int(text) if text and re.fullmatch(r"\s*-?\d{1,9}\s*", text) else otherwise


def _rows(node: Node, page: Page) -> Iterator[list[Node]]:
    """Rows of visible cells; captions and what stands outside cells is rendered ahead of the table."""
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                page.text(child)
        elif _unseen(child):
            continue
        elif child.tag == "tr":
            yield [c for c in child.children if isinstance(c, Node) and c.tag in ("td", "th") and not _unseen(c)]
            for c in child.children:
                if isinstance(c, str) and c.strip() or isinstance(c, Node) and c.tag not in ("td", "th"):
                    lay([c], page)
        elif child.tag in ("thead", "tbody", "tfoot"):
            yield from _rows(child, page)
        elif child.tag not in ("colgroup", "col"):
            lay([child], page)


def _table(node: Node, page: Page) -> None:
    grid: list[dict[int, tuple[list[str], int]]] = []
    down: dict[int, int] = {}  # columns that a cell above still covers, and for how many rows
    for cells in list(_rows(node, page)):
        row, column, covered = {}, 0, dict(down)
        down = {c: k - 1 for c, k in down.items() if k > 1}
        for cell in cells:
            while column in covered:
                column += 1
            inner = Page()
            lay(cell.children, inner)
            wide = min(1000, max(1, _number(cell.attrs.get("colspan"), 1)))
            high = min(65534, max(1, _number(cell.attrs.get("rowspan"), 1)))
            row[column] = (inner.done(), wide)
            if high > 1:
                down.update({c: high - 1 for c in range(column, column + wide)})
            column += wide
        grid.append(row)
    page.flush()
    widths: dict[int, int] = {}
    for single in (True, False):
        for row in grid:
            for column, (lines, wide) in row.items():
                if (wide == 1) == single:
                    need = max(map(len, lines), default=0)
                    have = sum(widths.get(c, 0) for c in range(column, column + wide)) + 3 * (wide - 1)
                    if need > have:
                        widths[column + wide - 1] = widths.get(column + wide - 1, 0) + need - have
    for row in grid:
        for k in range(max((len(lines) for lines, _ in row.values()), default=0)):
            parts, column = [], 0
            for start in sorted(row):
                while column < start:
                    parts.append(" " * widths.get(column, 0))
                    column += 1
                lines, wide = row[start]
                room = sum(widths.get(c, 0) for c in range(start, start + wide)) + 3 * (wide - 1)
                parts.append((lines[k] if k < len(lines) else "").ljust(room))
                column = start + wide
            page.now.append(" | ".join(parts))
            page.flush(True)


def lay(children: list, page: Page, pre: bool = False, lists: int = 0) -> None:
    """Render nodes into ``page``."""
    for child in children:
        if isinstance(child, str):
            page.text(child, pre)
            continue
        tag = child.tag
        if _unseen(child):
            continue
        if tag == "br":
            page.flush(True)
            continue
        if tag in ("input", "img", "wbr"):
            if tag == "input" and child.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                page.text(child.attrs.get("value", ""))
            continue
        if tag == "select":
            options = [o for o in child.children if isinstance(o, Node) and o.tag == "option"]
            shown = next((o for o in options if "selected" in o.attrs), options[0] if options else None)
            lay(shown.children if shown else [], page, pre, lists)
            continue
        if tag == "details" and "open" not in child.attrs:
            page.block(1)
            lay([c for c in child.children if isinstance(c, Node) and c.tag == "summary"][:1], page, pre, lists)
            page.block(1)
            continue
        if tag not in BLOCK:
            lay(child.children, page, pre or tag == "textarea", lists)
            continue
        gap = 2 if tag in SPACED and not (lists and tag in ("ul", "ol", "menu")) else 1
        page.block(gap)
        if tag == "hr":
            page.now.append("---")
        elif tag == "table":
            _table(child, page)
        elif tag in ("ul", "ol", "menu"):
            number = _number(child.attrs.get("start"), 1)
            for item in child.children:
                if isinstance(item, Node) and item.tag == "li" and not _unseen(item):
                    number = _number(item.attrs.get("value"), number)
                    mark = f"{number}. " if tag == "ol" else "- "
                    number += 1
                    page.block(1)
                    before = page.indent
                    page.indent, page.marker = before + " " * len(mark), mark
                    lay(item.children, page, pre, lists + 1)
                    page.flush()
                    page.indent, page.marker = before, ""
                else:
                    lay([item], page, pre, lists)
        elif tag in ("blockquote", "dd"):
            before = page.indent
            page.indent = before + "  "
            lay(child.children, page, pre, lists)
            page.flush()
            page.indent = before
        else:
            inner = child.children
            if tag == "pre" and inner and isinstance(inner[0], str):
                inner = [inner[0].removeprefix("\n"), *inner[1:]]
            lay(inner, page, pre or tag == "pre", lists)
        page.block(gap)


def render(html: str | None) -> str:
    """Visible text of a page: blocks on lines of their own, blank lines around paragraphs, headings, lists and
    tables, list items indented behind their marker, table cells in aligned columns."""
    if not html:
        return ""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    page = Page()
    lay([parse(html)], page)
    return "\n".join(page.done()).strip("\n")


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, html, any others): page_id, text, n_chars, n_lines, text_sha256.

    ``text`` is all visible text, whole. Null or empty html gives an empty text; equal rows are rendered
    each. No shuffle; a task holds one batch of pages."""
    schema = pa.schema([("page_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_lines", pa.int64()), ("text_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [render(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
                     pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in texts], pa.string())],
                    schema=schema,
                )

    return map_arrow(pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")), run, "page_id long, text string, n_chars long, n_lines long, text_sha256 string"
    )
