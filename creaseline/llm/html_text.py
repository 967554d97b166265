"""Visible text of HTML pages, laid out as it would be read.

A forgiving tree builder closes what the markup leaves open, visibility rules drop what no reader sees, and the
renderer keeps blocks apart, numbers list items and aligns the cells of tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from creaseline.llm.common import slices

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"""|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*+"|'[^']*+')*+|[^>]*)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
BLANK = re.compile(r"[ \t\n\r\f]+")
DECLARATION = re.compile(r"""((?:[^;"'(]|"[^"]*"|'[^']*'|\([^)]*\)|["'(])+)""")
CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
#: Values of the two properties that decide what is seen; a declaration with another value counts for nothing.
CSS_VALUES = {
    "display": re.compile(
        r"none|contents|inherit|initial|unset|revert|revert-layer|(?:inline-)?(?:block|flex|grid|table)|inline|flow-root|list-item"
        r"|(?:block|inline) (?:flow|flow-root|flex|grid|table)|table-[a-z-]+|ruby[a-z-]*|-(?:webkit|moz|ms)-[a-z-]+"
    ),
    "visibility": re.compile(r"visible|hidden|collapse|inherit|initial|unset|revert|revert-layer"),
}

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Never shown.
UNRENDERED = frozenset(
    "head script style title meta link base template noscript noembed noframes iframe datalist object audio video canvas rp area".split()
)
#: Blocks with an empty line around them, and blocks with just a line of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre xmp table figure hr fieldset".split())
BLOCK = SPACED | frozenset(
    "html body address article aside details summary dialog div dt dd figcaption footer form header hgroup legend li main nav search section center optgroup option".split()
)
CLOSES_P = BLOCK - frozenset("html body dt dd legend option optgroup".split()) | frozenset(["dt", "dd"])
CELLS = frozenset(["td", "th"])
GROUPS = frozenset(["thead", "tbody", "tfoot"])
IN_HEAD = frozenset("head title meta link base script style template noscript".split())
#: For a start tag: the open elements it ends, and those it does not look past.
ENDS: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "table", "td", "th"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "caption", "colgroup"]), frozenset(["table"])),
    "td": (CELLS, frozenset(["tr", "table"])),
    "th": (CELLS, frozenset(["tr", "table"])),
    **{g: (GROUPS | {"caption", "colgroup", "tr"}, frozenset(["table"])) for g in [*GROUPS, "caption", "colgroup"]},
}
SCOPE = CELLS | {"table", "caption", "template", "html"}
END_BARRIER = {"table": frozenset(["template"]), **dict.fromkeys([*CELLS, *GROUPS, "tr", "caption", "colgroup"], frozenset(["table"]))}


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag = tag
        self.attrs = attrs
        self.children: list[Node | str] = []

    def attributes(self) -> dict[str, str]:
        found: dict[str, str] = {}
        for name, double, single, bare in ATTRIBUTE.findall(self.attrs):
            found.setdefault(name.lower(), unescape(double or single or bare))
        return found


def parse(html: str) -> Node:
    """A tree of the page; whatever is left open or closed twice is put right."""
    root = Node("html")
    stack = [root]

    def end(tags: frozenset, barrier: frozenset) -> bool:
        """Close the innermost of ``tags`` and all in it, if it is open within ``barrier``."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return True
            if stack[i].tag in barrier:
                return False
        return False

    def add(node: Node) -> None:
        stack[-1].children.append(node)

    at = 0
    while True:
        token = TOKEN.search(html, at)
        text = html[at : token.start() if token else len(html)]
        if text:
            if stack[-1].tag == "head" and not text.isspace():
                stack.pop()
            stack[-1].children.append(unescape(text) if "&" in text else text)
        if token is None:
            return root
        at = token.end()
        closing, opening, attrs = token.groups()
        if closing:
            tag = closing.lower()
            if tag == "br":
                add(Node("br"))
            elif tag in ("html", "body"):
                continue  # what follows still belongs to the page
            elif not end(frozenset([tag]), END_BARRIER.get(tag, SCOPE)) and tag == "p":
                add(Node("p"))
        elif opening:
            tag = opening.lower()
            if tag in ("html", "body"):
                end(frozenset(["head"]), frozenset())
                if tag == "body" and len(stack) == 1:
                    node = Node(tag, attrs)
                    add(node)
                    stack.append(node)
                elif tag == "html" and not root.attrs:
                    root.attrs = attrs
                continue
            if tag not in IN_HEAD:
                end(frozenset(["head"]), frozenset())
            if tag in CLOSES_P:
                end(frozenset(["p"]), SCOPE | {"button"})
            if tag in ENDS:
                tags, barrier = ENDS[tag]
                if tag in GROUPS or tag == "tr":
                    end(CELLS, barrier)
                end(tags, barrier)
            if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", stack[-1].tag):
                stack.pop()
            node = Node(tag, attrs)
            add(node)
            if tag in RAW:
                close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                raw = html[at : close.start() if close else len(html)]
                node.children.append(unescape(raw) if tag in ("textarea", "title") else raw)
                at = len(html) if close is None else (html.find(">", close.end()) + 1 or len(html))
            elif tag not in VOID and not (attrs.endswith("/") and tag in ("svg", "path", "use", "g")):
                stack.append(node)


def declared(style: str) -> dict[str, str]:
    """The values of the properties of CSS_VALUES in a style: the last one, or the last important one."""
    found: dict[str, tuple[bool, str]] = {}
    for one in DECLARATION.findall(CSS_COMMENT.sub("", style)):
        name, _, value = one.partition(":")
        name, (value, mark, important) = name.strip().lower(), value.lower().partition("!")
        value = " ".join(value.split())
        if name not in CSS_VALUES or not CSS_VALUES[name].fullmatch(value) or (mark and important.strip() != "important"):
            continue
        if mark or not found.get(name, (False,))[0]:
            found[name] = bool(mark), value
    return {name: value for name, (_, value) in found.items()}


def seen_in(node: Node, inherited: bool) -> bool:
    """Whether the text of ``node`` itself is visible; a descendant may be where its parent is not."""
    if "style" not in node.attrs.lower():
        return inherited
    value = declared(node.attributes().get("style", "")).get("visibility", "inherit")
    return inherited if value in ("inherit", "unset", "revert", "revert-layer") else value in ("visible", "initial")


def hidden(node: Node | str, parent: Node | None) -> bool:
    closed = parent is not None and parent.tag == "details" and "open" not in parent.attributes()
    if isinstance(node, str):
        return closed
    if node.tag in UNRENDERED or (closed and node.tag != "summary"):
        return True
    if not node.attrs or node.attrs.isspace():
        return node.tag == "dialog"
    own = node.attributes()
    if "hidden" in own or (node.tag == "dialog" and "open" not in own) or (node.tag == "input" and own.get("type", "").lower() == "hidden"):
        return True
    return "style" in own and declared(own["style"]).get("display") == "none"


class Lines:
    """Lines of a flow of blocks; runs of white space fold to one blank outside of preformatted text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.margin = 0

    def text(self, text: str, keep: bool) -> None:
        if keep:
            first, *others = text.split("\n")
            self.now.append(first)
            for line in others:
                self.break_line()
                self.now.append(line)
            return
        text = BLANK.sub(" ", text)
        if not self.now or self.now[-1].endswith(" "):
            text = text.lstrip(" ")
        if text:
            self.now.append(text)

    def break_line(self) -> None:
        self._start()
        self.lines.append("".join(self.now).rstrip(" "))
        self.now = []

    def _start(self) -> None:
        if self.margin and self.lines:
            self.lines += [""] * self.margin
        self.margin = 0

    def block(self, margin: int) -> None:
        """End the line, if there is one, and ask for empty lines before the next."""
        if "".join(self.now).strip(" "):
            self.break_line()
        self.now = []
        self.margin = max(self.margin, margin)

    def put(self, lines: list[str], margin: int) -> None:
        if lines:
            self.block(margin)
            self._start()
            self.lines += lines
            self.margin = margin

    def done(self) -> list[str]:
        self.block(0)
        return self.lines


def _span(node: Node, name: str, most: int) -> int:
    value = node.attributes().get(name, "") if name in node.attrs.lower() else ""
    return min(max(int(value), 1), most) if value.strip().isascii() and value.strip().isdigit() else 1


def lay_out(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Cells ``(lines, columns, rows)`` in columns as wide as their widest cell, two blanks apart."""
    placed: list[list[tuple[int, int, list[str]]]] = []
    taken: dict[int, int] = {}  # rows that a cell from above still covers, by column
    for row in rows:
        column, own = 0, []
        covered = {c: n - 1 for c, n in taken.items() if n > 1}
        for lines, wide, high in row:
            while taken.get(column, 0) > 0:
                column += 1
            own.append((column, wide, lines))
            if high > 1:
                covered |= {c: high - 1 for c in range(column, column + wide)}
            column += wide
        taken = covered
        placed.append(own)
    width: dict[int, int] = {}
    for wide_ones in (False, True):
        for own in placed:
            for column, wide, lines in own:
                need = max(map(len, lines), default=0)
                if not wide_ones and wide == 1:
                    width[column] = max(width.get(column, 0), need)
                elif wide_ones and wide > 1:
                    have = sum(width.get(c, 0) + 2 for c in range(column, column + wide)) - 2
                    last = column + wide - 1
                    width[last] = width.get(last, 0) + max(0, need - have)
    start, at = {}, 0
    for column in range(max(width, default=-1) + 2):
        start[column] = at
        at += width[column] + 2 if width.get(column) else 0
    out = []
    for own in placed:
        for i in range(max((len(lines) for _, _, lines in own), default=0)):
            line = ""
            for column, _, lines in own:
                if i < len(lines) and lines[i]:
                    line = line.ljust(start.get(column, at)) + lines[i]
            out.append(line.rstrip(" "))
    return out


def render(root: Node) -> str:
    """All visible text. Works off a stack of its own, so nesting may be as deep as it likes."""
    flows = [Lines()]
    tables: list[list[list]] = []
    lists: list[list[int | None]] = []  # next number of each open list, none for bullets
    keep = 0
    stack: list[tuple[Node | str, Node | None, bool, bool]] = [(root, None, False, True)]
    while stack:
        node, parent, leaving, seen = stack.pop()
        out = flows[-1]
        if isinstance(node, str):
            # white space between rows and cells is nothing
            if seen and not (hidden(node, parent) or (parent.tag in ("table", "tr", *GROUPS) and node.isspace())):
                out.text(node, keep > 0)
            continue
        tag = node.tag
        if not leaving:
            if hidden(node, parent):
                continue
            seen = seen_in(node, seen)
            if tag == "br":
                if seen:
                    out.break_line()
                continue
            if tag in ("ul", "ol", "menu"):
                first = _span(node, "start", 1 << 31) if tag == "ol" else None
                out.block(0 if lists else 1)
                lists.append([first])
            elif tag == "li":
                flows.append(Lines())
            elif tag in CELLS or tag == "caption":
                flows.append(Lines())
            elif tag == "table":
                out.block(1)
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in SPACED:
                out.block(1)
            elif tag in BLOCK:
                out.block(0)
            if tag in ("pre", "textarea", "xmp"):
                keep += 1
                if node.children and isinstance(node.children[0], str):
                    node.children[0] = node.children[0].removeprefix("\n")
            stack.append((node, parent, True, seen))
            stack += [(child, node, False, seen) for child in reversed(node.children)]
            continue
        if tag in ("pre", "textarea", "xmp"):
            keep -= 1
        if tag in ("ul", "ol", "menu"):
            lists.pop()
            out.block(0 if lists else 1)
        elif tag == "li":
            lines = flows.pop().done()
            number = lists[-1][0] if lists else None
            mark = "- " if number is None else f"{number}. "
            if number is not None:
                lists[-1][0] = number + 1
            if not seen:  # nor is its mark
                mark = ""
            flows[-1].put([(mark if i == 0 else " " * len(mark) if line else "") + line for i, line in enumerate(lines)], 0)
        elif tag in CELLS:
            lines = flows.pop().done()
            if not tables:  # a cell on its own is a block
                flows[-1].put(lines, 0)
            else:
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append((lines, _span(node, "colspan", 1000), _span(node, "rowspan", 65534)))
        elif tag == "caption":
            flows[-2].put(flows.pop().done(), 0)
        elif tag == "table":
            flows[-1].put(lay_out(tables.pop()), 0)
            flows[-1].block(1)
        elif tag in SPACED:
            out.block(1)
        elif tag in BLOCK:
            out.block(0)
    return "\n".join(flows[0].done())


def visible_text(html: str) -> str:
    return render(parse(html.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, text`` of every row of ``pages``; null and empty pages have an empty text, repeated rows repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            out = [visible_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(out, pa.string())], ["page_id", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    named = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    return named.mapInArrow(run, f"page_id {kind}, text string")
