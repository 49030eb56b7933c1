"""Visible text of web pages, laid out: blocks, lists and aligned tables.

A tree builder applies the tags that authors leave out (an open paragraph ends where a block
begins, a cell where the next one does); a cascade of style rules drops what a browser would not show
(`display` of an element, `visibility` as it is inherited); the renderer walks the tree without
recursion, innermost tables first, and writes what is left with its block structure.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import pieces, spare_name

# Fixed values of HTML: elements without content, elements that a start tag closes, and how elements show.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol optgroup option p pre section summary table ul tr thead tbody tfoot caption".split()
)
SPACED = frozenset("p blockquote dl figure h1 h2 h3 h4 h5 h6 ol pre table ul menu dir hr".split())
ENDS_PARAGRAPH = BLOCKS - frozenset("body html option optgroup tr thead tbody tfoot caption".split())
HIDDEN = frozenset("head script style template noscript title meta link base object iframe svg math audio video canvas map datalist".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"), "tr": ("td", "th", "tr", "caption"),
    "td": ("td", "th"), "th": ("td", "th"), "thead": ("caption", "td", "th", "tr", "thead", "tbody", "tfoot"), "tbody": ("caption", "td", "th", "tr", "thead", "tbody", "tfoot"),
    "tfoot": ("caption", "td", "th", "tr", "thead", "tbody", "tfoot"), "body": ("head",), "rt": ("rt", "rp"), "rp": ("rt", "rp"),
}
SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "optgroup": ("select",)}
TABLE_PARTS = frozenset("td th tr thead tbody tfoot caption".split())
IN_HEAD = frozenset("title meta link base script style noscript template".split())
MOST_COLUMNS, MOST_ROWS = 1000, 65534  # of a cell's span
DECLARATION = re.compile(r"(display|visibility)\s*:\s*([\w-]+)\s*(!\s*important)?", re.I)
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
AT_RULE = re.compile(r"@[\w-][^{};]*(?:[{;]|$)")
ALWAYS = re.compile(r"@(?:media\s+(?:[^{]*,\s*)?(?:only\s+)?(?:all|screen)\s*(?:,[^{]*)?\{|media\s*\{|layer\b)", re.I)
BRACE = re.compile(r"[{}]")
COMPOUND = re.compile(r"^([a-z][a-z0-9]*|\*)?((?:[.#][\w-]+)*)$", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "lines")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: "Node | None" = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent
        self.lines: list[str] | None = None  # of a table that is laid out


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.count: Counter = Counter()  # of open elements by tag, so that a look for one that isn't open is cheap
        self.styles: list[str] = []

    def _pop_to(self, tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
        """Close the innermost open element of these, and what is open in it, unless one of `stop` is nearer."""
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                self._close(i)
                return
            if self.open[i].tag in stop:
                return

    def _close(self, first: int) -> None:
        for n in self.open[first:]:
            self.count[n.tag] -= 1
        del self.open[first:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body") and self.count[tag]:
            return
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self._close(len(self.open) - 1)
        if tag in ENDS_PARAGRAPH:
            self._pop_to(("p",), ("table", "td", "th", "button", "caption"))
        for closed in CLOSES.get(tag, ()):
            self._pop_to((closed,), SCOPE.get(tag, ("table",)))
        top = self.open[-1].tag
        if tag in ("td", "th") and top != "tr":  # implied row, and the body around it
            if top == "table":
                self._push("tbody", [])
            self._push("tr", [])
        elif tag == "tr" and top == "table":
            self._push("tbody", [])
        self._push(tag, attrs)
        if tag in VOID:
            self._close(len(self.open) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def _push(self, tag: str, attrs: list) -> None:
        node = Node(tag, dict(attrs), self.open[-1])
        self.open[-1].children.append(node)
        self.open.append(node)
        self.count[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br", {}, self.open[-1]))
        elif tag == "p" and not self.count["p"]:
            self.open[-1].children.append(Node("p", {}, self.open[-1]))
        elif tag not in VOID:
            self._pop_to((tag,), () if tag == "table" else ("table",) if tag in TABLE_PARTS else ("td", "th", "table"))

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "style":
            self.styles.append(data)
        self.open[-1].children.append(data)


def _unconditional(css: str) -> str:
    """A style sheet without its at-rules; blocks of @media all or screen and of @layer stay, as they always apply on a screen."""
    out, at = [], 0
    for m in AT_RULE.finditer(css):
        if m.start() < at:
            continue
        out.append(css[at : m.start()])
        at = m.end()
        if m[0][-1] == "{" and not ALWAYS.match(m[0]):
            depth = 1
            while depth and (b := BRACE.search(css, at)):
                depth, at = depth + (1 if b[0] == "{" else -1), b.end()
            if depth:
                at = len(css)
    out.append(css[at:])
    return "".join(out)


def _declared(body: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) of what a block or a style attribute says of display and visibility."""
    return [(p.lower(), v.lower(), bool(i)) for p, v, i in DECLARATION.findall(body)]


class Compound:
    """A tag, classes and ids that one element must have."""

    __slots__ = ("tag", "classes", "ids")

    def __init__(self, tag: str, parts: list[str]):
        self.tag = "" if tag == "*" else tag.lower()
        self.classes, self.ids = frozenset(p[1:] for p in parts if p[0] == "."), frozenset(p[1:] for p in parts if p[0] == "#")

    def fits(self, node: Node) -> bool:
        if self.tag and self.tag != node.tag:
            return False
        if self.ids and self.ids != {node.attrs.get("id")}:
            return False
        return not self.classes or self.classes <= set((node.attrs.get("class") or "").split())


class StyleSheet:
    """Rules on display and visibility, found by the id, class or tag of the element that they are about.

    Selectors are compounds of tag, classes and ids, joined by descendant or child combinators; rules with others are
    left out. Later and more specific rules win, important ones before all."""

    def __init__(self, css: str):
        self.rules: dict[str, list] = {}
        for order, (names, body) in enumerate(RULE.findall(_unconditional(re.sub(r"/\*.*?\*/", "", css, flags=re.S)))):
            if declared := _declared(body):
                for name in names.split(","):
                    self._add(name, declared, order)

    def _add(self, name: str, declared: list, order: int) -> None:
        chain, child = [], False
        for word in name.replace(">", " > ").split():
            if word == ">":
                child = True
            elif m := COMPOUND.match(word):
                chain.append((Compound(m[1] or "", re.findall(r"[.#][\w-]+", m[2])), child))
                child = False
            else:
                return
        if not chain or child or chain[0][1]:
            return
        own = chain[-1][0]
        weight = tuple(sum(n) for n in zip(*[(len(c.ids), len(c.classes), bool(c.tag)) for c, _ in chain]))
        key = f"#{min(own.ids)}" if own.ids else f".{min(own.classes)}" if own.classes else own.tag or "*"
        self.rules.setdefault(key, []).append((chain, weight, order, declared))

    def said(self, node: Node) -> dict[str, str]:
        """display and visibility as rules and the style attribute give them to an element."""
        attrs = node.attrs
        inline = _declared(attrs.get("style") or "") if attrs else []
        if not self.rules and not inline:
            return {}
        won: dict[str, tuple] = {}

        def take(rank: tuple, declared: list) -> None:
            for at, (what, value, important) in enumerate(declared):
                if what not in won or won[what][0] <= (important, *rank, at):
                    won[what] = ((important, *rank, at), value)

        keys = [node.tag, "*"]
        if attrs:
            keys += [f".{c}" for c in set((attrs.get("class") or "").split())]
            keys += [f"#{attrs['id']}"] if attrs.get("id") else []
        for key in keys:
            for chain, weight, order, declared in self.rules.get(key, ()):
                if _matches(node, chain):
                    take((0, *weight, order), declared)
        take((1, 0, 0, 0, 0), inline)
        return {what: value for what, (_, value) in won.items()}


def _matches(node: Node, chain: list) -> bool:
    """Whether an element and its ancestors fit a chain of compounds. Taking the nearest fitting ancestor is enough as long as
    only descendants are asked for; after a child combinator the search goes on further up."""
    if not chain[-1][0].fits(node):
        return False
    tries = [(node.parent, len(chain) - 2, chain[-1][1])]
    while tries:
        at, k, child = tries.pop()
        while True:
            if k < 0:
                return True
            if at is None or at.tag == "#root":
                break
            if chain[k][0].fits(at):
                if not child and chain[k][1]:  # another one further up may have the right parent
                    tries.append((at.parent, k, False))
                at, child, k = at.parent, chain[k][1], k - 1
            elif child:
                break
            else:
                at = at.parent
    return False


def drop_hidden(root: Node, sheet: StyleSheet) -> None:
    """Take out of a tree what a browser does not show: elements without display, and text without visibility. An element that
    is not visible stays for the visible ones in it; a cell without visibility keeps its place."""
    order: list[tuple[Node, bool]] = []
    stack = [(root, True)]
    while stack:
        node, seen = stack.pop()
        order.append((node, seen))
        kept = []
        for c in node.children:
            if isinstance(c, str):
                if seen:
                    kept.append(c)
                continue
            if c.tag in HIDDEN:
                continue
            said = sheet.said(c)
            gone = "hidden" in c.attrs or (c.tag == "dialog" and "open" not in c.attrs)
            if said.get("display", "none" if gone else "") != "none":
                kept.append(c)
                stack.append((c, said["visibility"] not in ("hidden", "collapse") if said.get("visibility", "inherit") != "inherit" else seen))
        node.children = kept
    state = {id(node): seen for node, seen in order}
    bare = lambda n: not isinstance(n, str) and not state[id(n)] and not n.children
    for node, _ in reversed(order):
        if any(map(bare, node.children)):
            empty = not state[id(node)] and all(map(bare, node.children))
            node.children = [c for c in node.children if not bare(c) or (c.tag in ("td", "th") and not empty)]


class Writer:
    """Lines of text: collapses white space, keeps at most one blank line between blocks, indents."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = self.space = False
        self.indent, self.lead = "", ""

    def text(self, data: str) -> None:
        data = SPACE.sub(" ", data)
        if data.startswith(" "):
            self.space, data = True, data[1:]
        if not data:
            return
        if self.space and self.line:
            self.line.append(" ")
        self.space = data.endswith(" ")
        self.line.append(data[:-1] if self.space else data)

    def flush_space(self) -> None:
        if self.space and self.line:
            self.line.append(" ")
        self.space = False

    def end_line(self, always: bool = False) -> None:
        if self.line or always:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            indent = self.indent[: len(self.indent) - len(self.lead)] + self.lead  # an item's mark stands in its indent
            self.lines.append((indent + "".join(self.line)).rstrip())
            self.lead = ""
        self.line, self.space = [], False

    def gap(self) -> None:
        self.end_line()
        self.blank = True

    def raw(self, lines: list[str]) -> None:
        for text in lines:
            self.line = [text]
            self.end_line(always=True)


def _holds_cells(node: Node) -> bool:
    """Whether cells of the table around it stand in this node; those of a table inside it don't count."""
    stack = [node]
    while stack:
        n = stack.pop()
        if n.tag in ("td", "th"):
            return True
        if n.tag != "table":
            stack += [c for c in n.children if not isinstance(c, str)]
    return False


def _table(node: Node) -> list[str]:
    """Rows of a table, cells padded to the width of their column; a cell of several lines takes several. Columns in which no
    cell begins, which only spans make, take no place."""
    grid: list[dict[int, list[str]]] = []
    begun: set[int] = set()
    captions: list[str] = []
    stack = list(reversed(node.children))
    below: dict[int, int] = {}  # columns that a cell above still covers, and for how many rows
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            if n.strip():  # what stands in a table outside its cells shows before it
                captions += render([n])
        elif n.tag == "caption":
            captions += render(n.children)
        elif n.tag == "tr":
            row: dict[int, list[str]] = {}
            at = 0
            covered, below = below, {k: v - 1 for k, v in below.items() if v > 1}
            inner = list(reversed(n.children))
            while inner:
                c = inner.pop()
                if isinstance(c, str):
                    captions += render([c]) if c.strip() else []
                elif c.tag in ("td", "th"):
                    while at in covered:
                        at += 1
                    row[at] = render(c.children)
                    begun.add(at)
                    down = _number(c.attrs.get("rowspan"), MOST_ROWS, MOST_ROWS)
                    span = _number(c.attrs.get("colspan"), MOST_COLUMNS)
                    if down > 1:
                        below.update((at + k, down - 1) for k in range(span))
                    at += span
                elif _holds_cells(c):  # a form or the like around cells
                    inner += reversed(c.children)
                else:
                    captions += render([c])
            if row or covered:
                grid.append(row)
        elif n.tag in ("thead", "tbody", "tfoot"):
            stack += reversed(n.children)
        elif n.tag != "colgroup":
            captions += render([n])
    columns = sorted(begun)
    place = {k: i for i, k in enumerate(columns)}
    widths = dict.fromkeys(columns, 0)
    for row in grid:
        for k, lines in row.items():
            widths[k] = max(widths[k], max(map(len, lines), default=0))
    out = captions
    for row in grid:
        last = columns[: place[max(row)] + 1] if row else []
        for i in range(max((len(lines) for lines in row.values()), default=1) or 1):
            out.append(" | ".join((row[k][i] if k in row and i < len(row[k]) else "").ljust(widths[k]) for k in last).rstrip())
    return out


def _number(value: str | None, most: int, zero: int = 1) -> int:
    """A whole number from 1 to most; 0 means `zero`, and no number is 1."""
    if not value or not value.strip().isdecimal():
        return 1
    return min(int(value.strip()[:9]) or zero, most)


def _options(node: Node) -> tuple[list[Node], bool]:
    """The options that a select shows, and whether it is a list: else it shows the chosen one (the last that is marked, or the first)."""
    found, stack = [], list(reversed(node.children))
    while stack:
        n = stack.pop()
        if not isinstance(n, str):
            if n.tag == "option":
                found.append(n)
            else:
                stack += reversed(n.children)
    if "multiple" in node.attrs or _number(node.attrs.get("size"), 1000) > 1:
        return found, True
    chosen = [n for n in found if "selected" in n.attrs][-1:] or found[:1]
    return chosen, False


def render(children: list) -> list[str]:
    """Lines of the text of these nodes; tables in them are laid out already."""
    out = Writer()
    # what is still to do: nodes, and functions to call on the way back
    stack: list = list(reversed(children))
    lists: list[list] = []  # [ordered, next number]
    pre = 0
    while stack:
        n = stack.pop()
        if callable(n):
            n()
            continue
        if isinstance(n, str):
            if pre:
                out.flush_space()
                first, *more = n.split("\n")
                out.line.append(first)
                for text in more:
                    out.end_line(always=True)
                    out.line.append(text)
            else:
                out.text(n)
            continue
        tag = n.tag
        if tag == "br":
            out.end_line(always=True)
        elif tag == "hr":
            out.gap()
        elif n.lines is not None:
            out.gap()
            out.raw(n.lines)
            out.gap()
        elif tag == "select":
            shown, listed = _options(n)
            out.text(" ")
            if listed:
                out.end_line()
                stack += reversed(shown)
            else:
                stack += [_space(out), *reversed([c for o in shown for c in o.children])]
        elif tag == "input":
            if (n.attrs.get("type") or "text").lower() in ("submit", "button", "reset") and n.attrs.get("value"):
                out.text(f" {n.attrs['value']} ")
        else:
            spaced, block = tag in SPACED and not (lists and tag in ("ul", "ol", "menu", "dir")), tag in BLOCKS or tag in ("td", "th")
            inside = n.children
            if tag == "details" and "open" not in n.attrs:
                inside = [c for c in inside if not isinstance(c, str) and c.tag == "summary"][:1]
            before = out.indent
            if spaced:
                out.gap()
            elif block:
                out.end_line()
            after = [out.gap] if spaced else [out.end_line] if block else []
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append([tag == "ol", _number(n.attrs.get("start"), 10**8)])
                after.append(lists.pop)
            elif tag == "li":
                kind = lists[-1] if lists else [False, 1]
                mark = f"{kind[1]}. " if kind[0] else "- "
                kind[1] += 1
                out.indent, out.lead = before + " " * len(mark), mark
                after.append(_restore(out, before))
            elif tag in ("blockquote", "dd"):
                out.indent = before + "  "
                after.append(_restore(out, before))
            elif tag in ("pre", "textarea"):
                pre += 1
                if tag == "textarea":
                    out.text(" ")
                    out.flush_space()
                    after.append(_space(out))
                if inside and isinstance(inside[0], str) and inside[0].startswith("\n"):
                    inside = [inside[0][1:], *inside[1:]]

                def leave() -> None:
                    nonlocal pre
                    pre -= 1

                after.append(leave)
            stack += reversed(after)
            stack += reversed(inside)
    out.end_line()
    return out.lines


def _space(out: Writer):
    return lambda: out.text(" ")


def _restore(out: Writer, indent: str):
    def back() -> None:
        out.indent, out.lead = indent, ""

    return back


def page_text(html: str | None) -> str:
    """Visible text of one page; null and empty pages have none. Any markup is accepted."""
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    drop_hidden(builder.root, StyleSheet(" ".join(builder.styles)))
    tables, stack = [], [builder.root]
    while stack:
        n = stack.pop()
        if n.tag == "table":
            tables.append(n)
        stack += [c for c in n.children if not isinstance(c, str)]
    for t in reversed(tables):  # inner ones come after those around them
        t.lines = _table(t)
    return "\n".join(render(builder.root.children)).strip("\n")


def extract(pages: DataFrame, html: str = "html", column: str = "text") -> DataFrame:
    """pages with the visible text of each; all columns stay (a column of that name is replaced).

    Row by row, without a shuffle; pages are read whole. Null and empty pages give "". Repeated rows give
    equal texts; an empty table gives one.
    """
    rest = [c for c in pages.columns if c.lower() != column.lower()]
    own = spare_name(rest, "html")
    frame = pages.select(*[F.col(f"`{c}`") for c in rest], F.col(html).cast("string").alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, own):
                texts = [page_text(t) for t in batch.column(own).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*rest, column])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema.fields[:-1])
    return frame.mapInArrow(run, f"{kept}`{column}` string")
