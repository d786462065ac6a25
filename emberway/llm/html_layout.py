"""Visible text of HTML, laid out: block spacing, lists and aligned table cells."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from emberway.llm._store import small_batches
from emberway.llm._words import parts

# The classes of elements that the rules below speak of.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template head title noscript iframe object audio video canvas datalist".split())
FOREIGN_HIDDEN = frozenset("desc metadata defs symbol annotation annotation-xml".split())  # within svg and math
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup html legend main menu nav option optgroup search section select summary".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre table blockquote figure".split())
CLOSES_P = BLOCK | SPACED | {"hr", "li"} - {"body", "html", "option", "optgroup", "select"}
# an opening tag on the left ends, if open within its scope, those on the right
IMPLIED = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tr": {"tr", "td", "th", "caption", "colgroup"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, "thead": {"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"},
    "tfoot": {"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, "rt": {"rt", "rp"}, "rp": {"rt", "rp"}, "body": {"head"},
}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "optgroup": {"select"}, "rt": {"ruby"}, "rp": {"ruby"}, "body": {"html"}}
TABLE_SCOPE = {"table"}
P_SCOPE = TABLE_SCOPE | {"td", "th", "button"}
TABLE_PARTS = frozenset("caption colgroup col tbody thead tfoot tr td th".split())
TABLE_INNER = frozenset("table tbody thead tfoot tr".split())  # hold table parts only; what else is in them goes before the table
HEAD_CONTENT = frozenset("meta link title style script base template noscript".split())

_TAG = re.compile(r"<(?:(!--)|(/?)([A-Za-z][^\s/>]*)|([!?]))")
_TAG_END = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*>""")
_ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*([a-z-]+)", re.I)
_VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(visible|hidden|collapse)", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SIMPLE = re.compile(r"(\*|[A-Za-z][A-Za-z0-9]*)?((?:[.#][\w-]+)*)")
_MARKS = re.compile(r"([.#])([\w-]+)")
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element; children are nodes and strings."""

    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class Open:
    """The open elements, the root first, and where those of each tag lie, so that none is looked for by going through all."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.at = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, i: int) -> None:
        """Ends the element at i and those in it."""
        while len(self.nodes) > i:
            self.at[self.nodes.pop().tag].pop()

    def last(self, tags: Iterable[str]) -> int:
        """Where the innermost open element of some tags lies; 0 if there is none."""
        found = 0
        for t in tags:
            if (places := self.at.get(t)) and places[-1] > found:
                found = places[-1]
        return found


def tree(html: str, sheets: list[str] | None = None) -> Node:
    """Builds the tree: void elements have no children, opening tags end what they imply, p ends at blocks,
    an end tag without its opening one is ignored (</p> and </br> stand for an element), open elements end with the text.
    Text and elements that lie in a table but in none of its cells go before the table. The page's style
    sheets are added to `sheets`, in order.
    """
    root = Node("html", {})
    opened, at, n = Open(root), 0, len(html)
    stack = opened.nodes

    def say(text: str) -> None:
        if text:
            if stack[-1].tag == "head" and text.strip():
                close({"head"}, {"html"})
            said = unescape(text) if "&" in text else text
            put(said, stack[-1].tag in TABLE_INNER and bool(said.strip()))

    def put(x: Node | str, before: bool) -> None:
        """Into the open element, or before the open table."""
        if not before:
            stack[-1].children.append(x)
            return
        table = opened.last(("table",))
        if not table:
            stack[-1].children.append(x)
            return
        around = stack[table - 1].children
        at = next((i for i in range(len(around) - 1, -1, -1) if around[i] is stack[table]), len(around))
        around.insert(at, x)

    def back_to_table() -> None:
        """Ends what is open in a table outside its cells."""
        inner = opened.last(TABLE_INNER)
        if inner > opened.last(("td", "th", "caption")):
            opened.cut(inner + 1)

    def close(tags: set[str] | frozenset[str], scope: set[str] | frozenset[str]) -> bool:
        i = opened.last(tags)
        if not i or i < opened.last(scope):
            return False
        opened.cut(i)
        return True

    while at < n:
        m = _TAG.search(html, at)
        if not m:
            say(html[at:])
            break
        say(html[at : m.start()])
        if m[1]:
            end = html.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        end = _TAG_END.match(html, m.end())
        stop = end.end() if end else html.find(">", m.end()) + 1
        if not stop:
            break
        at = stop
        if m[4]:
            continue
        tag = m[3].lower()
        if m[2]:
            if tag == "p" and not opened.last(("p",)):
                stack[-1].children.append(Node("p", {}))
            elif tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag not in ("html", "body"):
                close({tag}, TABLE_SCOPE if tag != "table" else frozenset())
            continue
        inside = html[m.end() : stop - 1]
        attrs = {a.lower(): unescape(b or c or d) for a, b, c, d in _ATTR.findall(inside)} if inside.strip(" /") else {}
        if tag in ("html", "body") and len(stack) > 1 + (tag == "body" and stack[-1].tag == "head"):
            stack[-1].attrs.update({k: v for k, v in attrs.items() if k not in stack[-1].attrs} if tag == stack[-1].tag else {})
            continue
        if tag == "html":
            root.attrs.update(attrs)
            continue
        if stack[-1].tag == "head" and tag not in HEAD_CONTENT:
            opened.cut(len(stack) - 1)
        if tag in CLOSES_P:
            close({"p"}, P_SCOPE)
        if tag in IMPLIED:
            scope = SCOPE.get(tag, TABLE_SCOPE)
            for _ in range(4 if scope is TABLE_SCOPE else 2):
                if not close(IMPLIED[tag], scope):
                    break
        if tag in TABLE_PARTS:
            back_to_table()
        if tag == "table" and stack[-1].tag in TABLE_INNER:  # ends the one that it is in, but for cells
            close({"table"}, frozenset())
        node = Node(tag, attrs)
        put(node, stack[-1].tag in TABLE_INNER and tag not in TABLE_PARTS and tag not in HIDDEN)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(html, at)
            text = html[at : end.start() if end else n]
            node.children.append(unescape(text) if tag in ("textarea", "title") else text)
            at = n if not end else html.find(">", end.start()) + 1 or n
            if tag == "style" and sheets is not None:
                sheets.append(sheet(node))
        elif tag not in VOID:
            opened.push(node)
    return root


class Styles:
    """What a page's style sheets say of display and visibility, by simple selectors: a tag, classes and ids, alone or together.

    The more specific rule counts, of equal ones the last. Rules of other selectors (of descendants, states,
    attributes) and those within at-rules, which hold for some media only, are passed over, as is !important.
    """

    def __init__(self, sheets: list[str]) -> None:
        self.by_mark: dict[str, list[tuple]] = defaultdict(list)  # by the tag, .class or #id that a rule's elements have in any case
        for rules, body in (r for sheet in sheets for r in _rules(_COMMENT.sub(" ", sheet))):
            said = {name: found[-1].lower() for name, p in (("display", _DISPLAY), ("visibility", _VISIBILITY)) if (found := p.findall(body))}
            for selector in rules.split(",") if said else ():
                m = _SIMPLE.fullmatch(selector.strip())
                if not m or not m[0]:
                    continue
                tag, marks = (m[1] or "*").lower(), _MARKS.findall(m[2])
                rank = (sum(k == "#" for k, _ in marks), sum(k == "." for k, _ in marks), tag != "*")
                self.by_mark["".join(marks[-1]) if marks else tag].append((rank, tag, {a + b for a, b in marks}, said))

    def of(self, node: Node) -> dict[str, str]:
        """display and visibility as sheets have them for an element; its own style is not asked."""
        if not self.by_mark:
            return {}
        marks = {"." + c for c in node.attrs.get("class", "").split()} | ({"#" + node.attrs["id"]} if "id" in node.attrs else set())
        met = [r for k in ("*", node.tag, *marks) for r in self.by_mark.get(k, ()) if r[1] in ("*", node.tag) and r[2] <= marks]
        out: dict[str, str] = {}
        for _, _, _, said in sorted(met, key=lambda r: r[0]) if len(met) > 1 and len({r[0] for r in met}) > 1 else met:
            out |= said
        return out


def _rules(sheet: str) -> Iterator[tuple[str, str]]:
    """Selectors and bodies of the rules outside at-rules; what is never closed is no rule."""
    at, depth, begun, head = 0, 0, 0, ""
    for m in re.finditer(r"[{};]", sheet):
        if m[0] == "{":
            if not depth:
                head, begun = sheet[at : m.start()].strip(), m.end()
            depth += 1
        elif m[0] == "}":
            depth = max(0, depth - 1)
            if not depth:
                if head and not head.startswith("@"):
                    yield head, sheet[begun : m.start()]
                at, head = m.end(), ""
        elif not depth:
            at = m.end()


def sheet(node: Node) -> str:
    """The text of a style element; for print only, or of another type, it is none."""
    shown = node.attrs.get("media", "all").lower() in ("all", "screen", "") and node.attrs.get("type", "text/css").lower() in ("text/css", "")
    return "".join(node.children) if shown else ""


def hidden(node: Node, said: dict[str, str]) -> bool:
    """said: what the style sheets have for the element; its own style comes before that, the hidden attribute after it."""
    a = node.attrs
    if node.tag in HIDDEN or node.tag == "input" and a.get("type", "").lower() == "hidden" or node.tag == "dialog" and "open" not in a:
        return True
    own = _DISPLAY.findall(a["style"]) if "style" in a else []
    display = own[-1].lower() if own else said.get("display")
    return display == "none" if display else "hidden" in a


class Page:
    """Lines of text; white space is collapsed, blank lines between blocks are merged."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space, self.gap, self.indent, self.first = False, 0, 0, ""

    def text(self, text: str, pre: bool) -> None:
        if pre:
            for i, line in enumerate(text.split("\n")):
                if i:
                    self.end(0, True)
                if line:
                    self.put(line)
            return
        said = _BLANKS.sub(" ", text)
        if said.strip(" "):
            self.space |= said[0] == " "
            self.put(said.strip(" "))
            self.space = said[-1] == " "
        elif said:
            self.space = True

    def put(self, text: str) -> None:
        if self.now and self.space:
            self.now.append(" ")
        self.space = False
        self.now.append(text)

    def end(self, gap: int, force: bool = False) -> None:
        """Ends the line; gap: blank lines wanted before the next one."""
        if self.now or force:
            if self.lines and self.gap:
                self.lines.extend([""] * self.gap)
            line = " " * max(0, self.indent - len(self.first)) + self.first + "".join(self.now)
            self.lines.append(line if self.now or self.first else "")
            self.now, self.gap, self.first = [], 0, ""
        self.space = False
        self.gap = max(self.gap, gap) if self.lines else 0


def rendered(html: str) -> str:
    """All visible text of a page: lists with their bullets or numbers, cells of a table in columns."""
    page, sheets = Page(), []
    root = tree(html, sheets)
    _render(root, page, Styles(sheets))
    page.end(0)
    return "\n".join(line.rstrip() for line in page.lines).strip("\n")


def _render(root: Node, page: Page, styles: Styles) -> None:
    """Walks the tree with a stack of its own, so that depth is no limit. Entries: nodes and strings to enter, or what to do on leaving."""
    todo: list = [root]
    pre = 0
    counts: list[list] = []
    tables: list[dict] = []
    pages = [page]
    seen, foreign = True, 0
    while todo:
        x, p = todo.pop(), pages[-1]
        if isinstance(x, str):
            if seen:
                p.text(x, pre > 0)
        elif isinstance(x, tuple):
            act, tag = x
            if act == "cell":
                p.end(0)
                cell = pages.pop().lines
                tables[-1]["rows"][-1].append((cell, *tag))
            elif act == "table":
                for line in _table(tables.pop()["rows"]):
                    p.now = [line] if line else []
                    p.end(0, True)
                p.end(1)
            elif act == "seen":
                seen = tag
            elif act == "foreign":
                foreign -= 1
            elif act == "list":
                counts.pop()
                p.end(0 if counts else 1)
                p.indent -= 3
            elif act == "pre":
                pre -= 1
                p.end(1)
            elif act == "item":
                p.end(0, bool(p.first))
            else:
                p.end(1 if tag in SPACED else 0)
                p.indent -= 4 * (tag == "blockquote" or tag == "dd")
        elif not hidden(x, said := styles.of(x)) and not (foreign and x.tag in FOREIGN_HIDDEN):
            tag = x.tag
            own = _VISIBILITY.findall(x.attrs["style"]) if "style" in x.attrs else []
            if visibility := own[-1].lower() if own else said.get("visibility"):
                todo.append(("seen", seen))
                seen = visibility == "visible"
            if tag in ("svg", "math"):
                foreign += 1
                todo.append(("foreign", tag))
            if tag == "br":
                p.end(0, True)
                continue
            if tag == "hr":
                p.end(1)
                continue
            if tag == "img":
                if seen and (alt := x.attrs.get("alt", "").strip()):
                    p.text(alt, False)
                continue
            if tag == "input":
                if x.attrs.get("type", "text").lower() in ("text", "submit", "button", "search", "reset") and seen and (value := x.attrs.get("value", "")):
                    p.text(value, False)
                continue
            if tag == "table":
                p.end(1)
                tables.append({"rows": []})
                todo.append(("table", tag))
            elif tag == "tr" and tables:
                tables[-1]["rows"].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]["rows"]:
                    tables[-1]["rows"].append([])
                todo.append(("cell", (_span(x, "colspan", 1000), _span(x, "rowspan", 65534))))
                pages.append(Page())
            elif tag == "caption" or tag in BLOCK or tag in SPACED or tag == "li":
                if tag in ("ul", "ol", "menu", "dir"):
                    p.end(0 if counts else 1)
                    start = x.attrs.get("start", "1")
                    counts.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
                    p.indent += 3
                    todo.append(("list", tag))
                elif tag == "li":
                    p.end(0)
                    kind = counts[-1] if counts else ["ul", 1]
                    p.first = (f"{kind[1]}. " if kind[0] == "ol" else "- ") if seen else ""
                    kind[1] += 1
                    todo.append(("item", tag))
                elif tag == "pre":
                    p.end(1)
                    pre += 1
                    todo.append(("pre", tag))
                else:
                    p.end(1 if tag in SPACED else 0)
                    p.indent += 4 * (tag == "blockquote" or tag == "dd")
                    todo.append(("block", tag))
            if tag == "details" and "open" not in x.attrs:  # closed: its summary alone is shown
                todo.extend([c for c in x.children if isinstance(c, Node) and c.tag == "summary"][:1])
            else:
                todo.extend(reversed(x.children))


def _width(line: str) -> int:
    """Columns that a line takes: wide characters two, combining ones none."""
    if line.isascii():
        return len(line)
    return sum(0 if unicodedata.combining(c) or c == "\u200b" else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in line)


def _span(node: Node, name: str, most: int) -> int:
    """Columns or rows that a cell takes; a rowspan of 0 goes on to the table's end."""
    said = node.attrs.get(name, "1")
    n = int(said) if said.isascii() and said.isdigit() else 1
    return min(n, most) or (most if name == "rowspan" else 1)


def _grid(rows: list[list[tuple[list[str], int, int]]]) -> list[list[list[str]]]:
    """A table's cells by column: one that spans more leaves the others empty."""
    out, held = [], {}
    for r in rows:
        line, fresh = [], {}
        for cell, columns, down in r:
            while held.get(len(line)):
                line.append([])
            if down > 1:
                fresh |= {k: down - 1 for k in range(len(line), len(line) + columns)}
            line += [cell] + [[]] * (columns - 1)
        held = {k: n - 1 for k, n in held.items() if n > 1} | fresh
        out.append(line)
    return out


def _table(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table: a column is as wide as its widest line, cells of more lines go down beside each other."""
    grid = [r for r in _grid(rows) if any(any(line.strip() for line in c) for c in r)]
    width: dict[int, int] = {}
    for r in grid:
        for k, c in enumerate(r):
            width[k] = max(width.get(k, 0), max(map(_width, c), default=0))
    out = []
    for r in grid:
        for i in range(max(map(len, r))):
            said = [(c[i] if i < len(c) else "", width[k]) for k, c in enumerate(r) if width[k]]
            cells = [line + " " * (wide - _width(line)) for line, wide in said]
            while cells and not cells[-1].strip():
                cells.pop()
            out.append(" | ".join(cells).rstrip())
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text: one row per row of pages.

    Hidden are elements of HIDDEN, of display: none, of visibility: hidden but for children that
    are visible again, the hidden attribute, what a closed details holds besides its summary, and what svg and
    math hold besides what they show; display and visibility are those of the element's style or of the page's
    style sheets as far as `Styles` reads them. Cells are aligned by display width.
    A null or empty html gives an empty text. Pages are read whole, however long or deep; broken
    markup gives what the rules of `tree` make of it. Repeated rows give repeated rows; other
    columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in parts(batch, "html"):
                texts = [rendered(x or "") for x in rows.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), pa.array(texts, pa.string())], names=["page_id", "text"])

    small_batches(pages.sparkSession)
    return pages.select("page_id", "html").mapInArrow(run, "page_id long, text string")
