"""Layout-aware text of HTML pages.

A tag scanner feeds a small tree builder: end tags that HTML implies (of p, li,
table cells and rows, options, definition items) are closed before the tag that
implies them, the first matter that is none of the head closes it, cells without
a row get one, what a table cannot hold goes before it, void elements have no
content, and stray end tags are ignored. The
tree is rendered as a browser would show it: hidden elements, scripts, styles and
head matter are left out; white space collapses but for preformatted text; blocks
start on lines of their own, paragraphs and headings with a blank line around
them; list items have bullets or numbers and are indented; table cells are
aligned in columns, with spans over columns and rows. A bullet stands before the
first text of its item, however many blocks lie between. Hidden is what the tag, the
hidden attribute or an inline style hides; hidden visibility is taken over by what
an element holds, which may be visible again; of a drawing its text elements show;
style sheets are not applied.

Defined results: null html gives empty text; malformed markup never fails; deep
nesting is held in a list, not on the stack; repeated rows are rendered each; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("head script style template noscript title object iframe datalist audio video canvas annotation annotation-xml".split())
#: In a drawing text shows in TEXT only, and what UNDRAWN holds is not drawn where it stands.
TEXT = frozenset("text foreignobject".split())
UNDRAWN = frozenset("defs symbol clippath mask marker pattern lineargradient radialgradient metadata desc".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr fieldset".split())
BLOCK = SPACED | frozenset("html body div section article aside header footer nav main address form li dt dd tr caption figcaption details summary legend center option optgroup menu dir".split())
#: A start tag closes open elements of its set, up to the nearest element of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), **{x: ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}) for x in ("thead", "tbody", "tfoot")}, "body": ({"head"}, {"html"}),
}
#: A quote encloses a value only right after "="; one that is never closed is a character like others.
_VALUE = r"""\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]*)"""
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+|[^\s/>][^\s/>=]*(?:{_VALUE})?)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
#: What a head holds; anything else closes it.
HEAD = frozenset("head html base basefont bgsound link meta noframes noscript script style template title".split())
#: Parts of a table that hold no text of their own, and what they may hold.
PARTS = frozenset("table thead tbody tfoot tr colgroup".split())
IN_PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th script style template form".split())
#: A part goes into the nearest open element of its set.
INTO = {"td": {"tr", "thead", "tbody", "tfoot", "table"}, "tr": {"thead", "tbody", "tfoot", "table"}, **{x: {"table"} for x in ("caption", "colgroup", "thead", "tbody", "tfoot")}}
INTO["th"] = INTO["td"]


class Node:
    __slots__ = ("tag", "attrs", "children", "home")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children, self.home = tag, attrs, [], []

    def attributes(self) -> dict[str, str]:
        """Values by lower-cased name; of a repeated name the first."""
        out: dict[str, str] = {}
        for name, *values in _ATTRIBUTE.findall(self.attrs):
            out.setdefault(name.lower(), html.unescape("".join(values)))
        return out


def parse(source: str) -> Node:
    """The tree of a page; text children are plain strings, entities decoded."""
    root = Node("html")
    stack, at, headed = [root], 0, False
    opened = Counter({"html": 1})  # open elements by tag, so that nobody looks through the stack for what is not there

    def push(node: Node) -> None:
        stack.append(node)
        opened[node.tag] += 1

    def cut(depth: int) -> None:
        """Closes the elements from ``depth`` on."""
        opened.subtract(n.tag for n in stack[depth:])
        del stack[depth:]

    def add(child: Node | str) -> None:
        home = stack[-1].children
        spare = child.tag not in IN_PARTS if isinstance(child, Node) else not child.isspace()
        table = next((n for n in reversed(stack) if n.tag == "table"), None) if spare and stack[-1].tag in PARTS else None
        if table:
            home = table.home
            home.insert(next(i for i in range(len(home) - 1, -1, -1) if home[i] is table), child)
        else:
            home.append(child)
        if isinstance(child, Node):
            child.home = home

    def text(s: str) -> None:
        if s:
            if stack[-1].tag == "head" and not s.isspace():
                cut(-1)
            add(html.unescape(s))

    while m := _TAG.search(source, at):
        text(source[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0) if opened[tag] else 0
            if depth:
                cut(depth)
            elif tag == "p":
                add(Node("p"))
            continue
        if tag == "head":
            if headed or len(stack) > 1:
                continue
            headed = True
        elif stack[-1].tag == "head" and tag not in HEAD:
            cut(-1)
        if tag in BLOCK and any(n.tag == "p" for n in stack[-3:]) and tag not in ("html", "body", "option", "tr", "caption"):
            cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == "p"))
        closes, until = IMPLIED.get(tag, ((), ()))
        for i in range(len(stack) - 1, 0, -1) if any(opened[c] for c in closes) else ():
            if stack[i].tag in until:
                break
            if stack[i].tag in closes:
                cut(i)
        if tag in ("html", "body") and opened[tag]:
            continue
        into = INTO.get(tag, ())
        depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in into), 0) if any(opened[c] for c in into) else 0
        if depth:
            cut(depth + 1)
            if tag in ("td", "th") and stack[-1].tag != "tr":
                row = Node("tr")
                add(row)
                push(row)
        node, loose = Node(tag, m[3]), tag == "form" and stack[-1].tag in PARTS
        add(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
            content = source[at : end.start() if end else len(source)]
            node.children.append(content if tag in ("script", "style") else html.unescape(content))
            at = end.end() if end else len(source)
        elif tag not in VOID and not loose and not m[3].endswith("/"):
            push(node)
    text(source[at:])
    return root


class Lines:
    """Collected output: collapses white space and keeps at most one blank line."""

    def __init__(self):
        self.out, self.now, self.blank, self.gap, self.mark = [], "", False, False, ""

    def text(self, s: str) -> None:
        words = s.split()
        if not words:
            self.gap |= bool(s)
            return
        self.marked()
        joint = " " if self.now and not self.now.endswith(" ") and (self.gap or s[0].isspace()) else ""
        self.now += joint + " ".join(words)
        self.gap = s[-1].isspace()

    def marked(self) -> None:
        """Puts a list item's bullet, which waits for the first text of the item, however deep in blocks."""
        if self.mark:
            self.now, self.mark = self.mark, ""

    def line(self, spaced: bool = False) -> None:
        if self.now.strip():
            if self.blank and self.out:
                self.out.append("")
            self.out.append(self.now.rstrip())
            self.blank = False
        self.now, self.gap = "", False
        self.blank |= spaced and not self.mark

    def raw(self, lines: list[str]) -> None:
        self.marked()
        self.line()
        if self.blank and self.out and lines:
            self.out.append("")
        self.out += lines
        self.blank = False


def _number(node: Node, name: str, most: int) -> int:
    found = re.match(r"\s*\+?(\d{1,6})", node.attributes().get(name, "")) if node.attrs else None
    return min(int(found[1]), most) if found else 1


def _grid(node: Node, shown: bool = True) -> list[dict[int, tuple[str, int]]]:
    """The rows of a table: by column the cell's text and how many columns it spans; cells from rows above keep their columns."""
    rows, todo, held = [], [(node, shown)], {}
    while todo:
        n, shown = todo.pop()
        if n.tag == "tr":
            row, at, below = {}, 0, {}
            for c in n.children:
                if isinstance(c, Node) and c.tag in ("td", "th") and not _hidden(c):
                    while held.get(at):
                        at += 1
                    wide, high = _number(c, "colspan", 1000) or 1, _number(c, "rowspan", 65534) or 65534
                    row[at] = " ".join(render(Node("div"), c.children, True, _shown(c, shown)).split()), wide
                    if high > 1:
                        below |= dict.fromkeys(range(at, at + wide), high)
                    at += wide
            rows.append(row)
            held = {c: left - 1 for c, left in (held | below).items() if left > 1}
            continue
        if n.tag in ("thead", "tbody", "tfoot"):
            held = {}  # a span ends with its group of rows
        todo += reversed([(c, _shown(c, shown)) for c in n.children if isinstance(c, Node) and c.tag in ("thead", "tbody", "tfoot", "tr", "form") and not _hidden(c)])
    return rows


def _table(node: Node, shown: bool = True) -> list[str]:
    """Rows of aligned cells, two spaces apart; what is nested in a cell is flattened to one line.

    Columns are as wide as their widest cell, or less where that would make the
    table many times as long as its text: a longer cell moves those behind it.
    """
    rows = _grid(node, shown)
    widths: dict[int, int] = {}
    for row in rows:
        for at, (text, wide) in row.items():
            widths[at] = max(widths.get(at, 0), len(text) if wide == 1 else 0)
    room = 8 * sum(len(text) for row in rows for text, _ in row.values()) + 4096
    most = next((m for m in (1 << 30, 120, 40, 12) if len(rows) * sum(min(w, m) + 2 for w in widths.values()) <= room), 0)
    starts, at = {}, 0
    for column in sorted(widths):
        starts[column] = at
        at += min(widths[column], most) + 2 if widths[column] and most else 0
    lines = []
    for row in rows:
        line = ""
        for column, (text, _) in row.items():
            if text:
                line = (line.ljust(starts[column]) if len(line) + 2 <= starts[column] or not line else line + "  ") + text
        if line:
            lines.append(line)
    return lines


def _hidden(node: Node) -> bool:
    """Whether nothing of an element is shown, whatever its content says."""
    if node.tag in HIDDEN or not node.attrs:
        return node.tag in HIDDEN
    given = node.attributes()
    return "hidden" in given or _declared(given.get("style", ""), "display") == "none"


def _shown(node: Node, shown: bool) -> bool:
    """Whether the text of an element is visible, which content takes over and may set anew."""
    own = _declared(node.attributes().get("style", ""), "visibility") if node.attrs else ""
    return own == "visible" if own in ("visible", "hidden", "collapse") else shown


def _declared(style: str, wanted: str) -> str:
    """A property's value in a style: the last declaration counts, important ones before others."""
    last, important = "", False
    for declaration in re.sub(r"/\*.*?\*/", "", style, flags=re.S).lower().split(";"):
        name, _, value = declaration.partition(":")
        value, mark, _ = value.partition("!")
        if name.strip() == wanted and bool(mark) >= important:
            last, important = value.strip(), bool(mark)
    return last


def _drawn(node: Node, shown: bool) -> list[tuple[Node, bool]]:
    """The elements of a drawing that show text, outermost ones, in order."""
    out, todo = [], [(c, shown) for c in reversed(node.children)]
    while todo:
        x, shown = todo.pop()
        if isinstance(x, str) or x.tag in UNDRAWN or _hidden(x):
            continue
        if x.tag in TEXT:
            out.append((x, shown))
        else:
            todo += [(c, _shown(x, shown)) for c in reversed(x.children)]
    return out


def render(node: Node, children: list | None = None, flat: bool = False, shown: bool = True) -> str:
    """The visible text of a tree; ``flat``: tables in it are lines of their cells' text; ``shown``: what it takes over from around it."""
    lines = Lines()
    node.children = node.children if children is None else children
    # a work list of (what, node or text, shown): the cells of a table are rendered flat, so nothing recurses deeper
    todo, lists = [("open", node, shown)], []
    while todo:
        what, x, shown = todo.pop()
        if what == "close":
            if x.tag in ("ul", "ol", "menu"):
                lists.pop()
            if x.tag in ("li", "dd"):
                lines.marked()
            lines.line(x.tag in SPACED and not (x.tag in ("ul", "ol", "menu") and lists))
            continue
        if isinstance(x, str):
            lines.text(x if shown else " " * any(map(str.isspace, x)))
            continue
        if _hidden(x):
            continue
        shown = _shown(x, shown)
        if x.tag == "br":
            lines.line()
        elif x.tag == "img":
            lines.text(x.attributes().get("alt", "") if shown else "")
        elif x.tag == "svg":
            lines.gap = True
            for drawn, visible in reversed(_drawn(x, shown)):
                todo += [("open", " ", True), ("open", drawn, visible)]
        elif x.tag == "table" and not flat:
            lines.marked()
            lines.line(True)
            for c in x.children:
                if isinstance(c, Node) and c.tag == "caption" and not _hidden(c):
                    lines.text(render(Node("div"), c.children, True, _shown(c, shown)))
            lines.line()
            lines.raw(_table(x, shown))
            lines.line(True)
        elif x.tag in ("pre", "textarea"):
            lines.marked()
            lines.line(True)
            lines.raw("".join(_strings(x, shown)).strip("\n").split("\n"))
            lines.line(True)
        else:
            if x.tag in ("td", "th"):
                lines.gap = True
            if x.tag in ("ul", "ol", "menu"):
                lines.marked()
            if x.tag in BLOCK:
                lines.line(x.tag in SPACED and not (x.tag in ("ul", "ol", "menu") and lists))
                todo.append(("close", x, shown))
            if x.tag in ("ul", "ol", "menu"):
                start = re.match(r"\s*(-?\d{1,9})", x.attributes().get("start", ""))
                lists.append([x.tag, int(start[1]) if start else 1])
            elif x.tag == "li":
                depth, own = max(0, len(lists) - 1), lists[-1] if lists else ["ul", 1]
                lines.mark = "  " * depth + (f"{own[1]}. " if own[0] == "ol" else "- ") if shown else ""
                own[1] += 1
            elif x.tag == "dd":
                lines.mark = "  "
            todo += [("open", c, shown) for c in reversed(x.children)]
    lines.line()
    return "\n".join(lines.out)


def _strings(node: Node, shown: bool = True) -> list[str]:
    out, todo = [], [(c, shown) for c in reversed(node.children)]
    while todo:
        x, shown = todo.pop()
        if isinstance(x, str):
            out.append(x if shown else re.sub(r"[^\n]", "", x))
        elif x.tag == "br":
            out.append("\n")
        elif not _hidden(x):
            todo += [(c, _shown(x, shown)) for c in reversed(x.children)]
    return out


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [render(parse(h)) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    cols = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return pages.select(cols).mapInArrow(run, "page_id long, url string, text string")
