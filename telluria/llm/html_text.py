"""Visible text of web pages, laid out as a reader would see it.

A page is parsed into a tree (implied end tags, void and raw-text elements,
unclosed and stray tags), elements that are not shown are left out, and the rest
is rendered: blocks on lines of their own with blank lines where browsers put
margins, list items with bullets or numbers, preformatted text as it stands, and
table cells padded to columns.

* Null or empty pages give an empty text; text outside any element is shown.
* Not shown: head, scripts, styles, templates, ``noscript``, media fallbacks,
  ``hidden``, ``display:none`` and ``visibility:hidden`` (in attributes, or in
  style sheets for plain tag, class and id selectors), closed ``details`` and
  ``dialog``, unselected options.
* Elements deeper than ``DEPTH`` become siblings there, as in browsers.
* Rows are rendered one by one; other columns are not looked at.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 200
# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset("head script style template noscript noframes noembed iframe object audio video canvas svg math "
                   "datalist title meta link base param source track".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol p "
                  "plaintext pre search section summary table ul xmp caption optgroup".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure menu dir fieldset hr listing xmp".split())
CLOSES_P = BLOCK - frozenset("html body dd dt li caption legend optgroup".split()) | {"dd", "dt", "li"}
# What a start tag closes, and the elements beyond which it does not look.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}), "body": ({"head"}, {"html"}),
}
IMPLIED["tbody"] = IMPLIED["tfoot"] = IMPLIED["thead"]
BARRIER = frozenset("td th table caption html body template button".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[a-zA-Z/][^>]*+>|<[!?][^>]*+>""",
                   re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
GONE = re.compile(r"display\s*:\s*none", re.I)
SIGHT = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def parse(page: str) -> tuple[Node, list[str]]:
    """The tree of a page, and the texts of its style sheets."""
    root, sheets, at = Node("html", {}), [], 0
    stack = [root]

    def close(names: set, stop: frozenset | set) -> None:
        """Pop the nearest of the names, and what is open in it."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return close(names, stop)
            if stack[i].tag in stop:
                return None

    def add(text: str) -> None:
        if text:
            stack[-1].children.append(html.unescape(text) if "&" in text else text)

    while m := TOKEN.search(page, at):
        add(page[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag == "p" and not any(n.tag == "p" for n in stack):
                stack[-1].children.append(Node("p", {}))
            elif tag not in ("html", "body"):
                stop = BARRIER - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else {"table"} - {tag}
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if stack[i].tag in stop:
                        break
            continue
        attrs = _attributes(m[3]) if m[3] else {}
        if tag == "html":
            root.attrs = attrs | root.attrs
            continue
        if tag in CLOSES_P:
            close({"p"}, BARRIER)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        elif tag[0] == "h" and tag[1:] in "123456" and stack[-1].tag[0] == "h" and stack[-1].tag[1:] in "123456" \
                and len(stack[-1].tag) == 2 == len(tag):
            stack.pop()
        elif stack[-1].tag == "head" and tag not in UNSEEN:
            stack.pop()
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            inner = page[at:end.start() if end else len(page)]
            at = len(page) if not end else (page.find(">", end.start()) + 1 or len(page))
            node.children.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
            if tag == "style":
                sheets.append(inner)
        elif len(stack) < DEPTH:
            stack.append(node)
    add(page[at:])
    return root, sheets


def hidden_selectors(sheets: list[str]) -> set[str]:
    out: set[str] = set()
    for sheet in sheets:
        for m in RULE.finditer(re.sub(r"/\*.*?\*/", "", sheet, flags=re.S)):
            if GONE.search(m[2]) or ((v := SIGHT.search(m[2])) and v[1].lower() != "visible"):
                out |= {s for s in (x.strip().lower() for x in m[1].split(",")) if re.fullmatch(r"[.#]?[\w-]+", s)}
    return out


class Page:
    """Renders one tree; inline text is collected until a block ends it."""

    def __init__(self, hidden: set[str]):
        self.hidden = hidden

    def unseen(self, n: Node) -> bool:
        a = n.attrs
        if n.tag in UNSEEN or "hidden" in a or (n.tag == "dialog" and "open" not in a):
            return True
        if a and GONE.search(a.get("style", "")):
            return True
        return bool(self.hidden) and (n.tag in self.hidden or f"#{a.get('id', '').lower()}" in self.hidden
                                      or any(f".{c}" in self.hidden for c in a.get("class", "").lower().split()))

    def block(self, n: Node, visible: bool = True, pre: bool = False, depth: int = 0) -> list[str]:
        """Lines of an element's content; ``None`` marks a margin."""
        lines: list[str | None] = []
        line: list[str] = []

        def flush() -> None:
            text = "".join(line)
            line.clear()
            if not pre:
                text = "\n".join(x.strip(" ") for x in SPACE.sub(lambda m: " " if "\0" not in m[0] else m[0], text)
                                 .replace("\0", "\n").split("\n"))
                if not text.strip():
                    return
            elif text == "":
                return
            lines.extend(text.replace("\0", "\n").strip("\n").split("\n"))

        def inline(n: Node, visible: bool) -> None:
            number = _start(n)
            if n.tag == "details" and "open" not in n.attrs:
                children = [c for c in n.children if isinstance(c, Node) and c.tag == "summary"][:1]
            elif n.tag == "select":
                every = _options(n)
                children = ([c for c in every if "selected" in c.attrs] or every)[:1]
            else:
                children = n.children
            for c in children:
                if isinstance(c, str):
                    if visible:
                        line.append(c)
                    continue
                if self.unseen(c):
                    continue
                seen = visible
                if m := SIGHT.search(c.attrs.get("style", "")):
                    seen = m[1].lower() == "visible"
                if c.tag == "br":
                    line.append("\0")
                elif c.tag == "input":
                    if seen and c.attrs.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url"):
                        line.append(" " + c.attrs.get("value", "") + " ")
                elif c.tag not in BLOCK:
                    if c.tag in ("td", "th", "tr", "tbody", "thead", "tfoot"):  # cells outside a table
                        line.append(" ")
                    inline(c, seen)
                else:
                    flush()
                    if c.tag == "hr":
                        lines.extend([None, "---", None])
                        continue
                    inner = self.table(c, seen, depth) if c.tag == "table" else self.block(
                        c, seen, pre or c.tag in ("pre", "listing", "xmp"), depth + (c.tag in ("ul", "ol", "menu", "dir")))
                    if c.tag == "li":
                        if n.tag == "ol":
                            number = _number(c.attrs.get("value"), number)
                            mark, number = f"{number}. ", number + 1
                        else:
                            mark = "- "
                        inner = [(mark if i == 0 else " " * len(mark)) + x if x else x for i, x in enumerate(inner)]
                    elif c.tag in ("dd", "blockquote"):
                        inner = ["    " + x if x else x for x in inner]
                    margin = c.tag in MARGIN and not (c.tag in ("ul", "ol", "menu", "dir") and depth)
                    if inner:
                        lines.extend([None, *inner, None] if margin else inner)

        inline(n, visible)
        flush()
        out: list[str] = []
        for x in lines:
            if x is None:
                if out and out[-1] != "":
                    out.append("")
            elif x != "" or pre or (out and out[-1] != ""):
                out.append(x)
        while out and out[-1] == "":
            out.pop()
        return out

    def table(self, n: Node, visible: bool, depth: int) -> list[str]:
        head: list[str] = []
        rows: list[Node] = []
        loose = Node("div", {})

        def gather(part: Node) -> None:
            for c in part.children:
                if isinstance(c, str):
                    if c.strip():
                        loose.children.append(c)
                elif self.unseen(c):
                    continue
                elif c.tag == "caption":
                    head.extend(self.block(c, visible, False, depth))
                elif c.tag == "tr":
                    rows.append(c)
                elif c.tag in ("thead", "tbody", "tfoot"):
                    gather(c)
                elif c.tag in ("td", "th"):
                    rows.append(Node("tr", {}))
                    rows[-1].children.append(c)
                elif c.tag not in ("col", "colgroup"):
                    loose.children.append(c)

        gather(n)
        grid: list[list[tuple[list[str], int]]] = []
        held: dict[int, int] = {}  # columns taken by cells from rows above
        for r in rows:
            cells, column = [], 0
            for c in r.children:
                if not isinstance(c, Node) or c.tag not in ("td", "th") or self.unseen(c):
                    continue
                while held.get(column, 0):
                    cells.append(([], column))
                    column += 1
                cells.append((self.block(c, visible, False, depth), column))
                wide, tall = (min(100, max(1, _number(c.attrs.get(x), 1))) for x in ("colspan", "rowspan"))
                for k in range(column, column + wide):
                    held[k] = max(held.get(k, 0), tall)
                column += wide
            held = {k: v - 1 for k, v in held.items() if v > 1}
            grid.append(cells)
        width: dict[int, int] = {}
        for cells in grid:
            for i, (text, column) in enumerate(cells):
                following = cells[i + 1][1] if i + 1 < len(cells) else column + 1
                if following == column + 1:
                    width[column] = max([width.get(column, 0), *map(len, text)])
        out = head + self.block(loose, visible, False, depth)
        for cells in grid:
            for k in range(max([len(t) for t, _ in cells], default=0)):
                line = ""
                for text, column in cells:
                    line = line.ljust(sum(width.get(c, 0) + 2 for c in range(column))) + (text[k] if k < len(text) else "")
                    line += "  "
                out.append(line.rstrip())
        return out


def _number(value: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", value or "")
    return int(m[1]) if m else default


def _start(n: Node) -> int:
    return _number(n.attrs.get("start"), 1)


def _options(n: Node) -> list[Node]:
    out = []
    for c in n.children:
        if isinstance(c, Node):
            out += [c] if c.tag == "option" else _options(c)
    return out


def render(page: str | None) -> str:
    if not page:
        return ""
    root, sheets = parse(page.replace("\0", ""))
    return "\n".join(x.rstrip() for x in Page(hidden_selectors(sheets)).block(root)).strip("\n")


def visible_text(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The kept columns and ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = pa.array([render(x) for x in part.column("_html").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), text], names=[*keep, "text"])

    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").cast("string").alias("_html"))
    schema = source.select(*[F.col(f"`{c}`") for c in keep], F.lit("").alias("text")).schema
    return source.mapInArrow(run, schema)
