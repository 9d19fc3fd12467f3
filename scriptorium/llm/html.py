"""HTML extraction by layout-aware rendering.

A tree builder with implied tags turns a page into elements; visibility rules prune it; the renderer emits every visible
text: blocks on lines of their own, a blank line around paragraphs and the like, list markers with indents, table cells
padded to their columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scriptorium.llm.common import slices

# Fixed values of the HTML standard: elements by their parsing and default display.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title datalist object iframe audio video canvas noembed noframes area param source track annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset menu dir hr".split())
LINES = frozenset("html body div section article aside nav header footer main address form li dt dd tr caption figcaption legend details summary center hgroup search optgroup option thead tbody tfoot mtable mtr".split())
CLOSES_P = SPACED | frozenset("address article aside center details dialog div fieldset figcaption figure footer form header hgroup main nav section summary".split())
#: A start tag closes these, if open, up to a boundary.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
HEAD_CONTENT = frozenset("base link meta script style title template noscript".split())
CELLS = frozenset(("td", "th"))
SCOPES = frozenset("table td th caption button object template".split())
GAP = "  "
#: In svg only text elements and embedded HTML show text, and these show none; in math these set their parts apart.
SVG_HIDDEN = frozenset("defs symbol clippath mask pattern marker metadata desc".split())
APART = frozenset("mfrac msub msup msubsup munder mover munderover mroot mmultiscripts mtr".split())
#: Where HTML may stand inside svg and math, and the tags that elsewhere end them.
EMBEDS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())

_none = re.compile(r"display\s*:\s*none", re.I)
_visibility = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_space = re.compile(r"[ \t\n\r\f]+")
_comment = re.compile(r"/\*.*?\*/|<!--|-->", re.S)
_at_rule = re.compile(r"@[^{};]*(?:;|\{(?:[^{}]|\{[^{}]*\})*\})")
_rule = re.compile(r"([^{}]+)\{([^{}]*)\}")
_said = re.compile(r"(?<![\w-])(display|visibility)\s*:\s*([^;]+)", re.I)
_simple = re.compile(r"(\*|[a-zA-Z][\w-]*|)((?:[.#][\w-]+)*)")


class Element:
    __slots__ = ("attrs", "children", "number", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None], number: int = 0):
        self.tag, self.attrs, self.children, self.number = tag, attrs, [], number


class Builder(HTMLParser):
    """The page's elements; end tags that nothing open matches are ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("html", {})
        self.open = [self.root]
        self.n_foreign, self.number = 0, 0

    def close_to(self, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        """Close what is open of tags, down to the innermost element of stop."""
        low = len(self.open)
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in stop and self.open[i].tag not in tags:
                break
            if self.open[i].tag in tags:
                low = i
        del self.open[low:]

    def foreign(self) -> int:
        """Where the svg or math begins that the next tag is in, 0 for none."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in EMBEDS or self.open[i].tag in SCOPES:
                return 0
            if self.open[i].tag in ("svg", "math"):
                return i
        return 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        if self.n_foreign and tag in BREAKS_OUT and (i := self.foreign()):
            while i:
                del self.open[i:]
                i = self.foreign()
        self.n_foreign += tag in ("svg", "math")
        if self.open[-1].tag == "head" and tag not in HEAD_CONTENT and tag != "head":
            self.open.pop()
        if tag in CLOSES_P:
            self.close_to({"p"}, SCOPES | EMBEDS)
        if tag in IMPLIED:
            self.close_to(*IMPLIED[tag])
        if tag in CELLS and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.handle_starttag("tr", [])
        self.number += 1
        e = Element(tag, dict(attrs), self.number)
        self.open[-1].children.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        """A slash closes only in svg and math."""
        closes = tag in ("svg", "math") or (self.n_foreign > 0 and self.foreign() > 0)
        self.handle_starttag(tag, attrs)
        if closes and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in SCOPES and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                return
            if self.open[i].tag == "table":
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self.open.pop()
        self.open[-1].children.append(data)


def build(html: str) -> Element:
    b = Builder()
    b.feed(html)
    b.close()
    apply_styles(b.root)
    return b.root


def elements(root: Element) -> Iterator[Element]:
    todo = [root]
    while todo:
        e = todo.pop()
        yield e
        todo.extend(c for c in e.children if isinstance(c, Element))


def rules(css: str) -> list[tuple[tuple[int, int, int], str, frozenset[str], str, dict[str, str]]]:
    """(weight, tag, classes, id, what it says of display and visibility) of rules by tag, class and id.

    Other selectors (by ancestors, attributes or states) and at-rules are left out.
    """
    out = []
    for names, body in _rule.findall(_at_rule.sub(" ", _comment.sub(" ", css))):
        said = {k.lower(): v.strip().lower().removesuffix("!important").strip() for k, v in _said.findall(body)}
        for name in names.split(",") if said else []:
            if m := _simple.fullmatch(name.strip()):
                tag, more = m[1].lower().replace("*", ""), re.findall(r"([.#])([\w-]+)", m[2])
                classes, ids = frozenset(n for k, n in more if k == "."), [n for k, n in more if k == "#"]
                if tag or more:
                    out.append(((len(ids), len(classes), bool(tag)), tag, classes, ids[-1] if ids else "", said))
    return sorted(out, key=lambda r: r[0])


def apply_styles(root: Element) -> None:
    """Writes what the page's style elements say of an element before what it says itself."""
    if not any(e.tag == "style" for e in elements(root)):
        return
    found = rules("\n".join("".join(c for c in e.children if isinstance(c, str)) for e in sorted(elements(root), key=lambda e: e.number) if e.tag == "style"))
    for e in elements(root) if found else ():
        classes, said = set((e.attrs.get("class") or "").split()), {}
        for _, tag, wanted, id_, what in found:
            if (not tag or tag == e.tag) and wanted <= classes and (not id_ or id_ == e.attrs.get("id")):
                said |= what
        if said:
            own = {k.lower(): v.strip() for k, v in _said.findall(e.attrs.get("style") or "")}
            e.attrs["style"] = ";".join(f"{k}:{v}" for k, v in (said | own).items())


class Page:
    """Text so far, and what stands before the next one: line breaks, a space, a list marker."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.breaks, self.space, self.marker, self.indent = 0, False, "", ""

    def block(self, breaks: int) -> None:
        self.breaks, self.space = max(self.breaks, breaks), False

    def put(self, text: str) -> None:
        lead = ""
        if self.out:
            lead = "\n" * self.breaks or (" " if self.space else "")
        if not self.out or self.breaks:
            lead += self.indent[: len(self.indent) - len(self.marker)] + self.marker
            self.marker = ""
        self.out.append(lead + text)
        self.breaks, self.space = 0, False

    def text(self, data: str, pre: bool) -> None:
        if pre:
            for i, line in enumerate(data.split("\n")):
                if i:
                    self.breaks += 1
                if line:
                    self.put(line.rstrip())
            return
        words = _space.sub(" ", data)
        if words.startswith(" "):
            self.space = not self.breaks
            words = words[1:]
        if words.rstrip(" "):
            self.put(words.rstrip(" "))
            self.space = words.endswith(" ")

    def done(self) -> str:
        return "".join(self.out)


def _hidden(e: Element) -> bool:
    if e.tag in HIDDEN or "hidden" in e.attrs:
        return True
    if e.tag == "input" and (e.attrs.get("type") or "").lower() == "hidden" or e.tag == "dialog" and "open" not in e.attrs:
        return True
    return bool(_none.search(e.attrs.get("style") or ""))


Cell = tuple[str, int, int]


def _span(e: Element, name: str, most: int) -> int:
    n = e.attrs.get(name) or ""
    n = int(n) if re.fullmatch(r"[0-9]{1,9}", n) else 1
    return most if n == 0 and name == "rowspan" else max(1, min(most, n))


def _placed(rows: list[list[Cell] | None]) -> list[list[tuple[int, str, int]]]:
    """Rows of (column, text, columns spanned); columns that a cell from above still fills are passed over, to the end of its group."""
    out, left = [], {}
    for row in rows:
        if row is None:
            left = {}
            continue
        at, cells, held = 0, [], {c: n - 1 for c, n in left.items() if n > 1}
        for text, span, down in row:
            while at in left:
                at += 1
            cells.append((at, text, span))
            if down > 1:
                held |= dict.fromkeys(range(at, at + span), down - 1)
            at += span
        out.append(cells)
        left = held
    return out


def _table(rows: list[list[Cell] | None]) -> list[str]:
    """Rows of cells as lines, each column as wide as the widest line of its cells of one column.

    A row's cells stand beside each other line by line; where one has a blank line, as around paragraphs, they follow
    each other as blocks.
    """
    placed = [(row, any("\n\n" in text for _, text, _ in row)) for row in _placed(rows)]
    width: dict[int, int] = {}
    for row, blocks in placed:
        for at, text, span in row:
            if span == 1 and not blocks:
                width[at] = max(width.get(at, 0), *map(len, text.split("\n")))
    lines = []
    for row, blocks in placed:
        if blocks:
            for _, text, _ in row:
                if text:
                    lines += [*([""] if lines else []), *text.split("\n")]
            lines.append("")
            continue
        cells = [(at, text.split("\n"), span) for at, text, span in row]
        for k in range(max((len(x) for _, x, _ in cells), default=0)):
            to, parts = 0, []
            for at, x, span in cells:
                parts += ["".ljust(width.get(c, 0)) for c in range(to, at)]
                parts.append((x[k] if k < len(x) else "").ljust(sum(width.get(c, 0) for c in range(at, at + span)) + len(GAP) * (span - 1)))
                to = at + span
            if line := GAP.join(parts).rstrip():
                lines.append(line)
    while lines and not lines[-1]:
        lines.pop()
    return lines


def render(root: Element) -> str:
    """All visible text of a tree; no recursion, so depth is no limit."""
    page = Page()
    pages: list[Page] = []
    tables: list[list[list[Cell] | None]] = []
    lists: list[list] = []  # of [ordered, next number, indent]
    pre, shown = 0, [True]
    modes = ["html"]  # "svg": where text isn't drawn; "label": svg's text elements
    todo: list[tuple[Element | str, bool]] = [(root, False)]
    while todo:
        e, leaving = todo.pop()
        if isinstance(e, str):
            if shown[-1] and modes[-1] != "svg":
                page.text(e, pre > 0)
            continue
        tag = e.tag
        if not leaving:
            if _hidden(e) or modes[-1] == "svg" and tag in SVG_HIDDEN:
                continue
            v = _visibility.search(e.attrs.get("style") or "")
            shown.append(v[1].lower() == "visible" if v else shown[-1])
            label = modes[-1] == "svg" and tag in ("text", "foreignobject")
            modes.append("svg" if tag == "svg" else ("label" if tag == "text" else "html") if label else modes[-1])
            todo.append((e, True))
            todo += [(x, False) for c in reversed(e.children) for x in ((" ", c) if tag in APART else (c,))]
            if label:
                page.block(1)
            if tag == "br":
                page.breaks, page.space = page.breaks + 1, False
            elif tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists):
                page.block(2)
            elif tag in LINES or tag in ("ul", "ol", "menu", "dir"):
                page.block(1)
            if tag == "pre":
                pre += 1
            elif tag == "img" and e.attrs.get("alt") and shown[-1]:
                page.text(e.attrs["alt"], False)
            elif tag == "input" and e.attrs.get("value") and shown[-1]:
                page.text(e.attrs["value"], False)
            elif tag in ("ul", "ol", "menu", "dir"):
                start = e.attrs.get("start") or ""
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1, page.indent])
            elif tag == "li" and lists:
                ordered, number, indent = lists[-1]
                page.marker = f"{number}. " if ordered else "- "
                lists[-1][1] += 1
                page.indent = indent + " " * len(page.marker)
            elif tag == "dd":
                page.indent += "  "
            elif tag == "blockquote":
                page.indent += "  "
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in CELLS and tables:
                pages.append(page)
                page = Page()
            continue
        shown.pop()
        modes.pop()
        if modes[-1] == "svg" and tag in ("text", "foreignobject"):
            page.block(1)
        if tag == "pre":
            pre -= 1
        elif tag in ("ul", "ol", "menu", "dir"):
            page.indent = lists.pop()[2]
        elif tag == "li" and lists:
            page.indent, page.marker = lists[-1][2], ""
        elif tag in ("dd", "blockquote"):
            page.indent = page.indent[:-2]
        elif tag in CELLS and tables:
            text, page = page.done(), pages.pop()
            if not tables[-1] or tables[-1][-1] is None:
                tables[-1].append([])
            tables[-1][-1].append((text, _span(e, "colspan", 1000), _span(e, "rowspan", 65534)))
        elif tag in ("thead", "tbody", "tfoot") and tables:
            tables[-1].append(None)
        elif tag == "table":
            page.block(1)
            for i, line in enumerate(_table(tables.pop())):
                page.breaks += i > 0
                if line:
                    page.put(line)
        if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists):
            page.block(2)
        elif tag in LINES or tag in ("ul", "ol", "menu", "dir"):
            page.block(1)
    return page.done()


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages without the markup, with the visible text.

    Null markup gives null, empty or markup without visible text an empty text.  Repeated rows render alike.  A column
    named like the text is replaced.
    """
    held = pages.drop(*[text] if text != html else [])
    schema = T.StructType([f for f in held.schema.fields if f.name != html] + [T.StructField(text, T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html):
                found = [None if h is None else render(build(h)) for h in part.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in part.schema.names if c != html] + [pa.array(found, pa.string())], names=schema.names)

    return held.mapInArrow(work, schema)
