"""Visible text of HTML pages, laid out as a browser would.

Method: tags are read into a tree with the implied tags put in; elements that are never
shown are left out; blocks, lists and tables are rendered with their spacing, markers and
aligned columns.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.batches import small_batches

#: Fixed lists of elements, after the public HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("head script style template noscript iframe object datalist canvas audio video title meta link base".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table ul".split()
)
LISTS = frozenset({"ul", "ol", "menu", "dir"})
#: Blocks with a blank line around them.
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir".split())
#: What an opening tag closes first, and the elements beyond which nothing is closed.
CLOSES = {
    "li": (frozenset({"li"}), frozenset("ul ol menu dir table".split())),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "thead": (frozenset("thead tbody tfoot tr td th".split()), frozenset({"table"})),
    "tbody": (frozenset("thead tbody tfoot tr td th".split()), frozenset({"table"})),
    "tfoot": (frozenset("thead tbody tfoot tr td th".split()), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "caption": (frozenset("caption thead tbody tfoot tr td th".split()), frozenset({"table"})),
    "body": (frozenset({"head"}), frozenset()),
}
#: What an opening part of a table leaves open at most.
CONTEXT = {
    **dict.fromkeys(("td", "th"), frozenset("table thead tbody tfoot tr".split())),
    "tr": frozenset("table thead tbody tfoot".split()),
    **dict.fromkeys("thead tbody tfoot caption colgroup".split(), frozenset({"table"})),
}
#: Where content outside cells is moved before the table, and what stays.
TABLE_PARTS = frozenset("table thead tbody tfoot tr colgroup".split())
IN_TABLE = frozenset("caption colgroup col thead tbody tfoot tr td th script style template".split())
#: What doesn't end the head.
IN_HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
#: Parts of drawings and formulas that aren't drawn.
NOT_DRAWN = {"svg": frozenset("defs desc metadata symbol clippath mask pattern marker".split()), "math": frozenset({"annotation", "annotation-xml"})}
#: Elements in which a closing slash counts.
FOREIGN = frozenset({"svg", "math"})
#: An opening block closes a paragraph that is open in the same container.
ENDS_PARAGRAPH = (frozenset({"p"}), frozenset("table td th li dd div section article blockquote button object caption".split()))

OPENS = re.compile(r"</?[A-Za-z]|<[!?/]")
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|=\s*[^\s>\"'][^\s>]*|[^>])*+)>|<[!?/][^>]*>")
#: A tag whose quotes don't count.
BARE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
GONE = re.compile(r"(?:^|[;{\s])display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|[;{\s])visibility\s*:\s*(hidden|collapse|visible)", re.I)
#: Rules of style sheets whose selector is one name, class or id, or a name with one of those.
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
SELECTOR = re.compile(r"([A-Za-z][A-Za-z0-9]*|\*)?([.#][A-Za-z_-][A-Za-z0-9_-]*)?\Z")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
WHITE = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Element:
    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Element | str] = field(default_factory=list)

    def shown(self, hiding: frozenset[str] = frozenset()) -> bool:
        """Whether the page has a place for it; ``hiding`` has selectors of its style sheets that leave out."""
        a = self.attributes
        if self.name in HIDDEN or self.name == "input" or "hidden" in a or (self.name == "dialog" and "open" not in a):
            return False
        style = a.get("style", "")
        if style and GONE.search(style):
            return False
        return not (hiding and self.selected(hiding))

    def selected(self, selectors: frozenset[str]) -> bool:
        a = self.attributes
        names = ["", *(f".{c}" for c in a.get("class", "").split()), *([f"#{a['id']}"] if a.get("id") else [])]
        return any(f"{e}{n}" in selectors for e in ("", self.name) for n in names if e or n)

    def visible(self, blanking: frozenset[str] = frozenset()) -> bool | None:
        """What its style says of the visibility of its text, which it hands on; None if nothing."""
        last = None
        style = self.attributes.get("style", "")
        for m in VISIBILITY.finditer(style) if style else ():
            last = m[1].lower() == "visible"
        return False if last is None and blanking and self.selected(blanking) else last


def _selectors(sheets: list[str], rule_hides: Callable[[str], bool]) -> frozenset[str]:
    """Simple selectors of the style rules in question; other rules are passed over."""
    out = set()
    for sheet in sheets:
        for selectors, rule in RULE.findall(COMMENT.sub(" ", sheet)):
            if rule_hides(rule):
                found = (SELECTOR.match(x.strip()) for x in selectors.split(","))
                out |= {f"{'' if m[1] in (None, '*') else m[1].lower()}{m[2] or ''}" for m in found if m and m[0]}
    return frozenset(out - {""})


def hiding_selectors(sheets: list[str]) -> frozenset[str]:
    """Selectors of what has no place on the page."""
    return _selectors(sheets, lambda rule: bool(GONE.search(rule)))


def blanking_selectors(sheets: list[str]) -> frozenset[str]:
    """Selectors of what has a place but isn't seen."""
    return _selectors(sheets, lambda rule: any(m[1].lower() != "visible" for m in VISIBILITY.finditer(rule)))


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(next((v for v in m.groups()[1:] if v is not None), "")) for m in ATTRIBUTE.finditer(text)} if text.strip() else {}


class _Open:
    """The elements that are open, with the depths of each name: no step walks all of them."""

    def __init__(self, root: Element) -> None:
        self.stack = [root]
        self.depths: dict[str, list[int]] = {}

    def push(self, e: Element) -> None:
        self.depths.setdefault(e.name, []).append(len(self.stack))
        self.stack.append(e)

    def cut(self, depth: int) -> None:
        """Closes the elements from a depth on."""
        while len(self.stack) > depth:
            self.depths[self.stack.pop().name].pop()

    def deepest(self, names: Iterable[str]) -> int:
        """The depth of the innermost element of these names, 0 if there is none."""
        return max((self.depths[n][-1] for n in names if self.depths.get(n)), default=0)

    def outermost(self, names: Iterable[str], beyond: int) -> int:
        """The depth of the outermost element of these names below the depth ``beyond``, 0 if there is none."""
        return min((d[bisect.bisect_right(d, beyond)] for n in names if (d := self.depths.get(n)) and d[-1] > beyond), default=0)

    @property
    def top(self) -> Element:
        return self.stack[-1]


def parse(page: str) -> Element:
    """The tree of a page; tags that are implied or missing are put in.

    Takes time in proportion to the page: a tag's end is looked for once, and if there is none
    up to the end of the page, quotes don't count from there on.
    """
    root = Element("html")
    opened = _Open(root)

    def close(names: frozenset[str], stop: frozenset[str]) -> None:
        """All elements of these names that are open within the innermost one of ``stop``."""
        depth = opened.outermost(names, opened.deepest(stop - names))
        if depth:
            opened.cut(depth)

    def add(child: Element | str) -> None:
        """Into the innermost element, or before the table whose cells it is outside of."""
        if opened.top.name in TABLE_PARTS and (child.strip() if isinstance(child, str) else child.name not in IN_TABLE):
            depth = opened.deepest(("table",))
            if depth:
                around = opened.stack[depth - 1].children
                around.insert(next(i for i in range(len(around) - 1, -1, -1) if around[i] is opened.stack[depth]), child)
                return
        opened.top.children.append(child)

    def text(value: str) -> None:
        if value:
            if opened.top.name == "head" and value.strip():
                opened.cut(len(opened.stack) - 1)
            add(html.unescape(value) if "&" in value else value)

    at, look, end, last, tag = 0, 0, len(page), page.rfind(">"), TAG
    while at < end:
        begin = page.find("<", look)
        if begin < 0:
            text(page[at:])
            break
        if page.startswith("<!--", begin):
            stop = page.find("-->", begin + 4)
            text(page[at:begin])
            at = look = stop + 3 if stop >= 0 else end
            continue
        if not OPENS.match(page, begin):
            look = begin + 1
            continue
        if begin > last:
            text(page[at:])
            break
        m = tag.match(page, begin)
        if not m:
            tag = BARE
            m = tag.match(page, begin)
        if not m:
            look = begin + 1
            continue
        text(page[at:begin])
        at = look = m.end()
        name = (m[2] or "").lower()
        if not name or name == "html":
            if name and not m[1]:
                root.attributes.update(_attributes(m[3]))
            continue
        if m[1]:
            depth = opened.deepest((name,))
            if name in ("p", "br") and not depth:
                add(Element(name))
            elif depth and (name in ("table", "tr", "thead", "tbody", "tfoot") or depth >= opened.deepest(("td", "th", "table"))):
                opened.cut(depth)
            continue
        if name in CLOSES:
            close(*CLOSES[name])
        if name in BLOCK:
            close(*ENDS_PARAGRAPH)
        if opened.top.name == "head" and name not in IN_HEAD:
            opened.cut(len(opened.stack) - 1)
        table = opened.deepest(("table",))
        if name in CONTEXT and table:
            while opened.top.name not in CONTEXT[name]:
                opened.cut(len(opened.stack) - 1)
        if opened.top.name in TABLE_PARTS and table:
            if name == "form":
                continue
            if name == "table":
                opened.cut(table)
        if name in ("td", "th") and opened.top.name in ("table", "thead", "tbody", "tfoot"):
            row = Element("tr")
            opened.top.children.append(row)
            opened.push(row)
        element = Element(name, _attributes(m[3]))
        for drawing, parts in NOT_DRAWN.items():
            if name in parts and opened.deepest((drawing,)):
                element.attributes["hidden"] = ""
        add(element)
        if name in VOID or (m[3].endswith("/") and (name in FOREIGN or opened.deepest(FOREIGN))):
            continue
        if name == "plaintext":
            element.children.append(page[at:])
            break
        if name in RAW:
            closing = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            stop = closing.start() if closing else end
            element.children.append(html.unescape(page[at:stop]) if name in ("textarea", "title") else page[at:stop])
            over = page.find(">", stop) if closing else -1
            at = look = over + 1 if over >= 0 else (end if not closing else stop + len(name) + 2)
            continue
        opened.push(element)
    return root


def blank_unseen(root: Element, blanking: frozenset[str]) -> None:
    """Takes the text out of what has a place on the page but isn't seen; a visible element within it is."""
    todo = [(root, True)]
    while todo:
        e, seen = todo.pop()
        own = e.visible(blanking)
        seen = seen if own is None else own
        if not seen:
            e.attributes.pop("alt", None)
            e.children = [c for c in e.children if isinstance(c, Element)]
        todo.extend((c, seen) for c in e.children if isinstance(c, Element))


#: Columns that lines are indented by at most, and tables within cells that are laid out as tables.
MARGIN, TABLES = 160, 16


class Layout:
    """Lines of a block, with inline text flowing into the last one; in ``plain`` ones as it stands."""

    def __init__(self, plain: bool = False, depth: int = 0) -> None:
        self.plain, self.depth = plain, depth
        self.lines: list[str] = []
        self.open: list[str] = []
        self.gap = 0
        #: Blank columns before lines; what the next line has instead, from a column on.
        self.margin, self.marks, self.marked = 0, [], 0
        #: Lines before the indented block that is open; there is no gap at its beginning.
        self.base = 0

    def inline(self, value: str) -> None:
        if self.plain:
            for k, piece in enumerate(value.replace("\r\n", "\n").split("\n")):
                if k:
                    self.end_line(force=True)
                if piece:
                    self.open.append(piece)
            return
        value = WHITE.sub(" ", value)
        if not self.open or self.open[-1].endswith(" "):
            value = value.lstrip(" ")
        if value:
            self.open.append(value)

    def end_line(self, force: bool = False) -> None:
        line = "".join(self.open) if self.plain else "".join(self.open).strip(" ")
        self.open = []
        if line or force:
            self.put([line])

    def put(self, lines: list[str]) -> None:
        if lines:
            if self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            head = " " * min(self.margin, MARGIN)
            if self.marks:
                self.lines.append(f"{' ' * min(self.marked, MARGIN)}{''.join(self.marks)}{lines[0]}")
                self.marks, lines = [], lines[1:]
            self.lines += [f"{head}{line}" if line else "" for line in lines] if head else lines

    def space(self, blank: bool) -> None:
        self.end_line()
        if len(self.lines) > self.base:
            self.gap = max(self.gap, 1 if blank else 0)

    def indent(self, mark: str, columns: int) -> Callable[[], None]:
        """Begins an indented block whose first line has the mark; the result ends it."""
        if mark or self.marks:
            self.marked = self.marked if self.marks else self.margin
            self.marks.append(mark or " " * columns)
        before = self.base
        self.base, self.margin = len(self.lines), self.margin + columns

        def done() -> None:
            self.end_line(force=bool(mark) and bool(self.marks))
            if self.marks:
                self.marks.pop()
            if len(self.lines) > self.base:
                self.gap = 0
            self.base, self.margin = before, self.margin - columns

        return done


class Cells:
    """Rows of a table that is being walked; ``below`` has columns taken by cells from rows above."""

    def __init__(self, plain: bool = False, depth: int = 0) -> None:
        self.plain, self.depth = plain, depth
        self.rows: list[list[list[str]]] = []
        self.captions: list[str] = []
        self.below: dict[int, int] = {}

    def skip(self, cells: list[list[str]]) -> None:
        while self.below.get(len(cells), 0) > 0:
            self.below[len(cells)] -= 1
            cells.append([])

    def put(self, element: Element, lines: list[str]) -> None:
        cells = self.rows[-1]
        self.skip(cells)
        at = len(cells)
        cells.append(lines)
        span, down = (element.attributes.get(a, "1") for a in ("colspan", "rowspan"))
        # limits of the HTML standard
        cells += [[]] * (min(int(span), 1000) - 1 if span.isdecimal() else 0)
        if down.isdecimal() and int(down) != 1:
            self.below.update(dict.fromkeys(range(at, len(cells)), min(int(down) or 65534, 65534) - 1))

    def lines(self) -> list[str]:
        """The rows with their cells in aligned columns, after the caption."""
        widths: dict[int, int] = {}
        for row in self.rows:
            for i, cell in enumerate(row):
                widths[i] = max(widths.get(i, 0), max(map(columns_of, cell), default=0))
        out = list(self.captions)
        for row in self.rows:
            for k in range(max((len(c) for c in row), default=0)):
                texts = [cell[k] if k < len(cell) else "" for cell in row]
                parts = [t + " " * (widths[i] - columns_of(t)) for i, t in enumerate(texts)]
                out.append("  ".join(parts).rstrip(" "))
        return out


def columns_of(text: str) -> int:
    """How many columns a text takes where every character takes none, one or two."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def chosen_options(select: Element) -> list[Element]:
    """Options that a closed list shows: the last selected one, else the first; those of an open list all."""
    found: list[Element] = []
    todo = select.children[::-1]
    while todo:
        c = todo.pop()
        if isinstance(c, Element):
            if c.name == "option":
                found.append(c)
            elif c.name == "optgroup":
                todo.extend(reversed(c.children))
    size = select.attributes.get("size", "")
    if "multiple" in select.attributes or (size.isdecimal() and int(size) > 1):
        return found
    return ([o for o in found if "selected" in o.attributes] or found[:1])[-1:]


def lines_of(root: Element, hiding: frozenset[str] = frozenset()) -> list[str]:
    """The rendered lines of an element's content.

    Content is walked with a stack of its own, so that elements may nest to any depth.  Lines
    are indented by ``MARGIN`` columns at most, and within ``TABLES`` tables the cells of a row
    follow each other without columns: no line is handled at every level above it.  The stack
    holds elements still to come and what is to be done after an element's content:
    (layout, element, parent) or (None, action, None).
    """
    top = Layout()
    todo: list[tuple] = []
    numbers: dict[int, tuple[int, int]] = {}

    def later(action: Callable[[], None]) -> None:
        todo.append((None, action, None))

    def inside(e: Element, layout: Layout) -> None:
        todo.extend((layout, child, e) for child in reversed(e.children))

    def block(e: Element, layout: Layout, blank: bool, mark: str, columns: int) -> None:
        """The content of ``e`` as indented lines."""
        layout.space(blank)
        end = layout.indent(mark, columns)

        def done() -> None:
            end()
            layout.space(blank)

        later(done)
        inside(e, layout)

    def rows_of(e: Element, cells: Cells) -> None:
        for child in reversed(e.children):
            if isinstance(child, Element) and child.shown(hiding):
                todo.append((cells, child, e))

    def table_part(cells: Cells, e: Element, parent: Element) -> None:
        if e.name in ("td", "th") and parent.name == "tr":
            inner = Layout(cells.plain, cells.depth + 1)

            def done() -> None:
                inner.end_line()
                cells.put(e, inner.lines)

            later(done)
            inside(e, inner)
        elif e.name == "tr":
            cells.rows.append([])
            later(lambda: cells.skip(cells.rows[-1]))
            rows_of(e, cells)
        elif e.name == "caption":
            inner = Layout(cells.plain, cells.depth + 1)

            def captioned() -> None:
                inner.end_line()
                cells.captions.extend(inner.lines)

            later(captioned)
            inside(e, inner)
        else:
            if e.name in ("thead", "tbody", "tfoot"):
                later(cells.below.clear)
            rows_of(e, cells)

    inside(root, top)
    while todo:
        layout, child, parent = todo.pop()
        if layout is None:
            child()
            continue
        if isinstance(layout, Cells):
            table_part(layout, child, parent)
            continue
        if isinstance(child, str):
            layout.inline(child)
            continue
        if not child.shown(hiding):
            continue
        name = child.name
        if name == "br":
            layout.end_line(force=True)
        elif name == "hr":
            layout.space(True)
            layout.put(["---"])
            layout.space(True)
        elif name == "img":
            layout.inline(child.attributes.get("alt", ""))
        elif name in ("pre", "plaintext") and not layout.plain:
            layout.space(True)
            inner = Layout(True, layout.depth)

            def set_out(inner: Layout = inner, layout: Layout = layout) -> None:
                inner.end_line()
                layout.put("\n".join(inner.lines).strip("\n").split("\n"))
                layout.space(True)

            later(set_out)
            inside(child, inner)
        elif name == "select":
            for option in reversed(chosen_options(child)):
                todo.append((layout, " ", child))
                todo.append((layout, option, child))
        elif name == "table" and layout.depth < TABLES:
            layout.space(True)
            cells = Cells(layout.plain, layout.depth)

            def tabled(cells: Cells = cells, layout: Layout = layout) -> None:
                layout.put(cells.lines())
                layout.space(True)

            later(tabled)
            rows_of(child, cells)
        elif name == "li":
            number, step = numbers.get(id(parent)) or _first_number(parent)
            if re.fullmatch("-?[0-9]{1,9}", child.attributes.get("value", "")):
                number = int(child.attributes["value"])
            numbers[id(parent)] = number + step, step
            mark = f"{number}. " if parent.name == "ol" else "- "
            block(child, layout, False, mark, len(mark))
        elif name in ("blockquote", "dd"):
            block(child, layout, name in SPACED, "", 4)
        elif name in ("td", "th"):
            layout.inline(" ")
            inside(child, layout)
        elif name in BLOCK or name in ("tr", "caption"):
            blank = name in SPACED and not (name in LISTS and parent.name == "li")
            layout.space(blank)
            later(lambda layout=layout, blank=blank: layout.space(blank))
            inside(child, layout)
        else:
            inside(child, layout)
    top.end_line()
    return top.lines


def _first_number(items: Element) -> tuple[int, int]:
    """The number of a list's first item, and the step to the next."""
    back = items.name == "ol" and "reversed" in items.attributes
    if items.name == "ol" and re.fullmatch("-?[0-9]{1,9}", items.attributes.get("start", "")):
        return int(items.attributes["start"]), -1 if back else 1
    return (sum(isinstance(c, Element) and c.name == "li" for c in items.children), -1) if back else (1, 1)


def style_sheets(root: Element) -> list[str]:
    """The text of all style elements."""
    out: list[str] = []
    todo = [root]
    while todo:
        e = todo.pop()
        if e.name == "style":
            out += [c for c in e.children if isinstance(c, str)]
        todo.extend(c for c in e.children if isinstance(c, Element))
    return out


def rendered(tree: Element) -> str:
    sheets = style_sheets(tree)
    blank_unseen(tree, blanking_selectors(sheets))
    lines = [line.rstrip(" ") for line in lines_of(tree, hiding_selectors(sheets))]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


def render(page: str) -> str:
    """The visible text of a page."""
    return rendered(parse(page))


def title_in(tree: Element) -> str | None:
    """The text of the first title that isn't a drawing's."""
    todo = [tree]
    while todo:
        e = todo.pop()
        if e.name == "title":
            return WHITE.sub(" ", "".join(c for c in e.children if isinstance(c, str))).strip()
        if e.name not in FOREIGN:
            todo.extend(c for c in reversed(e.children) if isinstance(c, Element))
    return None


def title_of(page: str) -> str | None:
    return title_in(parse(page))


def extract(df: DataFrame, html_col: str = "html", into: tuple[str, str] = ("title", "text")) -> DataFrame:
    """``df`` without its HTML, with each page's title and visible text.

    A null page gives null title and text; an empty one, or one that shows nothing, an empty
    text.  Markup that ends early or nests wrongly is mended as far as the tree goes; elements
    may nest to any depth.  Rows, repeated or not, keep their other columns;
    a column with the name of a new one is replaced.  An empty table gives an empty one.
    """
    kept = df.drop(*(c for c in into if c != html_col))
    rest = [f for f in kept.schema.fields if f.name != html_col]
    schema = T.StructType([*rest, T.StructField(into[0], T.StringType()), T.StructField(into[1], T.StringType())])
    ordered = kept.select(*(F.col(f"`{f.name}`") for f in rest), F.col(html_col).cast("string").alias("_page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(batch.num_columns - 1).to_pylist()
            trees = [None if p is None else parse(p) for p in pages]
            titles = [None if t is None else title_in(t) for t in trees]
            texts = [None if t is None else rendered(t) for t in trees]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(titles, pa.string()), pa.array(texts, pa.string())], names=schema.names)

    return small_batches(ordered).mapInArrow(run, schema)
