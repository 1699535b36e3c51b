"""Layout-aware HTML rendering: a tree with implied tags, visibility, and text laid out as blocks, lists and tables."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread

# Elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
TEXT_ONLY = frozenset("title textarea".split())
HIDDEN = frozenset("head script style template noscript noembed noframes iframe object video audio canvas datalist title meta link area param source track col colgroup".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table ul caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre listing figure fieldset table menu dir hr".split())
PRE = frozenset("pre textarea listing xmp plaintext".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = (BLOCK - frozenset("body html option optgroup legend caption".split())) | {"xmp"}
# An opening tag ends these open elements, unless one of the bounds is met first.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "caption": ({"caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
    "a": ({"a"}, {"td", "th", "table"}),
    "button": ({"button"}, {"td", "th", "table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
# An end tag looks no further up than these.
SCOPE = frozenset("table td th caption html template button object".split())
INLINE_SCOPE = SCOPE - {"button"}
MARKED = frozenset("a style title".split())
FORMATS = frozenset("b i em strong span font u a small code tt".split())
FORMAT_SCOPE = INLINE_SCOPE | BLOCK
HEAD_ONLY = frozenset("html head title base link meta style script noscript template".split())
#: Bounds of the layout alone, beyond which all text stays: columns that nesting may indent a line by, and tables
#: in each other whose cells are aligned (rows of deeper ones are plain lines).
INDENT, ALIGNED = 160, 16

# possessive throughout, so that a tag is read once; a quote that is not closed is an ordinary character
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_DECLARED = re.compile(r"(?:^|;)\s*+(display|visibility)\s*+:\s*+([a-z-]++)\s*+(!\s*+important)?", re.I)
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*+|\*)?((?:[.#][\w-]++)*+)")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def get(self, name: str) -> str | None:
        for m in _ATTRIBUTE.finditer(self.attrs):
            if m[1].lower() == name:
                return entities.unescape(next((x for x in m.groups()[1:] if x is not None), ""))
        return None


class Root(Node):
    """The root of a page's tree; marked: its anchors, titles and styles, in the order of the page."""

    __slots__ = ("marked",)

    def __init__(self):
        super().__init__("html")
        self.marked: list[Node] = []


class Open:
    """The open elements, and where each tag stands among them, so that a look up the stack costs the same at any depth."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], {root.tag: [0]}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            self.at[self.nodes.pop().tag].pop()

    def last(self, tag: str) -> int:
        """The place of the innermost one, or 0, which is the root."""
        places = self.at.get(tag)
        return places[-1] if places else 0

    def innermost(self, tags) -> int:
        return max((self.last(t) for t in tags), default=0)

    def close(self, tags, bounds) -> bool:
        """Ends the innermost element of tags, unless one of the bounds lies inside of it."""
        place = self.innermost(tags)
        if not place or (place < len(self.nodes) - 1 and self.innermost(bounds) > place):
            return False
        self.cut(place)
        return True

    def outermost(self, tags, above: int) -> int | None:
        """The place of the outermost element of tags that lies inside of the one at `above`."""
        found = [p[k] for p in map(self.at.get, tags) if p and (k := bisect_right(p, above)) < len(p)]
        return min(found, default=None)


def parse(text: str) -> Root:
    """The tree of a page. Tags left out are implied; what is broken still gives a tree with all text."""
    root = Root()
    opened, at, size = Open(root), 0, len(text)
    stack = opened.nodes
    stops: dict[str, re.Pattern] = {}

    def put(data: str) -> None:
        top = stack[-1]
        if top.tag in ("table", "tbody", "thead", "tfoot", "tr", "colgroup") and data.strip() and (i := opened.last("table")):
            # text has no place between cells: it goes before the table
            home = stack[i - 1].kids
            home.insert(next((k for k in range(len(home) - 1, -1, -1) if home[k] is stack[i]), len(home)), data)
            return
        top.kids.append(data)

    def words(data: str) -> None:
        if stack[-1].tag == "head" and data.strip():
            opened.cut(len(stack) - 1)
        put(entities.unescape(data) if "&" in data else data)

    while at < size:
        mark = text.find("<", at)
        if mark < 0:
            words(text[at:])
            break
        if mark > at:
            words(text[at:mark])
        following = text[mark + 1 : mark + 2]
        closing = following == "/"
        letter = text[mark + 2 : mark + 3] if closing else following
        if not (letter.isascii() and letter.isalpha()):
            if following == "!" and text.startswith("--", mark + 2):
                stop = mark + 5 if text.startswith(">", mark + 4) else mark + 6 if text.startswith("->", mark + 4) else -1
                if stop < 0:
                    stop = text.find("-->", mark + 4) + 3
                at = stop if stop > 2 else size  # a comment that is not closed runs to the end
            elif following in ("!", "?") or (closing and letter):
                stop = text.find(">", mark)
                at = stop + 1 if stop >= 0 else size
            else:
                words("<")
                at = mark + 1
            continue
        m = _TAG.match(text, mark)
        if m is None:  # a tag that is not closed: nothing after it counts
            break
        at = m.end()
        end, tag = (m[2], None) if m[1] else (None, m[2])
        if end:
            end = end.lower()
            if end == "br":
                stack[-1].kids.append(Node("br"))
            elif end in HEADINGS:
                opened.close(HEADINGS, SCOPE)
            elif end == "p":
                if not opened.close(("p",), SCOPE):
                    stack[-1].kids.append(Node("p"))
            elif end in ("body", "html"):
                pass  # what follows still belongs to the body
            elif end in ("table", "tr", "tbody", "thead", "tfoot"):
                opened.close((end,), () if end == "table" else ("table",))
            elif end in ("td", "th"):
                opened.close((end,), ("table", "tr"))
            elif end in BLOCK:
                opened.close((end,), SCOPE - {end})
            else:
                opened.close((end,), FORMAT_SCOPE if end in FORMATS else INLINE_SCOPE)
            continue
        tag, attrs = tag.lower(), m[3] or ""
        if tag == "html" or (tag == "body" and opened.last("body")):
            continue
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            opened.cut(len(stack) - 1)
        if tag in CLOSES_P and opened.last("p"):
            opened.close(("p",), SCOPE)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            opened.cut(len(stack) - 1)
        if tag in IMPLIED:
            ends, bounds = IMPLIED[tag]
            outer = opened.outermost(ends, max(opened.innermost(bounds), opened.last("table")))
            if outer is not None:
                opened.cut(outer)
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr")
            stack[-1].kids.append(row)
            opened.push(row)
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in VOID:
            continue
        if tag in MARKED:
            root.marked.append(node)
        if tag in RAW or tag in TEXT_ONLY or tag == "plaintext":
            if tag not in stops:
                stops[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I)
            stop = stops[tag].search(text, at) if tag != "plaintext" else None
            body = text[at : stop.start() if stop else size]
            at = stop.end() if stop else size
            node.kids.append(entities.unescape(body) if tag in TEXT_ONLY else body)
            continue
        if attrs.endswith("/") and tag in ("svg", "path", "circle", "rect", "g", "use", "line"):
            continue
        opened.push(node)
    return root


def declared(style: str) -> dict[str, tuple[bool, str]]:
    """What declarations say of display and visibility: whether with `!important`, and the value."""
    out: dict[str, tuple[bool, str]] = {}
    for m in _DECLARED.finditer(style):
        name, strong = m[1].lower(), m[3] is not None
        if strong or not out.get(name, (False,))[0]:
            out[name] = strong, m[2].lower()
    return out


class Sheet:
    """A page's rules on display and visibility whose selectors are a tag, classes or ids, or one element's tag with these.

    Rules within at-rules, and selectors that look at other elements, attributes or states, are left out.
    """

    def __init__(self, root: Root):
        self.rules: dict[str, list] = {}
        self.n = 0
        for node in root.marked:
            if node.tag == "style" and node.kids and (node.get("media") or "all").strip().lower() in ("all", "screen", ""):
                self.add(_COMMENT.sub(" ", "".join(k for k in node.kids if type(k) is str)))

    def add(self, css: str) -> None:
        at = 0
        while (brace := css.find("{", at)) >= 0:
            head = css[at:brace].rsplit(";", 1)[-1].strip()
            end, depth = css.find("}", brace), 1
            if head.startswith("@"):
                for m in re.compile("[{}]").finditer(css, brace + 1):
                    depth += 1 if m[0] == "{" else -1
                    if not depth:
                        end = m.start()
                        break
                else:
                    return
            at = end + 1 if end >= 0 else len(css)
            said = {} if head.startswith("@") else declared(css[brace + 1 : end if end >= 0 else len(css)])
            if said:
                for one in head.split(","):
                    self.rule(one.strip(), said)

    def rule(self, selector: str, said: dict) -> None:
        m = _SELECTOR.fullmatch(selector)
        if not selector or m is None:
            return
        parts = re.findall(r"[.#][\w-]+", m[2])
        tag = (m[1] or "*").lower()
        weight = (sum(p[0] == "#" for p in parts), sum(p[0] == "." for p in parts), int(tag != "*"))
        self.n += 1
        self.rules.setdefault(parts[0] if parts else tag, []).append((tag, set(parts), weight, self.n, said))

    def of(self, node: Node) -> dict[str, tuple]:
        """For each property that some rule sets: (important, not inline, weight, order, value) of the rule that wins."""
        own = {"." + c for c in (node.get("class") or "").split()} if "class" in node.attrs.lower() else set()
        if "id" in node.attrs.lower() and (name := node.get("id")):
            own.add("#" + name)
        best: dict[str, tuple] = {}
        for key in (node.tag, "*", *own):
            for tag, parts, weight, n, said in self.rules.get(key, ()):
                if tag in ("*", node.tag) and parts <= own:
                    for name, (strong, value) in said.items():
                        best[name] = max(best.get(name, (False,)), (strong, False, weight, n, value))
        return best


def shown(node: Node, sheet: Sheet) -> tuple[bool, bool | None]:
    """Whether an element is laid out at all, and the visibility it sets for itself and what it holds (None: inherited)."""
    if node.tag in HIDDEN or node.tag == "input":
        return False, None
    a = node.attrs
    if not a and not sheet.rules:
        return True, None
    best = sheet.of(node) if sheet.rules else {}
    lower = a.lower()
    if "style" in lower and (style := node.get("style")):
        for name, (strong, value) in declared(style).items():
            best[name] = max(best.get(name, (False,)), (strong, True, (), 0, value))
    if "display" in best:
        laid = best["display"][-1] != "none"
    else:
        laid = not ("hidden" in lower and (value := node.get("hidden")) is not None and value.lower() != "until-found")
    said = best["visibility"][-1] if "visibility" in best else None
    return laid, {"visible": True, "initial": True, "hidden": False, "collapse": False}.get(said)


class Page:
    """Lines of text with their margins, as blocks are laid out below each other."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0  # empty lines owed before the next text
        self.prefix = ""  # indent of the block's lines
        self.mark = ""  # a list item's mark, for its first line
        self.space = False

    def text(self, data: str, pre: bool) -> None:
        if pre:
            parts = data.split("\n")
            for i, p in enumerate(parts):
                if i:
                    self.line(True)
                if p:
                    self.now.append(p)
            return
        # most texts have single spaces alone
        words = _SPACES.sub(" ", data) if "\n" in data or "  " in data or "\t" in data or "\f" in data or "\r" in data else data
        if words[:1] == " ":
            self.space = True
            words = words[1:]
        if words:
            trail = words[-1] == " "
            if self.space and self.now:
                self.now.append(" ")
            self.now.append(words[:-1] if trail else words)
            self.space = trail

    def line(self, forced: bool = False) -> None:
        """Ends the line; forced: an empty one counts."""
        body = "".join(self.now).rstrip(" \t")
        self.now, self.space = [], False
        if body or forced or self.mark:
            if self.gap and self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            lead = self.prefix
            if self.mark:
                lead = lead[: max(0, len(lead) - len(self.mark))] + self.mark
                self.mark = ""
            self.lines.append((lead + body).rstrip())

    def block(self, spaced: bool) -> None:
        self.line() if self.now else None
        if spaced:
            self.gap = 1


class Place:
    """What is inherited where a node stands: preformatted, depths of lists and tables, visibility."""

    __slots__ = ("lists", "pre", "seen", "tables")

    def __init__(self, pre: bool = False, lists: int = 0, tables: int = 0, seen: bool = True):
        self.pre, self.lists, self.tables, self.seen = pre, lists, tables, seen


def _run(task):
    """Runs a generator whose yielded generators are run in its place, so that nesting costs no stack."""
    stack, value = [task], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as e:
            stack.pop()
            value = e.value
    return value


def _deeper(page: Page, by: str) -> str:
    return page.prefix + by if len(page.prefix) + len(by) <= INDENT else page.prefix


def _render(kids: list, page: Page, at: Place, sheet: Sheet):
    for kid in kids:
        if type(kid) is str:
            if at.seen:
                page.text(kid, at.pre)
            continue
        tag = kid.tag
        if tag == "br":
            if at.seen:
                page.line(True)
            continue
        if tag == "wbr":
            continue
        laid, own = shown(kid, sheet)
        if not laid or (tag == "dialog" and kid.get("open") is None):
            continue
        if own is None or own == at.seen:
            here = at
        else:
            here = Place(at.pre, at.lists, at.tables, own)
        if tag == "details" and kid.get("open") is None:
            page.block(False)
            summary = next((k for k in kid.kids if type(k) is not str and k.tag == "summary"), None)
            if summary is not None:
                laid, own = shown(summary, sheet)
                if laid:
                    yield _render(summary.kids, page, here if own is None else Place(here.pre, here.lists, here.tables, own), sheet)
            page.block(False)
        elif tag == "table" and at.tables < ALIGNED:
            page.block(True)
            for line in (yield table_lines(kid, here, sheet)):
                page.now = [line]
                page.line(not line)
            page.block(True)
        elif tag in ("ul", "ol", "menu", "dir"):
            page.block(at.lists == 0)
            yield _items(kid, page, here, sheet)
            page.block(at.lists == 0)
        elif tag == "hr":
            page.block(True)
        elif tag in BLOCK or tag in PRE or (tag == "tr" and at.tables >= ALIGNED):
            keep = page.prefix
            page.block(tag in SPACED)
            if tag in ("blockquote", "dd"):
                page.prefix = _deeper(page, "  ")
            inside = kid.kids
            if tag in PRE:
                here = Place(True, here.lists, here.tables, here.seen)
                if inside and type(inside[0]) is str and inside[0][:1] == "\n":
                    inside = [inside[0][1:], *inside[1:]]
            if len(inside) == 1 and type(inside[0]) is str:
                if here.seen:
                    page.text(inside[0], here.pre)
            else:
                yield _render(inside, page, here, sheet)
            page.block(tag in SPACED)
            page.prefix = keep
        elif tag in ("td", "th", "tr", "tbody", "thead", "tfoot"):
            page.text(" ", False)
            yield _render(kid.kids, page, here, sheet)
            page.text(" ", False)
        elif len(kid.kids) == 1 and type(kid.kids[0]) is str:
            if here.seen:
                page.text(kid.kids[0], here.pre)
        else:
            yield _render(kid.kids, page, here, sheet)


def _items(node: Node, page: Page, at: Place, sheet: Sheet):
    numbered = node.tag == "ol"
    inside = Place(at.pre, at.lists + 1, at.tables, at.seen)
    states = [shown(k, sheet) if type(k) is not str and k.tag == "li" else (False, None) for k in node.kids]
    step = -1 if numbered and node.get("reversed") is not None else 1

    def whole(value: str | None, other: int) -> int:
        return int(value) if value is not None and re.fullmatch(r"\s*[+-]?[0-9]{1,9}\s*", value) else other

    n = whole(node.get("start"), sum(laid for laid, _ in states) if step < 0 else 1) if numbered else 0
    for kid, (laid, own) in zip(node.kids, states, strict=True):
        if type(kid) is str:
            if at.seen:
                page.text(kid, at.pre)
        elif kid.tag != "li":
            keep = page.prefix
            if kid.tag in ("ul", "ol", "menu", "dir"):
                page.prefix = _deeper(page, "  ")
            yield _render([kid], page, inside, sheet)
            page.prefix = keep
        elif laid:
            page.block(False)
            n = whole(kid.get("value"), n) if numbered else n
            here = inside if own is None or own == at.seen else Place(at.pre, at.lists + 1, at.tables, own)
            mark = f"{n}. " if numbered else "- "
            n += step
            keep = page.prefix
            page.prefix = _deeper(page, " " * len(mark))
            page.mark = mark if here.seen else ""
            gap, page.gap = page.gap, min(page.gap, 1)
            yield _render(kid.kids, page, here, sheet)
            page.block(False)
            page.mark = ""
            page.prefix = keep
            page.gap = 0 if gap == 0 else page.gap


def _cell(kids: list, at: Place, sheet: Sheet):
    page = Page()
    yield _render(kids, page, Place(False, 0, at.tables + 1, at.seen), sheet)
    page.line()
    return page.lines


def table_lines(table: Node, at: Place, sheet: Sheet):
    """A table's lines, cells padded to their columns and two spaces apart; captions come first."""
    captions: list[tuple[list, Place]] = []
    parts: dict[str, list] = {"thead": [], "tbody": [], "tfoot": []}
    # rows are lists of (attributes' node, what the cell holds, its place)
    walk = [(k, "tbody", at) for k in reversed(table.kids)]
    while walk:
        k, part, here = walk.pop()
        if type(k) is str:
            if k.strip() and here.seen:  # a table's own text, where it stands in another table
                parts[part].append([(None, [k], here)])
            continue
        laid, own = shown(k, sheet)
        if k.tag in HIDDEN or not laid:
            continue
        inner = here if own is None else Place(here.pre, here.lists, here.tables, own)
        if k.tag == "caption":
            captions.append((k.kids, inner))
        elif k.tag in parts:
            walk += [(x, k.tag if part == "tbody" else part, inner) for x in reversed(k.kids)]
        elif k.tag == "tr":
            cells, stray = [], []
            for c in k.kids:
                if type(c) is not str and c.tag in ("td", "th"):
                    laid, own = shown(c, sheet)
                    if laid:
                        cells.append((c, c.kids, inner if own is None else Place(inner.pre, inner.lists, inner.tables, own)))
                elif type(c) is not str or c.strip():
                    stray.append(c)
            parts[part].append(cells + [(None, stray, inner)] * bool(stray))
        else:
            parts[part].append([(None, [k], here)])

    def span(c: Node | None, name: str, most: int) -> int:
        v = c.get(name) if c is not None and c.attrs else None
        return max(1, min(int(v), most)) if v is not None and v.strip().isascii() and v.strip().isdigit() and len(v.strip()) < 9 else 1

    out: list[str] = []
    for kids, here in captions:
        out += yield _cell(kids, here, sheet)
    grid: list[list[tuple[int, int, list[str]]]] = []
    held: list[tuple[int, int, int]] = []  # columns that cells above reach into, and for how many rows more
    for cells in parts["thead"] + parts["tbody"] + parts["tfoot"]:
        line, column, k, fresh = [], 0, 0, []
        for c, kids, here in cells:
            while k < len(held) and held[k][0] <= column:
                column = max(column, held[k][1])
                k += 1
            wide, tall = span(c, "colspan", 1000), span(c, "rowspan", 65534)
            line.append((column, column + wide, (yield _cell(kids, here, sheet))))
            if tall > 1:
                fresh.append((column, column + wide, tall - 1))
            column += wide
        held = sorted([(a, b, n - 1) for a, b, n in held if n > 1] + fresh)
        if line:
            grid.append(line)
    # columns that no cell ends or begins between are one
    bounds = {c: i for i, c in enumerate(sorted({x for line in grid for a, b, _ in line for x in (a, b)}))}
    grid = [[(bounds[a], bounds[b], text) for a, b, text in line] for line in grid]
    widths: dict[int, int] = {}
    for line in grid:
        for a, b, text in line:
            if b - a == 1:
                widths[a] = max(widths.get(a, 0), max(map(len, text), default=0))
    for line in grid:
        for a, b, text in line:
            if b - a > 1:
                room = sum(widths.get(c, 0) for c in range(a, b)) + 2 * (b - a - 1)
                need = max(map(len, text), default=0)
                if need > room:
                    widths[b - 1] = widths.get(b - 1, 0) + need - room
    left, x = [], 0
    for c in range(len(bounds)):
        left.append(x)
        x += widths[c] + 2 if c in widths else 0
    for line in grid:
        for n in range(max((len(t) for _, _, t in line), default=0)):
            s = ""
            for a, _, text in line:
                if n < len(text) and text[n]:
                    s = s.ljust(left[a]) + text[n]
            out.append(s.rstrip())
    return out


def clean(text: str) -> str:
    """A page with its line ends as line feeds and without null characters."""
    return text.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")


def render_tree(root: Root) -> str:
    page = Page()
    _run(_render(root.kids, page, Place(), Sheet(root)))
    page.line()
    return "\n".join(page.lines).strip("\n")


def render(text: str | None) -> str | None:
    """All visible text of a page, laid out: lines of blocks, empty lines where margins are, list marks, aligned cells."""
    return None if text is None else render_tree(parse(clean(text)))


def title_and_links(root: Root) -> tuple[str, list[str]]:
    """The first title, on one line, and the addresses that anchors name."""
    title, links = None, []
    for node in root.marked:
        if node.tag == "title" and title is None:
            title = _SPACES.sub(" ", "".join(k for k in node.kids if type(k) is str)).strip()
        elif node.tag == "a" and (href := node.get("href")) is not None:
            links.append(href)
    return title or "", links


def title_of(text: str) -> str:
    return title_and_links(parse(clean(text)))[0]


def _extract(batches):
    for batch in batches:
        yield pa.record_batch([batch.column("page_id"), pa.array([render(t) for t in batch.column("html").to_pylist()], pa.string())], names=["page_id", "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and text for each row: all visible text, laid out.

    Hidden are: head, scripts, styles, templates, embedded media, closed details and dialogs, elements with
    `hidden` or display none, and text whose visibility is hidden or collapse, which what it holds may undo.
    Both properties are read from style attributes and from the page's own rules with simple selectors
    (Sheet). Elements may nest at any depth; only indents and aligned tables are bounded (INDENT, ALIGNED).
    Null html gives null, empty html empty text. Repeated rows and null ids are kept. Other columns are
    ignored. An empty table gives an empty result.
    """
    return spread(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"))).mapInArrow(_extract, "page_id long, text string")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op2_html": op2_html}
SQL: dict[str, str] = {}
