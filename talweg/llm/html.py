"""HTML to text with layout: implied tags, visibility, block spacing, lists and aligned tables."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape as _unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a browser doesn't render.
UNSEEN = frozenset("head title style script template noscript noframes datalist object iframe audio video canvas desc metadata defs".split())
#: Elements whose content is text up to their end tag; in the second group with character references.
RAW = frozenset("script style iframe noframes xmp noembed".split())
ESCAPED = frozenset("title textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul caption".split()
)
#: Blocks with an empty line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr menu dir".split())
#: A start tag (key) ends an open element of these, up to an element of ENDS_AT.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "thead": {"tr", "td", "th", "thead", "tbody", "tfoot"},
    "tfoot": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "caption": {"caption"},
}
ENDS_AT = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}}
#: A block start tag ends an open paragraph; these stop the search for one.
PARAGRAPH_SCOPE = frozenset("table td th caption button html body".split())
_SPACES = re.compile(r"[ \t\n\r\f]+")
_TAG = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?""")
_END_OF_COMMENT = re.compile(r"--!?>")
#: Leading zeros of a numeric reference, and numbers beyond all characters.
_ZEROS = re.compile(r"(&#)0+(?=[0-9])|(&#[xX])0+(?=[0-9a-fA-F])")
_BEYOND = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*)?(?:([.#])([\w-]+))?\Z")
_DECLARATION = re.compile(r"\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*\Z", re.I)
#: A page whose whole layout takes more padding than so many times its size (and 30,000), or more steps than WORK times its
#: size (and 10,000; lines, and 32 characters of them, at each table, list or quote that holds them), is laid out plainly.
PADDING, WORK = 8, 4
#: In plain layout, indented blocks and tables within one another that are laid out as such; deeper ones are plain blocks.
DEEPEST = 16
#: In plain layout, rows that spans from above may meet in a table.
SPANNED = 1_000_000


def unescape(data: str) -> str:
    """Character references, whatever number of digits they have."""
    data = _ZEROS.sub(lambda m: m[1] or m[2], data)
    return _unescape(_BEYOND.sub("\ufffd", data))


def tokens(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", data, {}), ("start", tag, attributes) and ("end", tag, {}) of a page, in one pass.

    A comment, tag or raw element without an end goes on to the end of the page.
    """
    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            data = html[at:lt]
            yield "text", unescape(data) if "&" in data else data, {}
        if lt == size:
            return
        second = html[lt + 1 : lt + 2]
        if html.startswith("<!--", lt):
            end = _END_OF_COMMENT.search(html, lt + 2)
            if not end:
                return
            at = end.end()
        elif second and second in "!?" or html.startswith("</", lt) and not _TAG.match(html, lt + 2):
            if html.startswith("</", lt) and lt + 2 == size:
                yield "text", "</", {}
                return
            end = html.find(">", lt)
            if end < 0:
                return
            at = end + 1
        elif second == "/":
            name = _TAG.match(html, lt + 2)
            end = html.find(">", name.end())
            if end < 0:
                return
            yield "end", name.group().lower(), {}
            at = end + 1
        elif name := _TAG.match(html, lt + 1):
            tag, at, attributes = name.group().lower(), name.end(), {}
            while True:
                m = _ATTRIBUTE.match(html, at)
                if not m or m.end() == at:
                    break
                at = m.end()
                value = m[2] or m[3] or m[4] or ""
                attributes.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
            end = html.find(">", at)
            if end < 0:
                return
            at = end + 1
            yield "start", tag, attributes
            if tag in RAW or tag in ESCAPED:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                data = html[at : close.start()] if close else html[at:]
                yield "text", unescape(data) if tag in ESCAPED else data, {}
                if not close:
                    return
                at = close.start()
        else:
            yield "text", "<", {}
            at = lt + 1


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder:
    """A tree of elements and strings. End tags that are left out are implied; unmatched ones are ignored."""

    def __init__(self, html: str) -> None:
        self.root = Node("#root", {})
        self.open = [self.root]
        self.at: dict[str, list[int]] = {}  # where the open elements of a tag are
        for what, data, attrs in tokens(html):
            if what == "text":
                self.open[-1].children.append(data)
            else:
                (self._start if what == "start" else self._end)(data, attrs)

    def _pop_to(self, at: int) -> None:
        while len(self.open) > at:
            self.at[self.open.pop().tag].pop()

    def _last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def _close(self, tags: set[str], stop: set[str] | frozenset[str]) -> None:
        """End the outermost open element of these tags above the last one of ``stop``."""
        fence = self._last(stop)
        found = [p[bisect_right(p, fence)] for t in tags if (p := self.at.get(t)) and p[-1] > fence]
        if found:
            self._pop_to(min(found))

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("body", "html") and self.at.get(tag):
            return
        if self.at.get("head") and tag not in {"head", "title", "meta", "link", "style", "script", "base", "template", "noscript"}:
            if not self.at.get("template") and not self.at.get("noscript"):
                self._close({"head"}, frozenset())
        if tag in BLOCK and self.at.get("p"):
            self._close({"p"}, PARAGRAPH_SCOPE)
        if tag in CLOSES:
            self._close(CLOSES[tag], ENDS_AT.get(tag, {"table"}))
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.at.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def _end(self, tag: str, _: dict) -> None:
        if not self.at.get(tag):
            if tag in ("p", "br"):
                self.open[-1].children.append(Node(tag, {}))
            return
        at = self.at[tag][-1]
        fenced = self.at.get("table") and tag not in {"table", "body", "html", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"}
        if fenced and self._last(("td", "th", "caption")) > at:
            return
        self._pop_to(at)


def _declared(text: str) -> dict[str, tuple[bool, str]]:
    """The last display and visibility of a block of declarations, important ones first."""
    out: dict[str, tuple[bool, str]] = {}
    for part in text.split(";"):
        m = _DECLARATION.match(part)
        if m:
            name, rank = m[1].lower(), bool(m[3])
            if rank >= out.get(name, (False, ""))[0]:
                out[name] = (rank, m[2].lower())
    return out


class Styles:
    """Display and visibility by the page's style elements: rules of a tag, a class or an id, or of a tag with one. Other
    selectors and rules within at-rules count for nothing."""

    def __init__(self, root: Node) -> None:
        self.rules: dict[tuple[str, str], dict[str, tuple]] = {}
        order, stack = 0, [root]
        while stack:
            node = stack.pop()
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
            if node.tag != "style" or node.attrs.get("media", "all").strip().lower() not in ("", "all", "screen"):
                continue
            text = _CSS_COMMENT.sub(" ", "".join(c for c in node.children if isinstance(c, str)))
            for selectors, body in _rules(_without_at_rules(text)):
                declared = _declared(body)
                for selector in selectors.split(",") if declared else ():
                    m = _SELECTOR.match(selector.strip())
                    if not m or not selector.strip():
                        continue
                    order += 1
                    rank = {"#": 100, ".": 10, None: 0}[m[2]] + (1 if m[1] else 0)
                    own = self.rules.setdefault(((m[1] or "").lower(), (m[2] or "") + (m[3] or "")), {})
                    for name, (important, value) in declared.items():
                        own[name] = max(own.get(name, (False, 0, 0, "")), (important, rank, order, value))

    def of(self, node: Node) -> dict[str, str]:
        found: dict[str, tuple] = {}
        if "hidden" in node.attrs or node.tag == "input" and node.attrs.get("type", "").lower() == "hidden":
            found["display"] = (False, -1, 0, "none")
        if self.rules:
            marks = ["", *("." + c for c in node.attrs.get("class", "").split()), *(["#" + node.attrs["id"]] if node.attrs.get("id") else [])]
            for tag in ("", node.tag):
                for mark in marks:
                    for name, rule in self.rules.get((tag, mark), {}).items():
                        found[name] = max(found.get(name, (False, -2, 0, "")), rule)
        if node.attrs.get("style"):
            for name, (important, value) in _declared(node.attrs["style"]).items():
                found[name] = max(found.get(name, (False, -2, 0, "")), (important, 1000, 0, value))
        return {name: rule[3] for name, rule in found.items()}


def _rules(text: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of each innermost block, in one pass."""
    before, last, opened = -1, -1, -1
    for m in re.finditer(r"[{}]", text):
        if m.group() == "{":
            before, opened = last, m.start()
        elif opened >= 0:
            yield text[before + 1 : opened], text[opened + 1 : m.start()]
            opened = -1
        last = m.start()


def _without_at_rules(text: str) -> str:
    """Style text without at-rules and the blocks in them; a block without an end is left out."""
    out, depth, start, skip = [], 0, 0, False
    for m in re.finditer(r"[{};]", text):
        if m.group() == "{":
            if depth == 0:
                skip = text[start : m.start()].lstrip().startswith("@")
            depth += 1
        elif m.group() == "}":
            depth = max(depth - 1, 0)
            if depth == 0:
                if not skip:
                    out.append(text[start : m.end()])
                start, skip = m.end(), False
        elif depth == 0:
            start = m.end()
    return "".join(out)


class _TooMuch(Exception):
    """The whole layout is out of proportion to the page."""


class _Limits:
    """What a page's whole layout may still take; plain layout bounds depth and each table instead."""

    def __init__(self, size: int, plain: bool) -> None:
        self.plain, self.padding, self.work = plain, PADDING * (size + 30_000), WORK * (size + 10_000)
        self.spanned = SPANNED if plain else max(SPANNED, self.work)

    def take(self, padding: int, lines: list[str]) -> None:
        self.padding -= padding
        self.work -= len(lines) + sum(map(len, lines)) // 32
        if not self.plain and (self.padding < 0 or self.work < 0):
            raise _TooMuch


class _Block:
    """Text being laid out: finished lines, and the line under way."""

    def __init__(self, limits: _Limits, first: str = "", rest: str = "") -> None:
        self.limits = limits
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.gap = 0
        self.first, self.rest, self.fresh = first, rest, True

    def text(self, data: str, pre: bool) -> None:
        if pre:
            for k, line in enumerate(data.split("\n")):
                if k:
                    self.end(keep=True)
                if line:
                    self.parts.append(line)
            return
        for k, word in enumerate(_SPACES.split(data)):
            if k:
                self.space = True
            if word:
                if self.space and self.parts:
                    self.parts.append(" ")
                self.space = False
                self.parts.append(word)

    def end(self, keep: bool = False) -> None:
        """End the line; an empty one counts only with ``keep``."""
        if self.parts or keep:
            line = "".join(self.parts).rstrip()
            if line and self.lines:
                self.lines += [""] * self.gap
            self.gap = 0 if line else self.gap
            self.lines.append(line)
        self.parts, self.space = [], False

    def space_out(self) -> None:
        self.end()
        self.gap = 1

    def put(self, lines: list[str]) -> None:
        self.end()
        if lines:
            if self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            self.lines += lines

    def done(self) -> list[str]:
        self.end()
        out = self.lines
        while out and not out[0]:
            out.pop(0)
        while out and not out[-1]:
            out.pop()
        if self.first or self.rest:
            self.limits.take(len(self.rest) * len(out), out)
            out = [(self.first if k == 0 else self.rest) + x if x or k == 0 else x for k, x in enumerate(out)]
        return out


def _width(text: str) -> int:
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _placed(rows: list[list[tuple[list[str], int, int]]], most: int) -> list[list[tuple[int, int, list[str]]]] | None:
    """Cells (lines, columns and rows spanned) by row, with their first column and the one after the last; columns that
    no cell parts count as one. A cell is put into the first columns that no cell from above spans. None if spans from above
    meet more than ``most`` rows."""
    out, active, work = [], [], 0
    for r, row in enumerate(rows):
        active = [a for a in active if a[2] > r]
        work += len(active)
        if work > most:
            return None
        placed, at, k = [], 0, 0
        for lines, span, down in row:
            while k < len(active) and active[k][0] < at + 1:
                at = max(at, active[k][1])
                k += 1
            placed.append((at, at + span, lines, down))
            at += span
        out.append([(a, b, lines) for a, b, lines, _ in placed])
        below = [(a, b, r + down) for a, b, _, down in placed if down > 1]
        if below:
            active = sorted(active + below)
    edges = sorted({x for row in out for a, b, _ in row for x in (a, b)})
    column = {x: k for k, x in enumerate(edges)}
    return [[(column[a], column[b], lines) for a, b, lines in row] for row in out]


def _grid(rows: list[list[tuple[list[str], int, int]]], limits: _Limits) -> list[str]:
    """Cells (lines, columns and rows spanned) as columns of equal width, two spaces apart; in plain layout without alignment
    where that would take more than PADDING times the text."""
    placed = _placed(rows, limits.spanned)
    if placed is None and not limits.plain:
        raise _TooMuch
    for row in rows:
        for lines, _, _ in row:
            limits.take(0, lines)
    size = sum(len(x) + 2 for row in rows for lines, _, _ in row for x in lines)
    widths = [0] * max((b for row in placed or [] for _, b, _ in row), default=0)
    for row in placed or []:
        for a, b, lines in row:
            if b == a + 1:
                widths[a] = max([widths[a], *(_width(x) for x in lines)])
    ends = [0]
    for w in widths:
        ends.append(ends[-1] + w + 2)
    wide: dict[int, int] = {}
    for row in placed or []:  # a wide cell that spans columns widens its last one
        for a, b, lines in row:
            if b > a + 1:
                wide[b] = max([wide.get(b, 0), *(_width(x) + 2 - (ends[b] - ends[a]) for x in lines)])
    more = 0
    for b in range(1, len(ends)):
        more += wide.get(b, 0)
        ends[b] += more
    tall = sum(max((len(lines) for _, _, lines in row), default=0) * ends[max((b for _, b, _ in row), default=0)] for row in placed or [])
    limits.take(max(tall - size, 0), [])
    if placed is None or limits.plain and tall > PADDING * (size + 1000):
        return ["  ".join(lines[k] for lines, _, _ in row if k < len(lines)) for row in rows for k in range(max((len(x[0]) for x in row), default=0))]
    out = []
    for row in placed:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            line, at = [], 0
            for a, b, lines in row:
                cell = lines[k] if k < len(lines) else ""
                line.append(" " * (ends[a] - at) + cell)
                at = ends[a] + _width(cell)
            out.append("".join(line).rstrip())
    return out


def _number(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch(r"\s*-?[0-9]{1,9}\s*", value) else default


def render(html: str | None) -> str:
    """All visible text of a page (null or empty: none). The tree is walked with a stack of its own, so depth is no limit.

    An element that isn't displayed goes with all it has; of an invisible one, those parts show that are visible again.
    Lists, quotes and tables are laid out at any depth, unless that is out of proportion to the page (PADDING, WORK).
    """
    root = TreeBuilder(html or "").root
    styles = Styles(root)
    size = len(html or "")
    try:
        return _laid_out(root, styles, _Limits(size, False))
    except _TooMuch:
        return _laid_out(root, styles, _Limits(size, True))


def _laid_out(root: Node, styles: Styles, limits: _Limits) -> str:
    top = _Block(limits)
    blocks = [top]
    tables: list[dict] = []
    lists: list[list] = []
    pre = deep = 0
    stack: list[tuple[str, object, bool]] = [("open", root, True)]
    while stack:
        what, node, seen = stack.pop()
        block = blocks[-1]
        if isinstance(node, str):
            if not seen:
                continue
            if not (tables and len(blocks) == tables[-1]["base"]):  # text between cells has no place
                block.text(node, pre > 0)
            elif node.strip():
                blocks[tables[-1]["base"] - 1].text(node, pre > 0)
            continue
        if what == "open":
            tag = node.tag
            if tag in UNSEEN:
                continue
            style = styles.of(node)
            if style.get("display") == "none":
                continue
            if "visibility" in style and style["visibility"] != "inherit":
                seen = style["visibility"] not in ("hidden", "collapse")
            deepest = limits.plain and deep >= DEEPEST
            kind = "div" if deepest and tag in ("table", "caption", "tr", "td", "th", "li", "dd", "blockquote") else tag
            stack.append(("close", (kind, node), seen))
            stack.extend(("open", c, seen) for c in reversed(node.children))
            tag = kind
            if tag == "br":
                if seen:
                    block.end(keep=True)
            elif tag == "img":
                if seen and node.attrs.get("alt"):
                    block.text(node.attrs["alt"], False)
            elif tag in ("option", "optgroup"):
                block.end()
            elif tag == "hr":
                block.space_out()
                if seen:
                    block.put(["---"])
                block.gap = 1
            elif tag == "table":
                block.space_out()
                tables.append({"rows": [], "base": len(blocks)})
                deep += 1
            elif tag == "tr" and tables:
                tables[-1]["rows"].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]["rows"]:
                    tables[-1]["rows"].append([])
                blocks.append(_Block(limits))
            elif tag in BLOCK:
                block.space_out() if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists) else block.end()
                if tag in ("ul", "ol", "menu", "dir"):
                    lists.append([tag, _number(node.attrs.get("start"), 1)])
                elif tag == "li":
                    of = lists[-1] if lists else ["ul", 1]
                    mark = "- "
                    if of[0] == "ol":
                        of[1] = _number(node.attrs.get("value"), of[1])
                        mark = f"{of[1]}. "
                        of[1] += 1
                    blocks.append(_Block(limits, mark, " " * len(mark)))
                    deep += 1
                elif tag in ("dd", "blockquote"):
                    blocks.append(_Block(limits, "  ", "  "))
                    deep += 1
                elif tag == "pre":
                    pre += 1
        else:
            tag, node = node
            if tag == "table" and tables:
                deep -= 1
                table = tables.pop()
                block.put([x for x in _grid(table["rows"], limits) if x.strip()])
                block.gap = 1
            elif tag in ("td", "th") and tables and len(blocks) > tables[-1]["base"]:
                lines = blocks.pop().done()
                span = min(max(_number(node.attrs.get("colspan"), 1), 1), 1000)
                down = min(max(_number(node.attrs.get("rowspan"), 1), 0), 65534) or 65534
                tables[-1]["rows"][-1].append((lines, span, down))
            elif tag in ("li", "dd", "blockquote") and len(blocks) > 1:
                deep -= 1
                lines = blocks.pop().done()
                blocks[-1].put(lines)
                if tag == "blockquote":
                    blocks[-1].gap = 1
            elif tag in ("option", "optgroup"):
                block.end()
            elif tag in BLOCK and tag != "hr":
                if tag == "pre":
                    pre -= 1
                if tag in ("ul", "ol", "menu", "dir") and lists:
                    lists.pop()
                block.space_out() if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists) else block.end()
    return "\n".join(top.done())


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add the visible text of each row's page (null and empty: ''). A column ``out`` is replaced, all others stay.

    Broken pages are read as far as tags can be told; very long ones whole, in time and space in proportion. Rows that
    repeat have the same text.
    """
    kept = [c for c in df.columns if c != out or c == html]
    src = df.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                texts = pa.array([render(x.as_py()) for x in part.column(at)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*kept, out])

    return src.mapInArrow(run, StructType([*src.schema.fields, StructField(out, StringType())]))
