"""HTML extraction: a tree builder with implied tags, visibility rules, and a text renderer.

The page is read once by a tokenizer with the states of the HTML standard (attribute quoting,
comments, raw text).  The tree follows the standard where it matters for text: void elements,
implied ends (p, li, dt, dd, option, headings, table parts), implied rows, scopes, stray and
crossed end tags.  Open elements are looked up by the places of each tag on the stack, so
every tag costs the same however deep it stands.

Visible is what a browser shows: `display: none`, `hidden`, closed details and dialogs, head,
scripts, styles, templates and fallback contents are out; `visibility` is inherited and may be
switched on again inside; options, text areas, values of inputs, formulas and the text of
drawings are in.  Blocks stand on lines of their own, with an empty line around paragraphs,
headings, lists and tables; list items get bullets or numbers; cells are aligned on a grid with
colspan and rowspan; pre keeps its blanks; br breaks the line.

Defined cases: null html is null text; empty html, or html without visible text, is "";
broken markup never fails: a quote that is never closed ends at the next >, a < without any >
behind it is text.  Long and deeply nested pages take linear time without recursion: more than
DEEP tables inside one another are stacked instead of aligned, and indents stop growing at
INDENT.  Repeated rows are rendered each; further columns pass; an empty table gives an empty
result.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import quoted, small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
RCDATA = frozenset(("title", "textarea"))
UNSEEN = frozenset("head script style template noscript iframe object canvas audio video datalist title noembed noframes rp area param source track".split())
UNSEEN_INSIDE = {"svg": frozenset("title desc defs metadata symbol clippath mask marker pattern".split()), "math": frozenset(("annotation", "annotation-xml"))}
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre listing xmp plaintext figure hr".split())
BLOCK = SPACED | frozenset("html body address article aside center dd details dialog dir div dt fieldset figcaption footer form header hgroup legend li main menu nav option optgroup search section select summary textarea tr caption thead tbody tfoot".split())
CLOSES_P = (SPACED | frozenset("address article aside center details dialog dir div fieldset figcaption footer form header hgroup main menu nav search section summary li dd dt".split())) - {"table"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
GROUPS = {"thead": 0, "tbody": 1, "tfoot": 2}
#: no end tag and no implied end reaches out of these
BARRIER = frozenset("table td th caption button object template html svg math".split())
#: inline elements that an end tag ends even where blocks were opened inside them
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
INLINE = FORMATTING | frozenset("span abbr cite q label sub sup mark kbd var samp dfn time data ins del bdi bdo ruby rb rt rp acronym option optgroup".split())
IN_HEAD = UNSEEN | {"html", "base", "basefont", "bgsound", "link", "meta", "body"}
PREFORMATTED = frozenset("pre listing xmp plaintext textarea".split())
TYPED = frozenset(("", "text", "search", "email", "url", "tel", "number", "date", "month", "week", "time", "datetime-local", "submit", "reset", "button"))
DEEP, INDENT = 8, 64

COMMENT_END = re.compile(r"--!?>")
NAME = re.compile(r"[A-Za-z][^\s/>]*")
PLAIN = re.compile(r"[^>\"']*")
ATTR_NAME = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)?")
EQUALS = re.compile(r"\s*=\s*")
UNQUOTED = re.compile(r"[^\s>]*")
STYLE = re.compile(r"(?:^|;)\s*(display|visibility|white-space)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
COLLAPSE = re.compile(r"[ \t\n\r\f]+")
NUMBER = re.compile(r"\s*\+?([0-9]{1,5})")


class Node:
    __slots__ = ("attrs", "children", "gone", "pre", "tag", "visible")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []
        #: display: none; visibility of its own or None; white space of its own
        self.gone, self.visible, self.pre = False, None, tag in PREFORMATTED

    def number(self, name: str, default: int, most: int) -> int:
        m = NUMBER.match(self.attrs.get(name, ""))
        return min(int(m[1]), most) if m else default


def _attributes(page: str, at: int) -> tuple[dict, int]:
    """The attributes of a tag, read from behind its name, and the place behind its >; -1 if it has no end."""
    out: dict[str, str] = {}
    n = len(page)
    while True:
        m = ATTR_NAME.match(page, at)
        at = m.end()
        if m[1] is None:
            return out, at + 1 if at < n else -1
        value, eq = "", EQUALS.match(page, at)
        if eq:
            at = eq.end()
            quote = page[at : at + 1]
            if quote in ('"', "'"):
                end = page.find(quote, at + 1)
                if end < 0:
                    return out, -1
                value, at = page[at + 1 : end], end + 1
            else:
                m2 = UNQUOTED.match(page, at)
                value, at = m2[0], m2.end()
        out.setdefault(m[1].lower(), entities.unescape(value) if "&" in value else value)


class _Builder:
    """The stack of open elements and, for each tag, its places on it."""

    def __init__(self):
        self.root = Node("#root")
        self.stack = [self.root]
        self.places: dict[str, list[int]] = {}
        self.barriers, self.special, self.stops = [0], [0], [0]  # places of BARRIER, of blocks, of blocks but address, div, p

    def place(self, tag: str) -> int:
        """The innermost open element of this tag, 0 for none."""
        found = self.places.get(tag)
        return found[-1] if found else 0

    def push(self, node: Node) -> None:
        tag, at = node.tag, len(self.stack)
        self.stack[-1].children.append(node)
        self.stack.append(node)
        self.places.setdefault(tag, []).append(at)
        if tag in BARRIER:
            self.barriers.append(at)
        if tag not in INLINE:
            self.special.append(at)
            if tag not in ("address", "div", "p"):
                self.stops.append(at)

    def pop(self, to: int) -> None:
        """End the element at this place and all inside it."""
        while len(self.stack) > to:
            at = len(self.stack) - 1
            found = self.places.get(self.stack.pop().tag)
            if found and found[-1] == at:  # else ended before
                found.pop()
            for some in (self.barriers, self.special, self.stops):
                if some[-1] == at:
                    some.pop()

    def text(self, s: str) -> None:
        if s:
            self.stack[-1].children.append(entities.unescape(s) if "&" in s else s)

    def start(self, node: Node) -> None:
        """Ends that a start tag implies, and the elements it implies."""
        tag = node.tag
        barrier = self.barriers[-1]
        if tag in CLOSES_P and (p := self.place("p")) > barrier:
            self.pop(p)
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.pop(len(self.stack) - 1)
        elif tag == "li":
            at = self.place("li")
            if at and at >= self.stops[-1]:
                self.pop(at)
        elif tag in ("dt", "dd"):
            at = max(self.place("dt"), self.place("dd"))
            if at and at >= self.stops[-1]:
                self.pop(at)
        elif tag in ("option", "optgroup"):
            if (at := self.place("option")) > barrier:
                self.pop(at)
            if tag == "optgroup" and (at := self.place("optgroup")) > barrier:
                self.pop(at)
        elif tag == "button" and (at := self.place("button")):
            self.pop(at)
        elif tag in ("td", "th"):
            table = self.place("table")
            if (at := max(self.place("td"), self.place("th"))) > max(table, self.place("tr")):
                self.pop(at)
            elif self.place("tr") < table:
                self.start(row := Node("tr"))
                self.push(row)
            elif (tr := self.place("tr")) > table:
                self.pop(tr + 1)
        elif tag in ("tr", "thead", "tbody", "tfoot", "caption", "colgroup", "col"):
            table = self.place("table")
            inside = ["tr", "caption"] if tag == "tr" else ["tr", "thead", "tbody", "tfoot", "caption", "colgroup"]
            open_ = [at for t in [*inside, "td", "th"] if (at := self.place(t)) > table]
            # cells directly under the table, without a row, end as well
            self.pop(min(open_) if open_ else table + 1 if tag != "tr" or self.stack[-1].tag not in GROUPS else len(self.stack))
        elif tag == "body" and self.place("head"):
            self.pop(self.place("head"))
        if tag not in IN_HEAD and self.stack[-1].tag == "head":
            self.pop(len(self.stack) - 1)

    def end(self, tag: str) -> None:
        barrier, at = self.barriers[-1], self.place(tag)
        if tag == "p" and at <= barrier:
            self.start(Node("p"))
            self.stack[-1].children.append(Node("p"))
        elif tag in HEADINGS:
            if (at := max(map(self.place, HEADINGS))) > barrier:
                self.pop(at)
        elif not at:
            return
        elif tag in ("table", "html", "body"):
            if tag == "table":  # html and body end with the page
                self.pop(at)
        elif tag in GROUPS or tag in ("tr", "td", "th", "caption"):
            if at > self.place("table"):
                self.pop(at)
        elif tag in BARRIER:
            self.pop(at)
        elif tag in INLINE and tag not in FORMATTING:
            if at > self.special[-1]:
                self.pop(at)
        elif tag in FORMATTING:
            if at > self.special[-1]:
                self.pop(at)
            elif at > barrier:  # ends, but not the blocks opened inside
                self.places[tag].pop()
        elif at > barrier:
            self.pop(at)


def _styled(node: Node, foreign: str) -> None:
    tag, attrs = node.tag, node.attrs
    node.gone = tag in UNSEEN or "hidden" in attrs or (tag == "dialog" and "open" not in attrs) or tag in UNSEEN_INSIDE.get(foreign, ())
    if "style" in attrs:
        important = set()
        for m in STYLE.finditer(attrs["style"]):
            prop, value = m[1].lower(), m[2].lower()
            if prop in important and not m[3]:
                continue
            if m[3]:
                important.add(prop)
            if prop == "display":
                node.gone = value == "none" or (node.gone and tag in UNSEEN)
            elif prop == "visibility":
                node.visible = None if value == "inherit" else value not in ("hidden", "collapse")
            else:
                node.pre = value in ("pre", "pre-wrap", "break-spaces")


def parse(page: str) -> Node:
    """The tree of a page; text nodes are strings, entities decoded."""
    b = _Builder()
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            b.text(page[at:])
            break
        b.text(page[at:lt])
        after = page[lt + 1 : lt + 2]
        closing = after == "/"
        m = NAME.match(page, lt + 1 + closing)
        if not m:
            if after == "!" and page.startswith("--", lt + 2):
                if page.startswith(">", lt + 4) or page.startswith("->", lt + 4):
                    at = page.index(">", lt) + 1
                else:
                    end = COMMENT_END.search(page, lt + 4)
                    at = end.end() if end else n
            elif after == "!" and page.startswith("[CDATA[", lt + 2) and (b.place("svg") or b.place("math")):
                end = page.find("]]>", lt)
                b.stack[-1].children.append(page[lt + 9 : end if end >= 0 else n])
                at = end + 3 if end >= 0 else n
            elif after in ("!", "?") or closing:
                if closing and page.startswith(">", lt + 2):
                    at = lt + 3
                    continue
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else n
            else:
                b.text("<")
                at = lt + 1
            continue
        tag = m[0].lower()
        plain = PLAIN.match(page, m.end())
        if page.startswith(">", plain.end()):
            attrs = _attributes(page, m.end())[0] if not closing and plain.end() > m.end() else {}
            at = plain.end() + 1
        else:
            attrs, at = _attributes(page, m.end())
            if at < 0:
                end = page.find(">", lt)
                if end < 0:  # nothing behind is a tag
                    b.text(page[lt:])
                    break
                at = end + 1
        if closing:
            if tag == "br":
                b.stack[-1].children.append(Node("br"))
            else:
                b.end(tag)
            continue
        foreign = b.stack[max(b.place("svg"), b.place("math"))].tag
        if foreign == "#root":
            foreign = ""
        elif tag in BLOCK and tag not in ("option", "select", "textarea") and not b.place("foreignobject"):
            b.pop(max(b.place("svg"), b.place("math")))  # HTML ends a drawing or formula
            foreign = ""
        if tag == "image" and not foreign:
            tag = "img"
        if tag in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup", "col") and not b.place("table"):
            continue
        if tag in ("html", "body", "head") and b.place(tag):
            continue
        node = Node(tag, attrs)
        _styled(node, foreign)
        b.start(node)
        if tag in VOID or (foreign or tag in UNSEEN_INSIDE) and page[at - 2] == "/":
            b.stack[-1].children.append(node)
            continue
        if tag == "plaintext":
            b.stack[-1].children.append(node)
            node.children.append(page[at:])
            break
        if (tag in RAW or tag in RCDATA) and not (foreign and tag == "title"):
            b.stack[-1].children.append(node)
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            text = page[at : close.start() if close else n]
            if tag == "textarea" and text.startswith("\n"):
                text = text[1:]
            node.children.append(text if tag in RAW else entities.unescape(text))
            end = page.find(">", close.start()) if close else -1
            at = end + 1 if end >= 0 else n
            continue
        b.push(node)
        if tag in ("pre", "listing") and page.startswith("\n", at):
            at += 1
    return b.root


class _Lines:
    """Collects inline text into lines; blanks collapse outside pre.  A line may be a list of lines."""

    def __init__(self):
        self.lines: list = []
        self.now: list[str] = []
        self.gap = False
        self.mark = ""

    def text(self, s: str, pre: bool, indent: str) -> None:
        if pre:
            first, *rest = s.split("\n")
            self.now.append(first)
            for x in rest:
                self.flush(indent, True)
                self.now.append(x)
            return
        body = COLLAPSE.sub(" ", s)
        if body.startswith(" ") and (not self.now or self.now[-1].endswith(" ")):
            body = body[1:]
        if body:
            self.now.append(body)

    def _open(self) -> None:
        if self.gap and self.lines and self.lines[-1] != "":
            self.lines.append("")
        self.gap = False

    def flush(self, indent: str, force: bool = False) -> None:
        line = "".join(self.now).rstrip(" ")
        self.now = []
        if not line and not force:
            return
        self._open()
        lead = indent
        if self.mark:
            lead = indent[: max(0, len(indent) - len(self.mark))] + self.mark
            self.mark = ""
        self.lines.append((lead + line).rstrip(" "))

    def block(self, lines: list) -> None:
        """Lines made elsewhere, taken over as one."""
        if lines:
            self._open()
            self.lines.append(lines)


def _flat(lines: list) -> list[str]:
    out, todo = [], [iter(lines)]
    while todo:
        for x in todo[-1]:
            if isinstance(x, list):
                todo.append(iter(x))
                break
            out.append(x)
        else:
            todo.pop()
    return out


def _table(rows: list[tuple[int, list]]) -> list[str]:
    """Lines of a grid.  rows: number of the row's group, and its cells: lines, colspan, rowspan.

    A cell takes the first free column; what it spans is free for no other.  Columns are as wide as the cells that lie in
    them alone; the last column under a wide spanning cell makes up the rest; columns without text take no room.
    """
    placed: list[list[tuple[int, int, list[str]]]] = []
    gaps, ends, back = [0], [1 << 60], {}  # columns free of cells from rows above, ascending; by row, columns that are free again from there on
    before = None
    for y, (group, cells) in enumerate(rows):
        if group != before:
            before, gaps, ends, back = group, [0], [1 << 60], {}
        for a, b in back.pop(y, ()):
            i = bisect_left(gaps, a)
            if i < len(gaps) and gaps[i] == b:
                b = ends[i]
                del gaps[i], ends[i]
            if i and ends[i - 1] == a:
                ends[i - 1] = b
            else:
                gaps.insert(i, a)
                ends.insert(i, b)
        x, row = 0, []
        for lines, wide, high in cells:
            i = bisect_right(gaps, x) - 1
            if i < 0 or ends[i] <= x:
                i += 1
                x = gaps[i]
            row.append((x, x + wide, lines))
            a, x = x, x + wide
            while high > 1 and i < len(gaps) and gaps[i] < x:
                lo, hi = max(gaps[i], a), min(ends[i], x)
                back.setdefault(y + high, []).append((lo, hi))
                rest = [(u, v) for u, v in ((gaps[i], lo), (hi, ends[i])) if u < v]
                gaps[i : i + 1], ends[i : i + 1] = [u for u, _ in rest], [v for _, v in rest]
                i += sum(u < a for u, _ in rest)
                if rest and rest[-1][0] >= x:
                    break
        placed.append(row)
    starts = sorted({c[0] for row in placed for c in row})
    width, spans = [0] * len(starts), []
    for row in placed:
        for a, b, lines in row:
            i, j = bisect_left(starts, a), bisect_left(starts, b) - 1
            size = max(map(len, lines), default=0)
            if i == j:
                width[i] = max(width[i], size)
            elif size:
                spans.append((j - i, i, j, size))
    for _, i, j, size in sorted(spans):
        width[j] += max(0, size - sum(w + 2 for w in width[i : j + 1] if w) + 2)
    offset, at = {}, 0
    for a, w in zip(starts, width, strict=True):
        offset[a] = at
        at += w + 2 if w else 0
    out = []
    for row in placed:
        for y in range(max((len(c[2]) for c in row), default=0)):
            parts, size = [], 0
            for a, _, lines in row:
                if y < len(lines) and lines[y]:
                    blank = max(offset[a] - size, 2 if size else 0)
                    parts += [" " * blank, lines[y]]
                    size += blank + len(lines[y])
            out.append("".join(parts))
    return out


def render(root: Node) -> str:
    """All visible text of the tree.  An explicit stack of steps, so depth is no limit."""
    top = _Lines()
    sinks, grids, lists, group = [top], [], [], 0
    todo: list[tuple] = [("node", root, "", False, True, True)]  # indent, pre, visible, painted (not so in drawings, save for their text)
    while todo:
        step, node, indent, pre, visible, painted = todo.pop()
        sink = sinks[-1]
        if step == "text":
            if visible and painted:
                sink.text(node, pre, indent)
        elif step == "flush":
            sink.flush(indent)
        elif step == "gap":
            sink.gap = True
        elif step == "unlist":
            lists.pop()
        elif step == "unmark":
            sink.mark = ""
        elif step == "cell":
            sinks.pop().flush("")
            grids[-1][-1][1].append((sink.lines, node.number("colspan", 1, 1000) or 1, node.number("rowspan", 1, 65534) or 65534))
        elif step == "table":
            rows = sorted(grids.pop(), key=lambda r: r[0] & 3)
            sinks.pop()
            sink.flush("")
            sinks[-1].flush(indent)
            if len(grids) >= DEEP:  # stacked
                made = [*sink.lines, *(c[0] for _, cells in rows for c in cells if c[0])]
                sinks[-1].block(made)
            else:  # what stood in the table but in no cell comes first
                for line in [*_flat(sink.lines), *_table([(g, [(_flat(c), w, h) for c, w, h in cells]) for g, cells in rows if any(c[0] for c in cells)])]:
                    sinks[-1].now.append(line)
                    sinks[-1].flush(indent, True)
        elif not node.gone:
            tag, steps = node.tag, []
            visible = visible if node.visible is None else node.visible
            painted = tag in ("text", "foreignobject", "math") or (painted and tag != "svg")
            state = (visible, painted)
            pre = pre or node.pre
            children = node.children
            if tag == "br":
                sink.flush(indent, True)
                continue
            if tag == "input":
                kind = node.attrs.get("type", "").lower()
                if kind in TYPED and visible:
                    sink.text(node.attrs.get("value", "") or {"submit": "Submit", "reset": "Reset"}.get(kind, ""), False, indent)
                continue
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            if tag in GROUPS and grids:
                group += 1
                # ordered by kind, apart from other groups
                grids[-1].append((group * 4 + GROUPS[tag], []))
                todo += [_step(c, indent, pre, *state) for c in reversed(children) if isinstance(c, Node) or not c.isspace()]
                continue
            if tag == "tr" and grids:
                grids[-1].append((grids[-1][-1][0] if grids[-1] else 1, []))
                todo += [_step(c, indent, pre, *state) for c in reversed(children) if isinstance(c, Node) or not c.isspace()]
                continue
            if tag in ("td", "th") and grids:
                sinks.append(_Lines())
                todo.append(("cell", node, "", False, True, True))
                todo += [_step(c, "", pre, *state) for c in reversed(children)]
                continue
            block = tag in BLOCK
            if block:
                sink.flush(indent)
                if tag in SPACED and not (tag in ("ul", "ol") and lists):
                    sink.gap = True
                    steps.append("gap")
                steps.append("flush")
            inner = indent
            if tag in LISTS:
                start = node.attrs.get("start", "")
                lists.append([tag, int(start) if re.fullmatch("-?[0-9]{1,9}", start) else 1])
                steps.append("unlist")
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                inner = (indent + " " * len(mark)) if len(indent) < INDENT else indent
                sink.mark = mark
                steps[-1:] = ["unmark", "flush"]
            elif tag in ("blockquote", "dd"):
                inner = indent + "  " if len(indent) < INDENT else indent
            elif tag == "table":
                grids.append([])
                sinks.append(_Lines())
                todo += [("gap", None, indent, pre, *state), ("table", None, indent, pre, *state)]
                todo += [_step(c, "", False, *state) for c in reversed(children) if isinstance(c, Node) or not c.isspace()]
                continue
            elif tag == "optgroup" and node.attrs.get("label") and visible:
                sink.text(node.attrs["label"], False, indent)
                sink.flush(indent)
            todo += [(s, None, inner if s == "flush" else indent, pre, *state) for s in steps]
            todo += [_step(c, inner, pre, *state) for c in reversed(children)]
    top.flush("")
    return "\n".join(_flat(top.lines)).strip("\n")


def _step(child, indent: str, pre: bool, visible: bool, painted: bool) -> tuple:
    return ("node" if isinstance(child, Node) else "text", child, indent, pre, visible, painted)


def extract(page: str | None) -> str | None:
    return None if page is None else render(parse(page.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")))


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text: the visible text of every page."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in small_batches(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([extract(x) for x in part.column(1).to_pylist()], pa.string())], names=["page_id", "text"])

    return pages.select(quoted(id_col).cast("long"), quoted(html_col)).mapInArrow(run, "page_id long, text string")
