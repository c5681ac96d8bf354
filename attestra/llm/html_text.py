"""Text of web pages by layout: a tree with implied tags, visibility rules, and a renderer that keeps the shape of blocks.

Tree: tag names are lower-cased; void elements hold nothing; a start tag ends what it can't be inside (a paragraph ends at
a block, a list item at the next one, cells, rows and row groups likewise, and so on); an end tag closes up to its
element if that is open within its table, and is ignored otherwise; what is open at the end is closed there. Scripts,
styles and the like are raw until their own end tag. Comments, declarations and processing instructions are dropped.
Character references are resolved in text and attributes.

Visibility: nothing of the head, scripts, templates and other elements without a rendering; nothing in an element whose
display is none, by its style or else by the hidden attribute; no text whose visibility, inherited from the nearest element
that sets it, is hidden or collapse, though its place in lists and tables stays. Styles are inline ones and those of the
page's own sheets, by weight, kind of selector and order; of the sheets the rules for an element's name, class or id, or for
a name with one of both, also within @media all or screen. Other selectors aren't read. All other text comes out: of svg its
text elements and foreign content, of a select the option that is shown (all of them if it shows several), of math all but
its annotations.

Layout: white space collapses outside pre and textarea; blocks start on lines of their own, and headings, paragraphs, lists, tables,
quotes and figures have an empty line around them; br breaks the line. List items are indented by depth and begin with "- " or
their number. The cells of a table stand in columns padded to the widest (by code points), with two spaces between; a
cell's own lines are joined by a space; nested tables are rendered in their cell. A column span moves the cells after it, and a row span those below and after
it, to the end of its row group.

Everything is linear in the page but for the padding of tables, which is bounded by their text: a table whose padding is
over MAX_PADDING characters and over PADDING_RATIO times its text has its cells joined by tabs instead, for a page's text
is one value. Depth of nesting is not bounded and costs no stack.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PADDING, PADDING_RATIO = 1_000_000, 8
#: Columns that a cell can span at most by the standard, and how deep browsers nest elements.
WIDEST, DEEPEST = 1000, 512

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link base iframe noembed noframes object audio video canvas datalist annotation annotation-xml mphantom".split())
#: What svg has that is drawn nowhere or only where it is used; of the rest only text and foreign content are read.
_SVG_UNSEEN = frozenset("defs symbol clippath mask pattern marker desc metadata".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table blockquote pre figure hr".split())
BLOCK = SPACED | frozenset("html body div section article aside nav header footer main address form fieldset legend details summary dt dd li caption tr thead tbody tfoot td th center figcaption hgroup search dir option optgroup textarea xmp".split())
#: What a start tag ends when it is open, and what it isn't sought beyond.
_SCOPE = frozenset(("table", "td", "th", "caption", "html", "template", "button"))
_LISTS = _SCOPE | {"ul", "ol", "menu", "dir"}
_IMPLIED = {
    "li": (frozenset(("li",)), _LISTS),
    "dt": (frozenset(("dt", "dd")), _SCOPE | {"dl"}),
    "dd": (frozenset(("dt", "dd")), _SCOPE | {"dl"}),
    "option": (frozenset(("option",)), _SCOPE | {"select", "datalist"}),
    "optgroup": (frozenset(("option", "optgroup")), _SCOPE | {"select"}),
    "td": (frozenset(("td", "th", "caption")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th", "caption")), frozenset(("tr", "table"))),
    "tr": (frozenset(("tr", "td", "th", "caption")), frozenset(("table",))),
    "thead": (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption")), frozenset(("table",))),
    "tbody": (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption")), frozenset(("table",))),
    "tfoot": (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption")), frozenset(("table",))),
    "body": (frozenset(("head",)), frozenset(("html",))),
}
_ENDS_P = BLOCK - {"li", "dt", "dd", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "option", "optgroup", "html", "body", "textarea"} | {"li", "dt", "dd"}
_ROWS = frozenset("tr td th caption thead tbody tfoot".split())
_HEAD_ONLY = frozenset("title meta link base script style template noscript".split())

_TAG = re.compile(r"</?([a-zA-Z][^\s/>\x00]*)")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_COMMENT = re.compile(r"/\*(?:.*?\*/|.*)", re.S)
_SELECTOR = re.compile(r"(?=[^\s])([A-Za-z][\w-]*|\*)?(?:([.#])([\w-]+))?")
_SCREEN = re.compile(r"@media\s+(?:only\s+)?(?:all|screen)", re.I)


@dataclass(slots=True)
class Node:
    name: str
    attributes: dict[str, str]
    children: list = field(default_factory=list)  # nodes and strings


def _attributes(source: str, at: int) -> tuple[dict[str, str], int, bool]:
    """The attributes from at, where the tag ends, and whether it closes itself."""
    found: dict[str, str] = {}
    while at < len(source) and source[at] != ">":
        m = _ATTRIBUTE.match(source, at)
        if m and m.end() > at:
            value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]
            found.setdefault(m[1].lower(), html.unescape(value or ""))
            at = m.end()
        else:
            at += 1
    return found, at + 1, source[at - 1 : at] == "/"


class _Builder:
    def __init__(self) -> None:
        self.root = Node("", {})
        self.open = [self.root]
        self.depths: dict[str, list[int]] = {}  # of each name's open elements

    def text(self, s: str) -> None:
        if s:
            if self.open[-1].name == "head" and s.strip():
                self._close_to(len(self.open) - 1)
            self.open[-1].children.append(s)

    def _last(self, names: frozenset[str]) -> int:
        return max((d[-1] for n in names if (d := self.depths.get(n))), default=0)

    def _find(self, names: frozenset[str], limits: frozenset[str]) -> int:
        """The depth of the outermost open element of names within the innermost one of limits; 0 if there is none."""
        floor = self._last(limits)
        found = [d[k] for n in names if (d := self.depths.get(n)) and (k := bisect_right(d, floor)) < len(d)]
        return min(found, default=0)

    def _close_to(self, depth: int) -> None:
        if depth:
            for node in self.open[depth:]:
                self.depths[node.name].pop()
            del self.open[depth:]

    def start(self, name: str, attributes: dict[str, str], closed: bool) -> None:
        if self.open[-1].name == "head" and name not in _HEAD_ONLY:
            self._close_to(len(self.open) - 1)
        if name in _ENDS_P:
            self._close_to(self._find(frozenset(("p",)), _SCOPE))
        if name[0] == "h" and name in ("h1", "h2", "h3", "h4", "h5", "h6") and self.open[-1].name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._close_to(len(self.open) - 1)
        if name in _IMPLIED:
            self._close_to(self._find(*_IMPLIED[name]))
        node = Node(name, attributes)
        self.open[-1].children.append(node)
        if name not in VOID and not closed:
            self.depths.setdefault(name, []).append(len(self.open))
            self.open.append(node)

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", {}, True)
        elif self.depths.get(name):
            if name in ("table", "html", "body", "template"):
                limits: frozenset[str] = frozenset()
            else:
                limits = frozenset(("table",) if name in _ROWS else ("table", "td", "th"))
            depth = self.depths[name][-1]
            if self._last(limits) <= depth:
                self._close_to(depth)


def tree(source: str) -> Node:
    """The tree of a page."""
    builder, at, lower = _Builder(), 0, None
    gone: set[str] = set()  # what isn't in the rest of the page, so that it is sought once
    while at < len(source):
        lt = source.find("<", at)
        if lt < 0:
            break
        builder.text(html.unescape(source[at:lt]))
        if source.startswith("<!--", lt):
            end = -1 if "-->" in gone else source.find("-->", lt + 4)
            if end < 0:
                gone.add("-->")
                at = len(source)
            else:
                at = end + 3
        elif source.startswith(("<!", "<?"), lt):
            end = source.find(">", lt)
            at = len(source) if end < 0 else end + 1
        elif m := _TAG.match(source, lt):
            name = m[1].lower()
            attributes, at, closed = _attributes(source, m.end())
            if source[lt + 1] == "/":
                builder.end(name)
                continue
            builder.start(name, attributes, closed and name not in RAW)
            if name in RAW and builder.open[-1].name == name:
                if name in gone:
                    end = -1
                else:
                    lower = source.lower() if lower is None and len(source.lower()) == len(source) else lower
                    end = lower.find(f"</{name}", at) if lower is not None else next((k.start() for k in re.compile(f"</{re.escape(name)}", re.I).finditer(source, at)), -1)
                if end < 0:
                    gone.add(name)
                    end = len(source)
                raw = source[at:end]
                builder.text(html.unescape(raw) if name in ("title", "textarea") else raw)
                at = end
        else:
            builder.text("<")
            at = lt + 1
    else:
        return builder.root
    builder.text(html.unescape(source[at:]))
    return builder.root


def _declared(source: str) -> dict[str, tuple[bool, str]]:
    """Display and visibility among declarations, and whether they are important; of several the last important one, or else the last."""
    found: dict[str, tuple[bool, str]] = {}
    for part in _COMMENT.sub(" ", source).lower().split(";"):
        name, colon, value = part.partition(":")
        if colon and (name := name.strip()) in ("display", "visibility"):
            value, mark, _ = value.partition("!")
            if mark or not found.get(name, (False, ""))[0]:
                found[name] = (bool(mark), value.strip())
    return found


class _Styles:
    """What decides on visibility: the rules of a page's sheets by (name, class or id) and those in the elements."""

    def __init__(self, root: Node) -> None:
        self.rules: dict[tuple[str, str], dict[str, tuple]] = {}
        stack, self.read = [root], 0
        while stack:
            x = stack.pop()
            if x.name == "style":
                self._add("".join(c for c in x.children if isinstance(c, str)))
            elif x.name == "head" or x.name not in UNSEEN:
                stack += [c for c in reversed(x.children) if not isinstance(c, str)]

    def _add(self, sheet: str) -> None:
        parts = re.split("([{}])", _COMMENT.sub(" ", sheet)) + ["}"]
        blocks: list[tuple[bool, str | None]] = []  # of each open one, whether it counts, and its selectors
        for text, brace in zip(parts[::2], parts[1::2], strict=True):
            counts, selectors = blocks[-1] if blocks else (True, None)
            if brace == "{":
                text = text.rsplit(";", 1)[-1].strip()
                at = text.startswith("@")
                blocks.append((counts and selectors is None and (not at or bool(_SCREEN.fullmatch(text))), None if at else text))
            elif blocks:
                blocks.pop()
                if counts and selectors and (declared := _declared(text)):
                    for one in selectors.split(","):
                        self._rule(one.strip(), declared)

    def _rule(self, selector: str, declared: dict[str, tuple[bool, str]]) -> None:
        if m := _SELECTOR.fullmatch(selector):
            name = "" if m[1] in (None, "*") else m[1].lower()
            known = self.rules.setdefault((name, (m[2] or "") + (m[3] or "")), {})
            self.read += 1
            for what, (important, value) in declared.items():
                weight = (important, False, m[2] == "#", m[2] == ".", bool(name), self.read)
                known[what] = max(known.get(what, ()), (weight, value))

    def seen(self, node: Node, inherited: bool) -> bool | None:
        """Whether text in an element shows where it sets nothing else; None if the element has no rendering."""
        if node.name in UNSEEN or node.name == "input":
            return None
        a = node.attributes
        own = {what: ((important, True), value) for what, (important, value) in _declared(a["style"]).items()} if a.get("style") else {}
        if self.rules:
            marks = ["", *("." + c for c in a.get("class", "").split()), *(["#" + a["id"]] if a.get("id") else [])]
            for rule in (r for mark in marks for name in {"", node.name} if (r := self.rules.get((name, mark)))):
                for what, found in rule.items():
                    own[what] = max(own.get(what, ()), found)
        if (own["display"][1] == "none") if "display" in own else "hidden" in a:
            return None
        visibility = own["visibility"][1] if "visibility" in own else ""
        return False if visibility in ("hidden", "collapse") else visibility in ("visible", "initial") or inherited

    def below(self, node: Node, shown: bool) -> list[tuple[Node | str, bool]]:
        """The children of a node and what they inherit; of svg and select those that a browser shows, wherever they stand in it."""
        if node.name not in ("svg", "select"):
            return [(c, shown) for c in node.children]
        found, stack = [], [(c, shown) for c in reversed(node.children)]
        while stack:
            x, inherited = stack.pop()
            if isinstance(x, str) or (own := self.seen(x, inherited)) is None:
                continue
            if x.name in (("text", "foreignobject") if node.name == "svg" else ("option",)):
                found.append((x, inherited))
            elif node.name == "select" or x.name not in _SVG_UNSEEN:
                stack += [(c, own) for c in reversed(x.children)]
        if node.name == "svg":
            return [y for x in found for y in ((" ", shown), x, (" ", shown))]
        options = [(Node("option", x.attributes, [x.attributes["label"]]) if x.attributes.get("label") else x, own) for x, own in found]
        if "multiple" in node.attributes or _number(node.attributes.get("size"), 1) > 1:
            return options
        chosen = [x for x, _ in options if "selected" in x.attributes][-1:] or [x for x, _ in options if "disabled" not in x.attributes] or [x for x, _ in options]
        return [(c, shown) for c in (" ", *chosen[0].children, " ")] if chosen else []


class _Lines:
    """Rendered lines; gap is how many line ends stand before what comes next."""

    def __init__(self, prefix: str = "") -> None:
        self.done: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.blank = False
        self.prefix = prefix
        self.marker = ""

    def add(self, s: str) -> None:
        words = _SPACES.sub(" ", s)
        body = words.strip(" ")
        if not body:
            self.space = self.space or bool(words and self.now)
            return
        if not self.now:
            if self.blank and self.done:
                self.done.append("")
            self.blank = False
            self.now.append(self.marker or self.prefix)
            self.marker = ""
        elif self.space or words[0] == " ":
            self.now.append(" ")
        self.now.append(body)
        self.space = words[-1] == " "

    def line(self) -> None:
        if self.now:
            self.done.append("".join(self.now))
            self.now = []
        self.space = False

    def gap(self) -> None:
        self.line()
        self.blank = True

    def exact(self, s: str) -> None:
        """Lines as they are."""
        self.line()
        if not s.strip():
            return
        if self.blank and self.done:
            self.done.append("")
        self.blank = False
        self.done += [((self.marker if k == 0 and self.marker else self.prefix) + row).rstrip() for k, row in enumerate(s.split("\n"))]
        self.marker = ""

    def text(self) -> str:
        self.line()
        return "\n".join(self.done)


def _number(text: str | None, default: int) -> int:
    return int(text) if text and re.fullmatch(r"\s*-?[0-9]{1,9}\s*", text) else default


def _aligned(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    widths = [max((len(r[k]) for r in rows if k < len(r)), default=0) for k in range(width)]
    starts = [0, *accumulate(w + 2 for w in widths)]
    text = sum(len(c) for r in rows for c in r)
    # a row is padded up to its last cell with text
    last = [max((k for k, c in enumerate(r) if c), default=0) for r in rows]
    padding = sum(starts[k] + len(r[k]) if r else 0 for k, r in zip(last, rows)) - text
    if padding > max(MAX_PADDING, PADDING_RATIO * text):
        return "\n".join("\t".join(r).rstrip() for r in rows)
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows)


def _plain(node: Node, styles: _Styles, shown: bool) -> str:
    """All visible text below a node as it is, for pre."""
    out, stack = [], styles.below(node, shown)[::-1]
    while stack:
        x, inherited = stack.pop()
        if isinstance(x, str):
            out += [x] if inherited else []
        elif x.name == "br":
            out.append("\n")
        elif (own := styles.seen(x, inherited)) is not None:
            stack += styles.below(x, own)[::-1]
    return "".join(out).replace("\r\n", "\n").replace("\r", "\n").strip("\n")


def render(root: Node) -> str:
    """The visible text of a tree."""
    # work is (action, argument, shown): a node to enter, a string, or what ends an element; frames hold the lines being made
    styles = _Styles(root)
    frames: list[_Lines] = [_Lines()]
    tables: list[dict] = []
    lists: list[list] = []
    work: list[tuple[str, object, bool]] = [("in", root, True)]
    while work:
        action, x, shown = work.pop()
        lines = frames[-1]
        if action == "in":
            if isinstance(x, str):
                if shown:
                    lines.add(x)
                continue
            if x is not root and (shown := styles.seen(x, shown)) is None:
                continue
            name = x.name
            if name == "br":
                if lines.now:
                    lines.line()
                elif shown:
                    lines.blank = True  # an empty line, as after another br or a block
                continue
            if name == "hr":
                lines.gap()
                continue
            if name in ("pre", "textarea", "xmp"):
                (lines.gap if name == "pre" else lines.line)()
                lines.exact(_plain(x, styles, shown))
                (lines.gap if name == "pre" else lines.line)()
                continue
            if name == "table":
                lines.gap()
                tables.append({"rows": [], "caption": "", "depth": len(frames), "held": {}})
            elif name in ("thead", "tbody", "tfoot") and tables:
                tables[-1]["held"] = {}
                lines.line()
            elif name == "tr" and tables:
                tables[-1]["rows"].append([])
                tables[-1]["own"] = len(frames)
            elif name in ("td", "th", "caption") and tables:
                frames.append(_Lines())
                lists.append(["cell", 0])
            elif name in BLOCK:
                nested = name in ("ul", "ol", "menu", "dir") and lists and lists[-1][0] != "cell"
                lines.gap() if name in SPACED and not nested else lines.line()
            if name in ("ul", "ol", "menu", "dir"):
                lists.append([name, _number(x.attributes.get("start"), 1)])
            elif name == "li":
                kind = lists[-1] if lists and lists[-1][0] != "cell" else ["ul", 0]
                depth = sum(1 for k in lists if k[0] != "cell") - 1
                at = "- "
                if kind[0] == "ol":
                    kind[1] = _number(x.attributes.get("value"), kind[1])
                    at = f"{kind[1]}. "
                    kind[1] += 1
                indent = "  " * max(0, min(depth, DEEPEST))
                work.append(("item", lines.prefix, shown))
                lines.marker, lines.prefix = indent + at, indent + " " * len(at)
            work.append(("out", x, shown))
            work += [("in", c, own) for c, own in reversed(styles.below(x, shown))]
        elif action == "item":
            lines.line()
            lines.prefix, lines.marker = x, ""
        else:
            name = x.name
            if name == "table":
                made = tables.pop()
                if made["caption"]:
                    lines.exact(made["caption"])
                lines.exact(_aligned([r for r in made["rows"] if any(r)]))
                lines.gap()
            elif name in ("td", "th", "caption") and tables:
                text = " ".join(row.strip() for row in frames.pop().text().split("\n") if row.strip())
                lists.pop()
                made = tables[-1]
                if name == "caption":
                    made["caption"] = text
                else:
                    if not made["rows"]:
                        made["rows"].append([])
                    row, held, at = made["rows"][-1], made["held"], len(made["rows"]) - 1
                    # held: of each column the last row that a cell from above stands in
                    while held.get(len(row), -1) >= at:
                        row.append("")
                    first = len(row)
                    row += [text, *[""] * (min(WIDEST, _number(x.attributes.get("colspan"), 1)) - 1)]
                    if (span := _number(x.attributes.get("rowspan"), 1)) != 1 and span >= 0:
                        # 0 stands for the rest of the row group
                        held.update(dict.fromkeys(range(first, len(row)), at + span - 1 if span else 1 << 30))
            elif name in ("thead", "tbody", "tfoot") and tables:
                tables[-1]["held"] = {}
                lines.line()
            elif name in ("ul", "ol", "menu", "dir"):
                lists.pop()
                nested = lists and lists[-1][0] != "cell"
                lines.line() if nested else lines.gap()
            elif name in SPACED:
                lines.gap()
            elif name in BLOCK:
                lines.line()
    return frames[0].text()


def page_text(source: str | None) -> str | None:
    """The text of a page; null for null, empty for a page without visible text."""
    return None if source is None else render(tree(source))


@F.arrow_udf(T.StringType())
def _page_text_udf(pages: pa.Array) -> pa.Array:
    return pa.array([page_text(p) for p in pages.to_pylist()], pa.string())


def extract_text(html_column: str | Column = "html") -> Column:
    """The text of a column of pages: null for null, empty for an empty page or one without visible text.

    Each row is read alone: repeated rows give equal texts, an empty table gives no rows.
    """
    c = F.col(html_column) if isinstance(html_column, str) else html_column
    return _page_text_udf(c.cast("string"))
