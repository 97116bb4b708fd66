"""Layout-aware text of HTML pages.

A tokenizer cuts the page into tags and text; a tree builder opens implied
elements' scopes (a block closes an open p, an item the item before it, a row
the row and cell before it, and so on), ignores end tags that close nothing
and closes what is left open. A renderer walks the tree in order: elements
that are not shown give nothing; white space is collapsed outside pre and
textarea; blocks stand on lines of their own and paragraphs, headings, lists,
tables and the like have blank lines about them; items have bullets or numbers
(start, value and reversed count) and are indented by depth; a table's cells
are padded to their columns' width, over the columns that they span, and stay
empty where a cell from above reaches down.

The tree is walked as it is built: only the open elements are held, so depth
costs no recursion, and each page is one row's work.

Head ends at its end tag, at any start tag that does not belong there and at
text. The texts of svg and math are shown, each text element of a drawing on a
line of its own. Visibility is inherited and may be set again by an element
within; what is not displayed stays so with all that it holds.

Fields and buttons show their value (of an input that shows one as text).

Not shown: head, script, style, template, noscript, title, datalist, rp, elements
with the hidden attribute, with display:none or visibility:hidden in their
style, hidden inputs, dialog and details contents that are not open (a summary
stays); what iframe, noembed, noframes, object, audio, video and canvas hold
for browsers that cannot show them; descriptions and definitions in svg,
annotations and phantoms in math.

Bounds: time and output are linear in the page, and text is never dropped for
them. Padding and deep indentation take ``ROOM`` times the page and 64 KB at
most; beyond that a table's cells are set side by side unpadded, and lines
more than ``DEEP`` levels deep are indented like those. Tables within ``NESTED``
others are set as blocks, a line a cell.

Defined cases: null and empty pages give empty text; a page of any length is
rendered whole, in one worker's memory; malformed markup never fails (a ``<``
that starts no tag is text, unknown entities stay as they are, NUL characters
are dropped); repeated rows are rendered alike; an empty table gives no rows;
other columns are kept by ``extract``, whose result column must not be among
them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The elements' classes, from the public HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
#: Types of input that show no value as text.
NO_TEXT_INPUT = frozenset("hidden password checkbox radio file image range color".split())
ESCAPABLE_RAW = frozenset("title textarea".split())
NOT_SHOWN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist rp".split())
#: Start tags that leave an open head open.
IN_HEAD = frozenset("base head html link meta noframes noscript script style template title".split())
#: Within svg or math only: what describes or defines and is not drawn in its
#: place, and elements whose contents are HTML again.
FOREIGN_NOT_SHOWN = {"svg": frozenset("desc metadata defs symbol clippath mask marker pattern".split()), "math": frozenset("annotation annotation-xml mphantom".split())}
#: HTML's start tags that end an svg or math.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
INTEGRATION = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
BLOCK = frozenset("address article aside body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul xmp caption blockquote".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu".split())
IN_TABLE = frozenset("table tbody thead tfoot tr".split())

#: What a start tag closes: open elements of ``closed`` up to one of ``scope``.
IMPLIED_ENDS = {
    "li": (frozenset(["li"]), LISTS | {"table", "td", "th"}),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"])),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select", "datalist"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "caption": (frozenset(["caption", "colgroup"]), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
#: Where the search for an open element that an end tag names stops.
END_SCOPE = frozenset(["table", "td", "th", "caption", "template", "html"])
#: Layout's share: characters of padding and deep indentation, times the page.
ROOM = 16
DEEP, NESTED = 32, 8
#: The HTML standard's limits of what a cell may span.
MOST_ACROSS, MOST_DOWN = 1000, 65534

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
TAG_END = re.compile(r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>""")
SPACE = re.compile(r"[ \t\n\r\f]+")
UNQUOTED_END = re.compile(r"""=\s*[^\s"'=<>`]+$""")
HIDING = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
NUMBER = re.compile(r"\s*(-?\d{1,9})")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text" | "raw" | "start" | "end", name or text, attributes)."""
    at, size, low, foreign = 0, len(page), None, 0
    find = page.find
    while at < size:
        lt = find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        follow = page[lt + 1 : lt + 2]
        if follow.isascii() and follow.isalpha():
            name = NAME.match(page, lt + 1)
            end = TAG_END.match(page, name.end())
            stop = end.end() if end else find(">", name.end()) + 1 or size
            tag = name[0].lower()
            yield "start", tag, page[name.end() : stop - 1]
            at = stop
            closed = foreign and self_closing(page[name.end() : stop - 1])
            foreign += tag in FOREIGN_NOT_SHOWN and not self_closing(page[name.end() : stop - 1])
            if (tag in RAW or tag in ESCAPABLE_RAW) and not closed:
                low = low or (page.lower() if len(page.lower()) == size else page)
                close = low.find(f"</{tag}", at)
                close = size if close < 0 else close
                yield ("raw" if tag in RAW else "text"), page[at:close], ""
                at = close
        elif follow == "/" and NAME.match(page, lt + 2):
            name = NAME.match(page, lt + 2)
            stop = find(">", name.end()) + 1 or size
            foreign = max(0, foreign - (name[0].lower() in FOREIGN_NOT_SHOWN))
            yield "end", name[0].lower(), ""
            at = stop
        elif page.startswith("<!--", lt):
            stop = find("-->", lt + 4)
            at = size if stop < 0 else stop + 3
        elif follow in ("!", "?", "/") and follow:
            at = find(">", lt + 2) + 1 or size
        else:
            yield "text", "<", ""
            at = lt + 1


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    return found


def self_closing(text: str) -> bool:
    """Whether a tag ends in a slash that is no part of an unquoted value."""
    return text.endswith("/") and not UNQUOTED_END.search(text)


def hidden(tag: str, given: dict[str, str]) -> bool:
    return tag in NOT_SHOWN or "hidden" in given or (tag == "dialog" and "open" not in given) or (tag == "input" and given.get("type", "").lower() == "hidden") or bool(HIDING.search(given.get("style", "")))


def number(given: dict[str, str], name: str) -> int | None:
    found = NUMBER.match(given.get(name, ""))
    return int(found[1]) if found else None


class Room:
    """How many characters layout may still add to a page's text."""

    def __init__(self, left: int) -> None:
        self.left = left

    def take(self, n: int) -> bool:
        if n > self.left:
            return False
        self.left -= n
        return True


class Listing:
    """An open list: the next number, or none for bullets."""

    def __init__(self, tag: str, given: dict[str, str]) -> None:
        first, self.back = number(given, "start"), tag == "ol" and "reversed" in given
        self.next = None if tag != "ol" else first if first is not None else 1
        # A reversed list counts down from the number of its items, which is
        # known at its end: (line, place) of the markers until then.
        self.waiting: list[tuple[int, int]] | None = [] if self.back and first is None else None
        self.items = 0
        self.known = self.waiting is None  # whether the next number is

    def marker(self, given: dict[str, str]) -> str:
        self.items += 1
        if self.next is None:
            return "- "
        value = number(given, "value")
        if value is not None:
            self.next, self.known = value, True
        if not self.known:
            return f"\0{self.items}\0. "
        self.next += -1 if self.back else 1
        return f"{self.next + (1 if self.back else -1)}. "


class Lines:
    """Text laid out as lines: collapses white space and block gaps."""

    def __init__(self, room: Room) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.room, self.depth, self.gap, self.marker, self.space = room, 0, 0, "", False
        self.listing: Listing | None = None  # whose item the marker is

    def text(self, data: str) -> None:
        """Inline text, white space collapsed."""
        words = SPACE.sub(" ", data)
        if words[:1] == " ":
            self.space, words = bool(self.now), words[1:]
        if words:
            trailing = words[-1] == " "
            self.write((" " if self.space else "") + (words[:-1] if trailing else words))
            self.space = trailing

    def write(self, data: str) -> None:
        if not self.now:
            while self.gap and self.lines and (len(self.lines) < self.gap or any(self.lines[-self.gap :])):
                self.lines.append("")
            deep = self.depth if self.depth <= DEEP or self.room.take(2 * self.depth) else DEEP
            self.now.append("  " * deep + self.marker)
            if self.marker[:1] == "\0" and self.listing is not None and self.listing.waiting is not None:
                self.listing.waiting.append((len(self.lines), int(self.marker[1:-3])))
            self.marker = ""
        self.gap, self.space = 0, False
        self.now.append(data)

    def newline(self) -> None:
        """End the line; on an empty one, nothing."""
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []
        self.space = False

    def blank(self) -> None:
        self.newline()
        self.gap = 1

    def preserved(self, data: str) -> None:
        for k, line in enumerate(data.replace("\r\n", "\n").split("\n")):
            if k:
                if not self.now:
                    self.write("")
                self.newline()
            if line:
                self.write(line)

    def block(self, lines: list[str]) -> None:
        for line in lines:
            self.write(line)
            self.newline()

    def counted(self, listing: Listing) -> None:
        """Put the numbers into a reversed list's markers."""
        for line, place in listing.waiting or []:
            self.lines[line] = self.lines[line].replace(f"\0{place}\0", str(listing.items + 1 - place), 1)

    def done(self) -> list[str]:
        self.newline()
        first, last = 0, len(self.lines)
        while first < last and not self.lines[first]:
            first += 1
        while last > first and not self.lines[last - 1]:
            last -= 1
        return self.lines[first:last]


class Table:
    """A table's rows of cells: (lines, columns across, rows down)."""

    def __init__(self, room: Room) -> None:
        self.room = room
        self.rows: list[list[tuple[list[str], int, int]]] = []

    def lines(self) -> list[str]:
        placed = self.placed()
        return self.plain() if placed is None else placed

    def plain(self) -> list[str]:
        """Cells side by side, unpadded."""
        out = []
        for row in self.rows:
            cells, k = [c for c, _, _ in row if c], 0
            while cells:
                out.append(" | ".join(c[k] for c in cells))
                k += 1
                cells = [c for c in cells if len(c) > k]
        return out

    def spots(self) -> list[list[tuple[int, int, list[str]]]] | None:
        """Each row's (first column, end, lines), without gaps: where a cell
        from above reaches down it is one without lines. None: far more of
        those than cells."""
        out, above, steps = [], [], 16 * sum(map(len, self.rows)) + 4096
        for r, row in enumerate(self.rows):
            here, down, col, k = [], [], 0, 0
            steps -= len(above)
            if steps < 0:
                return None
            for lines, across, rows in row:
                while k < len(above) and above[k][0] <= col:
                    here.append((*above[k][:2], []))
                    col, k = above[k][1], k + 1
                end = min(col + across, above[k][0]) if k < len(above) else col + across
                here.append((col, end, lines))
                if rows != 1:
                    down.append((col, end, r + (rows or len(self.rows))))
                col = end
            above = sorted([a for a in above if a[2] > r + 1] + down)
            out.append(here)
        return out

    def placed(self) -> list[str] | None:
        """The rows with their cells in columns; None where that would take
        more room than there is."""
        rows = self.spots()
        if rows is None:
            return None
        rows = [r for r in rows if any(lines for _, _, lines in r)]
        edges = sorted({e for r in rows for first, end, _ in r for e in (first, end)})
        track = {e: k for k, e in enumerate(edges)}
        spans = [(track[first], track[end], max(map(len, lines), default=0)) for r in rows for first, end, lines in r]
        if sum(j - i for i, j, _ in spans) > 16 * len(spans) + 4096:
            return None
        widths = [0] * max(0, len(edges) - 1)
        for i, j, width in sorted(spans, key=lambda s: s[1] - s[0]):
            widths[j - 1] = max(widths[j - 1], width - sum(widths[i : j - 1]) - 3 * (j - 1 - i))
        starts = [0]
        for width in widths:
            starts.append(starts[-1] + width + 3)
        height = [max(len(lines) for _, _, lines in r) for r in rows]
        if not self.room.take(sum(h * starts[track[r[-1][0]]] for r, h in zip(rows, height, strict=True))):
            return None
        out = []
        for row, h in zip(rows, height, strict=True):
            for k in range(h):
                out.append(" | ".join((lines[k] if k < len(lines) else "").ljust(starts[track[end]] - starts[track[first]] - 3) for first, end, lines in row).rstrip())
        return out


class Renderer:
    """Builds the tree's open path and lays out what it shows."""

    def __init__(self, room: int = 1 << 30) -> None:
        self.open: list[tuple[str, bool, bool]] = []  # (tag, whether it hides, whether it was seen before)
        self.places: dict[str, list[int]] = {}  # of the open elements, by tag
        self.hiding = self.kept = 0
        self.seen, self.room = True, Room(room)
        self.out, self.outs, self.tables, self.lists = Lines(self.room), [], [], []

    def count(self, tag: str) -> int:
        return len(self.places.get(tag, ()))

    def start(self, tag: str, text: str) -> None:
        while self.open and self.open[-1][0] == "head" and tag not in IN_HEAD:
            self.pop()
        foreign = self.foreign()
        if foreign and tag in BREAKOUT:
            self.close_to(frozenset(FOREIGN_NOT_SHOWN), INTEGRATION)
        if tag in CLOSES_P and self.count("p"):
            self.close_to(frozenset(["p"]), END_SCOPE | {"button"})
        if tag in HEADINGS and self.open and self.open[-1][0] in HEADINGS:
            self.pop()
        if tag in IMPLIED_ENDS:
            self.close_to(*IMPLIED_ENDS[tag])
        if (tag in ("html", "body") and self.count(tag)) or (tag == "html" and self.open):
            return
        if tag == "form" and self.open and self.open[-1][0] in IN_TABLE:
            return  # a form between a table's rows has no place in the tree
        given = attributes(text) if "=" in text or "hidden" in text or tag in ("dialog", "input", "details", "ol") else {}
        hides = any(tag in FOREIGN_NOT_SHOWN[f] for f in foreign) or hidden(tag, given)
        if tag == "summary" and self.open and self.open[-1][:2] == ("details", True):
            hides = False
            self.hiding -= 1  # shown although its parent's contents are not
        elif tag == "details" and not hides:
            hides = "open" not in given
        if tag in VOID:
            if not hides and not self.hiding:
                self.void(tag, given)
            return
        if (foreign or tag in FOREIGN_NOT_SHOWN) and self_closing(text):
            return
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, hides, self.seen))
        found = VISIBILITY.search(given.get("style", ""))
        if found:
            self.seen = found[1].lower() == "visible"
        if hides:
            self.hiding += 1
        if not self.hiding:
            self.enter(tag, given)

    def foreign(self) -> list[str]:
        return [f for f in FOREIGN_NOT_SHOWN if self.count(f)]

    def block(self, tag: str) -> bool:
        return tag in BLOCK or (tag == "text" and bool(self.count("svg")))

    def void(self, tag: str, given: dict[str, str]) -> None:
        if tag == "br":
            if not self.out.now and self.seen:
                self.out.write("")
            self.out.newline()
        elif tag == "hr":
            self.out.blank()
        elif tag == "input" and self.seen and given.get("type", "").strip().lower() not in NO_TEXT_INPUT:
            self.out.text(f" {given.get('value', '')} ")

    def enter(self, tag: str, given: dict[str, str]) -> None:
        out = self.out
        if tag in SPACED and not (tag in LISTS and self.lists):
            out.blank()
        elif self.block(tag):
            out.newline()
        if tag in LISTS:
            self.lists.append(Listing(tag, given))
            out.depth += len(self.lists) > 1
        elif tag == "li":
            out.listing = self.lists[-1] if self.lists else None
            out.marker = out.listing.marker(given) if out.listing else "- "
            if not self.seen:
                out.marker = ""
        elif tag in ("dd", "blockquote"):
            out.depth += 1
        elif tag in ("pre", "textarea", "xmp"):
            self.kept += 1
        elif tag == "table":
            self.tables.append(Table(self.room) if len(self.tables) < NESTED else None)
        elif tag == "tr" and self.table():
            self.table().rows.append([])
        elif tag in ("td", "th") and self.table():
            if not self.table().rows:
                self.table().rows.append([])
            across, down = number(given, "colspan"), number(given, "rowspan")
            span = (min(max(across or 1, 1), MOST_ACROSS), min(max(1 if down is None else down, 0), MOST_DOWN))
            self.outs.append((self.out, self.lists, span))
            self.out, self.lists = Lines(self.room), []

    def table(self) -> Table | None:
        """The table that cells go to; none where they are set as blocks."""
        return self.tables[-1] if self.tables else None

    def leave(self, tag: str) -> None:
        out = self.out
        if tag in ("td", "th") and self.table():
            cell = out.done()
            self.out, self.lists, span = self.outs.pop()
            self.table().rows[-1].append((cell, *span))
            return
        if tag == "table" and self.tables:
            out.newline()
            made = self.tables.pop()
            if made:
                out.block(made.lines())
        if tag in LISTS and self.lists:
            out.newline()
            out.depth -= len(self.lists) > 1
            out.counted(self.lists.pop())
        elif tag in ("dd", "blockquote"):
            out.newline()
            out.depth -= 1
        elif tag in ("pre", "textarea", "xmp"):
            self.kept -= 1
        if tag in SPACED and not (tag in LISTS and self.lists):
            out.blank()
        elif self.block(tag):
            out.newline()
        if tag == "li":
            out.marker = ""

    def pop(self) -> None:
        tag, hides, seen = self.open.pop()
        self.places[tag].pop()
        if not self.hiding:
            self.leave(tag)
        self.seen = seen
        if hides:
            self.hiding -= 1
        if tag == "summary" and self.open and self.open[-1][:2] == ("details", True):
            self.hiding += 1

    def close_to(self, closed: frozenset, scope: frozenset) -> None:
        """Close the nearest open element of ``closed`` that is in scope."""
        nearest = lambda tags: max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)
        at = nearest(closed)
        if at >= 0 and at >= nearest(scope):
            while len(self.open) > at:
                self.pop()

    def end(self, tag: str) -> None:
        if tag in HEADINGS:
            self.close_to(HEADINGS, END_SCOPE)
        elif tag == "p" and not self.count("p"):
            if not self.hiding:
                self.out.blank()
        elif tag == "br":
            self.start("br", "")
        elif tag in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption", "table"):
            self.close_to(frozenset([tag]), frozenset(["table", "html"]) - {tag})
        elif tag not in ("html", "body"):
            self.close_to(frozenset([tag]), END_SCOPE - {tag})

    def text(self, data: str) -> None:
        while self.open and self.open[-1][0] == "head" and SPACE.sub("", html.unescape(data)):
            self.pop()
        if self.hiding or not self.seen:
            return
        if "&" in data:
            data = html.unescape(data)
        data = data.replace("\0", "")
        if self.kept:
            self.out.preserved(data)
        elif self.table() and self.open[-1][0] in IN_TABLE:
            if not data.isspace():  # misplaced in a table: a row of its own
                cell = Lines(self.room)
                cell.text(data)
                self.table().rows.append([(cell.done(), 1, 1)])
        else:
            self.out.text(data)

    def done(self) -> str:
        while self.open:
            self.pop()
        return "\n".join(self.out.done())


def render(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    r = Renderer(ROOM * len(page) + (1 << 16))
    for kind, data, given in tokens(page):
        if kind == "text":
            r.text(data)
        elif kind == "start":
            r.start(data, given)
        elif kind == "end":
            r.end(data)
        elif r.open and r.open[-1][0] == "xmp":
            r.text(data.replace("&", "&amp;"))
    return r.done()


def extract(pages: DataFrame, html_column: str = "html", text_column: str = "text") -> DataFrame:
    """``pages`` with the visible text of ``html_column``."""
    if text_column in pages.columns:
        raise ValueError(f"the pages have a column {text_column} already")

    @F.pandas_udf("string")
    def rendered(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([render(p) for p in batch], dtype=object)

    return pages.withColumn(text_column, rendered(pages[html_column]))
