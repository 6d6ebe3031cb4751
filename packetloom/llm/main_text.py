"""Main text of web pages by the distribution of line blocks.

Markup is stripped block by block: every block of the page is one line, and a block that belongs to
a menu, header, footer, sidebar, notice, advert, form, script, style or comment section leaves a line
of length zero. The lengths of three neighbouring lines are summed over a window that slides down
the page. Text begins at a surge, where the sum rises above the threshold, and ends at a dive,
where three lines in a row are empty; everything between a surge and its dive is kept.

Where a page marks its article (``article``, ``main``), lines outside it have length zero and
the threshold is zero, so even the shortest paragraph of the article stays. Elsewhere lines made up mostly of
links have length zero and a surge needs more than ``SURGE`` code points; where no window has so
many, any text is a surge.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

from packetloom.llm.common import map_rows

WINDOW, SURGE = 3, 80

TOKEN = re.compile(
    r"<(?:!--.*?(?:-->|\Z)"
    r"|(script|style|textarea|iframe|noscript|template|svg|xmp|noembed|noframes)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+>"
    r"""|(/?)([a-zA-Z][^\s/><"']*+)((?>"[^"]*"|'[^']*'|[^"'<>]++)*+)>)""", re.S | re.I)
ATTRIBUTE = re.compile(r"""([^\s"'=/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark meter output picture progress q "
                   "ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINER = frozenset("article main".split())
DROPPED = frozenset("head nav header footer aside form button select option dialog menu object audio video canvas".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond reply replies sidebar aside "
    "widget related recommended recommendations share sharing social breadcrumb breadcrumbs menu nav navbar navigation footer header masthead "
    "toolbar pagination pager skip copyright".split())
NEGATIONS = frozenset("has with no without".split())
#: A new block of these names ends an open one of the same family, up to the named border.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BORDERS = frozenset("ul ol dl table tbody thead select article main body".split())


def dropped_by_attributes(attributes: str) -> bool:
    """Whether id, class, role or visibility mark an element as no part of an article."""
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            for label in value.split():
                words = re.findall("[a-z0-9]+", re.sub("([a-z])([A-Z])", r"\1 \2", label).lower())
                if not DROPPED_WORDS.isdisjoint(words) and words[0] not in NEGATIONS:
                    return True
        elif name == "role" and value.lower() in DROPPED_ROLES or name == "hidden":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


class Lines:
    """Walks the tags of a page and collects its lines: text, code points inside links, and whether inside an article."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, int, bool]] = []  # dropped elements leave ("", 0, False)
        self.parts: list[str] = []
        self.linked = self.dropped = self.inside = self.links = 0
        self.stack: list[tuple[str, str]] = []  # (name, "drop" | "keep" | "")
        self.open: dict[str, int] = {}

    def text(self, raw: str) -> None:
        if not self.dropped and raw:
            part = html.unescape(raw) if "&" in raw else raw
            self.parts.append(part)
            if self.links:
                self.linked += len(part)

    def end_line(self) -> None:
        if self.parts:
            line = " ".join("".join(self.parts).split())
            if line:
                self.lines.append((line, min(self.linked, len(line)), self.inside > 0))
            self.parts.clear()
        self.linked = 0

    def push(self, name: str, kind: str) -> None:
        self.stack.append((name, kind))
        self.open[name] = self.open.get(name, 0) + 1
        self.dropped += kind == "drop"
        self.inside += kind == "keep"
        self.links += name == "a"

    def pop(self) -> str:
        name, kind = self.stack.pop()
        self.open[name] -= 1
        self.dropped -= kind == "drop"
        self.inside -= kind == "keep"
        self.links -= name == "a"
        if kind == "drop" and not self.dropped and name not in INLINE:
            self.lines.append(("", 0, False))
        return name

    def close(self, names: tuple[str, ...], within: frozenset[str] = frozenset()) -> None:
        """Ends the innermost open element of these names, and all it holds, unless a border lies between."""
        if not any(self.open.get(n) for n in names):
            return
        if within:
            for name, _ in reversed(self.stack):
                if name in names:
                    break
                if name in within:
                    return
        while self.pop() not in names:
            pass

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            return self.text(" ")
        if name not in INLINE:
            self.end_line()
            self.close(("p",))
            if self.open.get("head") and name not in ("title", "meta", "link", "base"):
                self.close(("head",))
            if name in SIBLINGS:
                self.close(SIBLINGS[name], BORDERS)
        if name in VOID or attributes.endswith("/") and name not in CONTAINER:
            return None
        kind = "keep" if name in CONTAINER else "drop" if name in DROPPED else ""
        if attributes and name not in ("html", "body"):
            if "role" in attributes and re.search(r"""role\s*=\s*["']?main\b|itemprop\s*=\s*["']?articleBody""", attributes, re.I):
                kind = "keep"
            elif dropped_by_attributes(attributes):
                # comments are often articles of their own; a page's own main part is none, whatever it is called
                kind = "keep" if name == "main" else "drop"
        if kind == "keep" and name != "article" or kind == "keep" and not self.inside:
            self.undo_labels()
        return self.push(name, kind)

    def undo_labels(self) -> None:
        """An article opens: what holds it is no boilerplate, whatever its class says; menus, headers and the like are."""
        for i, (name, kind) in enumerate(self.stack):
            if kind == "drop" and name not in DROPPED:
                self.stack[i] = (name, "")
                self.dropped -= 1

    def end(self, name: str) -> None:
        if name not in INLINE:
            self.end_line()
        self.close((name,))

    def read(self, page: str) -> list[tuple[str, int, bool]]:
        at = 0
        for m in TOKEN.finditer(page):
            self.text(page[at:m.start()])
            at = m.end()
            if m[3]:
                name = m[3].lower()
                self.end(name) if m[2] else self.start(name, m[4].strip())
        self.text(page[at:])
        self.end_line()
        return self.lines


def between_surges_and_dives(lengths: list[int], threshold: int) -> list[tuple[int, int]]:
    """(first line, line after the last) of every stretch from a surge to its dive; both ends have a length."""
    found, start = [], None
    for i in range(len(lengths) + 1):
        total = sum(lengths[i:i + WINDOW])
        if start is None and total > threshold:
            start = next(j for j in range(i, i + WINDOW) if lengths[j])
        elif start is not None and total == 0:
            found.append((start, next(j for j in range(i, start, -1) if lengths[j - 1])))
            start = None
    return found


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by an empty line; empty for null, empty or textless pages."""
    lines = Lines().read(page or "")
    if any(inside for _, _, inside in lines):
        lines = [(text if inside else "", 0, inside) for text, _, inside in lines]
        threshold = 0
    else:
        threshold = SURGE
    lengths = [0 if 2 * linked > len(text) else len(text) for text, linked, _ in lines]
    spans = between_surges_and_dives(lengths, threshold) or between_surges_and_dives(lengths, 0)
    return "\n\n".join(lines[i][0] for a, b in spans for i in range(a, b) if lines[i][0])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` (code points of the text), one row per row of ``pages``.

    Null or empty html has the empty text. Repeated rows and ids come back as often as they occur, null
    ids and urls as null; other columns are not read. Every page is read whole, inside its own row.
    """

    def start():
        def one(key, url, page):
            text = main_text(page)
            return [(key, url, text, len(text))]

        return one

    return map_rows(pages, ["page_id", "url", "html"], start, "page_id long, url string, text string, n_chars long", rows_out=2_000)
