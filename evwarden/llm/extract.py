"""The main text of web pages: markup stripped to lines, and the stretch between surge and dive of their lengths kept."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from evwarden.llm.common import map_blocks, text_of

#: Lines whose lengths are summed.
WINDOW = 3
#: Characters in a window at which the main text surges; the page's largest window if that is less.
SURGE = 80

# Element names of HTML, and words that name page furniture in class, id and role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
CONTAINERS = frozenset(
    "article aside blockquote details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "aside button canvas dialog footer form header iframe menu nav noscript object script select style svg template textarea title".split()
)
MAIN = frozenset(["article", "main"])
FURNITURE = frozenset(
    "ad ads adsbygoogle advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo promotion related replies reply respond share sharing sidebar social sponsor "
    "sponsored subscribe subscription toolbar widget".split()
)
REMARKS = frozenset("comment comments disqus replies reply respond".split())
#: Furniture at the borders of a page's text; other furniture stands in its flow.
BORDERS = frozenset("nav header footer navigation banner contentinfo masthead menu navbar".split())
WORD_SPLIT = str.maketrans({c: " " for c in "-_:/.\t\n\r\x0c"})


def _named(attrs: list[tuple[str, str | None]]) -> set[str]:
    return {w for k, v in attrs if v and k in ("class", "id", "role") for w in v.lower().translate(WORD_SPLIT).split()}


class _Closed(HTMLParser):
    """The numbers of the start tags, counted from 1, whose elements have an end tag of their own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.number = 0
        self.open: list[tuple[str, int]] = []
        self.count: Counter = Counter()
        self.closed: set[int] = set()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.number += 1
        if tag in CONTAINERS or tag in DROPPED and tag not in VOID:
            self.open.append((tag, self.number))
            self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        while self.count[tag]:
            name, number = self.open.pop()
            self.count[name] -= 1
            if name == tag:
                self.closed.add(number)
                return


class _Lines(HTMLParser):
    """Collects (text, length outside links, in an article) for each block, and None for a line of furniture outside articles."""

    def __init__(self, closed: set[int], window: int, revive: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.closed, self.window, self.revive = closed, window, revive
        self.number = 0
        self.lines: list[tuple[str, int, bool] | None] = []
        self.open: list[str] = []
        self.count: Counter = Counter()
        self.dropping: int | None = None  # how many elements were open when the dropped one began
        self.firm = self.named = False  # the dropped element has an end tag; it goes by its name alone
        self.hidden = False  # an article stands in such an element
        self.remarks = False
        self.main = 0
        self.links = 0
        self.buffer: list[str] = []
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.number += 1
        if self.dropping is not None:
            found = tag in MAIN and not self.remarks
            self.hidden |= found and self.named
            if found and (not self.firm or self.revive and self.named) or self.open[self.dropping] == "p" and tag in BLOCKS:
                self._close(self.dropping)  # an element left open does not swallow the article
            elif tag in VOID:
                return
            else:
                if tag in CONTAINERS or tag == self.open[self.dropping]:
                    self._push(tag)
                return
        if tag in BLOCKS:
            self._flush()
        if tag in VOID:
            if tag == "br":
                self.buffer.append(" ")
            return
        names = _named(attrs)
        kept = tag in ("html", "body", "main") or tag == "article" and not names & REMARKS
        if not kept and (tag in DROPPED or names & FURNITURE):
            self.dropping = len(self.open)
            self.remarks = bool(names & REMARKS)
            self.firm, self.named = self.number in self.closed, tag not in DROPPED
            self._push(tag)
            if not self.main:
                self.lines += [None] * (self.window if BORDERS & {tag, *names} else 1)
            return
        if tag == "a":
            self.links += 1
        if tag in CONTAINERS:
            self._push(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if self.dropping is None and tag in BLOCKS:
            self._flush()
        if tag == "a":
            self.links = max(0, self.links - 1)
        if self.count[tag]:
            at = len(self.open) - 1
            while self.open[at] != tag:
                at -= 1
            self._close(at)

    def handle_data(self, data: str) -> None:
        if self.dropping is None:
            self.buffer.append(data)
            if self.links:
                self.linked += len(data)

    def close(self) -> None:
        super().close()
        self._flush()

    def _push(self, tag: str) -> None:
        self.open.append(tag)
        self.count[tag] += 1
        self.main += tag in MAIN and self.dropping is None

    def _close(self, at: int) -> None:
        dropped = self.dropping
        for i in range(len(self.open) - 1, at - 1, -1):
            self.count[self.open[i]] -= 1
            self.main -= self.open[i] in MAIN and (dropped is None or i < dropped)
        del self.open[at:]
        if dropped is not None and at <= dropped:
            self.dropping = None
            self.links = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            self.lines.append((text, max(0, len(text) - self.linked), self.main > 0))
        self.buffer.clear()
        self.linked = 0


def page_lines(html: str, window: int = WINDOW) -> list[tuple[str, int, bool] | None]:
    """The lines of a page: text, its length outside links, and whether it is in an article; None for furniture.

    Furniture (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, readers' comments)
    goes by element, class, id and role, and articles in it go along, unless its end tag is missing, or only its name tells it and the page has no other article.
    At the borders of a page's text it is as long as a window, in the flow of the text it is one line.
    """
    closed = _Closed()
    closed.feed(html)
    closed.close()
    for revive in (False, True):
        parser = _Lines(closed.closed, window, revive)
        parser.feed(html)
        parser.close()
        if not parser.hidden or any(x is not None and x[2] for x in parser.lines):
            break
    return parser.lines


def main_text(html: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The page's main text, a line for each block.

    Lengths outside links are summed over ``window`` lines, furniture being empty; a line in an article counts ``surge`` more, and if a
    page has articles, what is outside them counts nothing. A stretch reaches from where the sum rises above zero to where it falls to zero, and is
    kept, with all of its lines, if its sum surges to ``surge``, or, where no window of the page does, if it holds the page's largest.
    """
    lines = page_lines(html, window)
    if any(x is not None and x[2] for x in lines):
        lines = [x if x is not None and x[2] else None for x in lines]
    return "\n".join(text for start, end in stretches(lines, window, surge) for text, _, _ in filter(None, lines[start:end]))


def stretches(lines: list[tuple[str, int, bool] | None], window: int, surge: int) -> list[tuple[int, int]]:
    """Surge and dive points of the stretches to keep, the latter exclusive."""
    weights = [0 if x is None else x[1] + surge * x[2] for x in lines]
    found: list[tuple[int, int, int]] = []
    start = end = now = peak = 0
    for i, n in enumerate(weights):
        now += n - (weights[i - window] if i >= window else 0)
        if n and i - end >= window and end:
            found.append((start, end, peak))
            end = peak = 0
        if n:
            start, end = (start, i + 1) if end else (i, i + 1)
        if end:
            peak = max(peak, now)
    if end:
        found.append((start, end, peak))
    enough = min(surge, max((p for _, _, p in found), default=0))
    return [(a, b) for a, b, p in found if p >= enough]


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """id, the columns of ``keep`` and text for each row of ``pages``; null and empty pages have empty text.

    Repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, *keep)}
    rows = pages.select(*(pages[c].alias(f"k{i}") for i, c in enumerate(kinds)), text_of(pages, html_col).alias("html"))
    schema = ", ".join(f"k{i} {k}" for i, k in enumerate(kinds.values())) + ", text string"

    def run(block: dict[str, list]) -> dict[str, list]:
        return {k: v for k, v in block.items() if k != "html"} | {"text": [main_text(h) for h in block["html"]]}

    out = map_blocks(rows, run, schema)
    return out.toDF(*("id" if c == id_col else c for c in kinds), "text")
