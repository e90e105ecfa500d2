"""HTML extraction by line-block distribution.

Markup is stripped into lines, one per block element; blocks without text make none.
A line weighs as many characters as its text outside links, or nothing if that is
less than half of it; inside an article or main element links count like other text.
Inside boilerplate a line weighs nothing. Lengths are summed over windows of
``WINDOW`` lines; the text between a surge, where a sum rises
over the threshold, and the dive, where sums fall to nothing, is the article. A
page may have several such regions; they are joined in page order.

Boilerplate is told by element (nav, footer, aside, form and the like), by role
and by words in class and id. Where a page names its article or main element, only
lines inside weigh, and any text there is a surge, so one short sentence counts as
much as a long page; elsewhere the threshold is ``SURGE`` characters, or a quarter
of the largest sum of a page of short lines.

Tags are matched first, so an element that is never closed is boilerplate only up
to the next block. Script, style and comments are passed over whole; ``>`` inside
quoted attributes ends no tag.

Edge cases: null or empty html, and pages of markup alone, give an empty text;
repeated rows give a row each, nulls in other columns are kept; an empty table
gives no rows; very long pages are handled whole. Only page_id, url and html are
read, so extra columns cannot clash.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 86

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?
    |<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^"'>]|["'](?=[^"']*>))*+)>?""",
                 re.S | re.X)
#: Elements whose content is not text.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea "
                "select option button title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt "
                  "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main "
                  "menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
BOILER = frozenset("nav footer aside form menu dialog head fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
HINTS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs "
                  "comment comments commentlist cookie cookies consent disqus footer gdpr masthead menu "
                  "menubar modal nav navbar navigation newsletter notice notices pagination popup promo "
                  "promoted recommended related replies respond share sharing sidebar signup social sponsor "
                  "sponsored subscribe toolbar widget widgets header copyright disclaimer".split())
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
CONTENT = ("article", "main")


def hinted(name: str, attrs: str, content: bool) -> bool:
    """Whether class, id or role call an element boilerplate. A header inside the
    article is the article's own."""
    if "=" not in attrs and "hidden" not in attrs:
        return False
    for key, value in ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "role":
            if value.lower() in ROLES:
                return True
        elif key == "hidden" or key == "aria-hidden":
            if key == "hidden" or value.lower() == "true":
                return True
        elif name not in ("html", "body", *CONTENT):
            words = {p.lower() for p in PART.findall(value)} & HINTS
            if words and not (content and words == {"header"}):
                return True
    return False


def tokens(page: str) -> list[tuple[str, int, int, str, str]]:
    """(kind, start, end, name, attributes) of every tag; content of raw elements
    lies inside one token. Kinds: open, close, skip."""
    out, at = [], 0
    while True:
        m = TAG.search(page, at)
        if m is None:
            return out
        at = max(m.end(), m.start() + 1)
        name = (m["name"] or "").lower()
        if not name:
            out.append(("skip", m.start(), at, "", ""))
        elif m["close"]:
            out.append(("close", m.start(), at, name, ""))
        elif name in RAW and not m["attrs"].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            if end is None and name not in ("script", "style"):
                out.append(("open", m.start(), at, name, m["attrs"]))
                continue
            at = end.end() if end else len(page)
            out.append(("skip", m.start(), at, name, ""))
        else:
            out.append(("open", m.start(), at, name, m["attrs"]))


def matches(tags: list[tuple[str, int, int, str, str]]) -> dict[int, int]:
    """Index of the closing tag of each opening one that has its own."""
    stack: dict[str, list[int]] = {}
    out = {}
    for i, (kind, _, _, name, _) in enumerate(tags):
        if kind == "open" and name not in VOID:
            stack.setdefault(name, []).append(i)
        elif kind == "close" and stack.get(name):
            out[stack[name].pop()] = i
    return out


def lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, weight, inside article or main) of every line of the page that has text."""
    tags = tokens(page)
    closed = matches(tags)
    out: list[tuple[str, int, bool]] = []
    text: list[str] = []
    linked = boiler = content = 0        # characters in links; open boilerplate and content elements
    link = one_line = False
    ends: dict[int, tuple[int, int]] = {}

    def flush() -> None:
        nonlocal linked
        line = " ".join(html.unescape("".join(text)).split())
        free = len(line) if content else 0 if 2 * linked > len(line) else len(line) - linked
        if line:
            out.append((line, 0 if boiler or one_line else max(0, free), content > 0))
        text.clear()
        linked = 0

    at = 0
    for i, (kind, start, end, name, attrs) in enumerate(tags):
        if start > at:
            piece = page[at:start]
            text.append(piece)
            if link:
                linked += len(" ".join(html.unescape(piece).split()))
        at = end
        if kind == "skip":
            if name in BLOCK:
                flush()
            continue
        if name in BLOCK:
            flush()
            one_line = False
        if name == "a":
            link = kind == "open" and i in closed
        if kind == "open" and name not in VOID:
            bad = (name in BOILER or name == "header" and not content or hinted(name, attrs, content > 0)
                   or name in RAW)
            inside = name in CONTENT
            if i in closed:
                if bad or inside:
                    if name not in BLOCK:
                        flush()
                    boiler += bad
                    content += inside
                    ends[closed[i]] = (int(bad), int(inside))
            elif inside:
                content += 1
            elif bad:
                if name not in BLOCK:
                    flush()
                one_line = True
        elif kind == "close" and i in ends:
            if name not in BLOCK:
                flush()
            boiler -= ends[i][0]
            content -= ends[i][1]
    text.append(page[at:])
    flush()
    return out


def regions(weights: list[int], surge: int) -> Iterator[tuple[int, int]]:
    """Half-open ranges of lines between a surge and its dive. A window of lines that
    reaches ``surge`` opens a region, which starts at the first weighty line of that
    window; the region ends at its last weighty line before a window of nothing."""
    n = len(weights)
    sums = [sum(weights[i:i + WINDOW]) for i in range(n)]
    i = 0
    while i < n:
        if sums[i] < surge:
            i += 1
            continue
        start = i
        while sums[i] and i < n - 1:
            i += 1
        i += 1
        yield start, i


def main_text(page: str | None) -> str:
    """The article of a page."""
    rows = lines(page or "")
    named = any(w and c for _, w, c in rows)
    weights = [w if c or not named else 0 for _, w, c in rows]
    most = max((sum(weights[i:i + WINDOW]) for i in range(len(weights))), default=0)
    surge = 1 if named else max(1, min(SURGE, most // 4))
    return " ".join(rows[k][0] for a, b in regions(weights, surge) for k in range(a, b) if weights[k])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h.as_py()) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id").cast(pa.int64()), b.column("url"), pa.array(text, pa.string()),
                 pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])
    return pages.select("page_id", "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
