"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element.  A line's weight is its length times what its tags say: lines of
elements that never hold article text (menus, footers, sidebars, forms; by element, role, or a class or id made of such
words alone) weigh nothing, lines that are mostly links and lines outside the element that a page marks as its article weigh
a fraction, lines inside it a multiple.  Weights are summed over sliding windows of ``window`` lines, which end where the
page changes between its article, the rest and weightless lines.  Where the sums rise to the threshold is a surge, where they
fall back a dive; a stretch between them is kept, and grows over the lines beside it (headings, short paragraphs) up to
the next change, weightless line, line of links or, outside a marked article, short list item, so that thresholds choose
stretches but drop no line of an article.

Null and empty pages, and pages without text, give the empty string.  Unclosed elements, comments and scripts run to the end of what
encloses them; every step is linear in the page.  Rows are independent: repeated pages repeat, and extra columns
are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
#: A surge reaches this many characters a window, or this share of the page's largest sum where that is less.
SURGE, SURGE_SHARE = 80, 0.2
#: Weights of characters inside the marked article, outside it, and in lines of links.
INSIDE, OUTSIDE, LINKS = 40.0, 0.25, 0.1

#: Elements of lists: a short line of theirs ends a stretch that is not in a marked article.
LISTED = frozenset("li dt dd option td th".split())

#: A tag from its "<" on; quotes count behind an equals sign alone, as the standard has it.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

#: Elements whose content is no text: fixed values.
RAW = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in "script style noscript template textarea iframe svg canvas object select title".split()}
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold article text, and those that don't unless they are in the article itself.
BOILERPLATE = frozenset("nav aside footer form menu dialog button fieldset head search".split())
OUTER_BOILERPLATE = frozenset("header hgroup".split())
MAIN = frozenset("article main".split())
#: Words of class names and ids: a name is boilerplate when it has one of the first and all its others are of the second.
PLAIN = frozenset(
    "ad ads advert adverts advertisement advertisements adsense banner banners sponsor sponsors sponsored promo promos promotion promotions cookie cookies consent gdpr notice notices alert alerts popup popups modal modals newsletter newsletters subscribe subscription paywall"
    " menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars footer footers share sharing social related recommended comment comments commentlist disqus reply replies respond toolbar pager pagination widget widgets login signup skip complementary contentinfo search".split()
)
OUTER_PLAIN = frozenset("header masthead topbar hero".split())
SHELL = frozenset(
    "area bar block body bottom box btn button buttons card column container content form group heading holder icon icons inner item items left link links list main media mobile outer overlay page panel post posts primary right row secondary section site slot slots stories story text thread title top unit wrap wrapper".split()
)
_SPLIT = re.compile(r"[-_\d]+|(?<=[a-z])(?=[A-Z])")


def _plain_name(value: str, outer: bool) -> bool:
    """Whether a class attribute, id or role names boilerplate."""
    for name in value.split():
        words = [w.lower() for w in _SPLIT.split(name) if w]
        named = [w for w in words if w in PLAIN or (outer and w in OUTER_PLAIN)]
        if named and all(w in SHELL or w in PLAIN or (outer and w in OUTER_PLAIN) for w in words):
            return True
    return False


def _tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" or "", name, attributes) of every tag, comment and content without text; the latter have no name."""
    at, last = 0, page.rfind(">")
    while (lt := page.find("<", at)) >= 0:
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            yield lt, at, "", "", ""
        elif page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = len(page) if end < 0 else end + 1
            yield lt, at, "", "", ""
        else:
            m = _TAG.match(page, lt) if lt < last else None
            if m is None:
                # A quote that never closes: the tag ends at the first ">".
                m = _NAME.match(page, lt)
                end = page.find(">", lt) if m and lt < last else -1
                if end < 0:
                    at = lt + 1
                    if m and m[2].lower() in RAW and not m[1]:
                        at = len(page)
                        yield lt, at, "", "", ""
                    continue
                close, name, attrs = m[1], m[2].lower(), page[m.end() : end]
                at = end + 1
            else:
                close, name, attrs = m[1], m[2].lower(), m[3]
                at = m.end()
            if name in RAW and not close:
                m = RAW[name].search(page, at)
                end = page.find(">", m.start()) if m else -1
                at = len(page) if end < 0 else end + 1
                yield lt, at, "", "", ""
            else:
                yield lt, at, close, name, attrs


def lines(page: str) -> list[tuple[str, bool, bool, float, bool]]:
    """Filled block texts in page order: text, weightless, inside the marked article, share of it in links, in a list."""
    out: list[tuple[str, bool, bool, float, bool]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, int, int]] = []  # name, adds to plain, adds to main
    open_ = Counter()
    plain = main = 0
    at, block = 0, ""

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, plain > 0, main > 0, linked / max(1, sum(map(len, parts))), block in LISTED))
        parts.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        parts.append(piece)
        if open_["a"]:
            linked += len(piece)

    for start, end, close, name, attrs in _tags(page):
        if start > at:
            add(page[at:start])
        at = end
        if not name:
            continue
        if name in BLOCKS:
            if parts:
                flush()
            block = "" if close else name
        if close:
            if open_[name]:
                while True:
                    top, p, q = stack.pop()
                    open_[top] -= 1
                    plain -= p
                    main -= q
                    if top == name:
                        break
            continue
        if name in VOID:
            continue
        is_main = name in MAIN
        is_plain = name in BOILERPLATE or (name in OUTER_BOILERPLATE and not main)
        if "=" in attrs:
            for pair in _ATTR.finditer(attrs):
                value = pair[2] or pair[3] or pair[4] or ""
                is_main = is_main or (pair[1].lower() == "role" and value.lower() in MAIN)
                if name not in ("body", "html"):
                    is_plain = is_plain or _plain_name(value, not main)
        is_main = is_main and not is_plain and plain == 0
        stack.append((name, int(is_plain), int(is_main)))
        open_[name] += 1
        plain += is_plain
        main += is_main
    if at < len(page):
        add(page[at:])
    flush()
    return out


def extract(page: str | None, window: int = WINDOW) -> str:
    """Main text of one page: kept lines joined by newlines."""
    found = lines(page) if page else []
    if not found:
        return ""
    n = len(found)
    size = np.array([len(x[0]) for x in found], float)
    plain, inside, listed = (np.array([x[k] for x in found], bool) for k in (1, 2, 4))
    links = np.array([x[3] > 0.6 for x in found]) & ~inside
    weight = np.where(plain, 0.0, size) * np.where(inside, INSIDE, np.where(inside.any(), OUTSIDE, 1.0)) * np.where(links, LINKS, 1.0)
    # Zones: lines between changes of the article, of weight and of links.
    change = np.concatenate(([True], (inside[1:] != inside[:-1]) | (plain[1:] != plain[:-1]) | (links[1:] != links[:-1])))
    zone = np.cumsum(change)
    total = np.concatenate(([0.0], np.cumsum(weight)))
    ahead = np.minimum(np.arange(n) + window, np.searchsorted(zone, zone, "right"))
    sums = total[ahead] - total[:-1]
    high = max(1.0, min(SURGE, SURGE_SHARE * sums.max()))
    # Lines of some weight in a window over the threshold lie between surge and dive; those a window apart are one stretch.
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, np.flatnonzero(sums >= high), 1)
    np.add.at(cover, ahead[sums >= high], -1)
    surge = (np.cumsum(cover)[:-1] > 0) & (weight >= high / 8)
    at = np.flatnonzero(surge)
    last = np.concatenate(([-1], at))[np.searchsorted(at, np.arange(n), "right")]
    next_ = np.concatenate((at, [n]))[np.searchsorted(at, np.arange(n))]
    between = (last >= 0) & (next_ < n) & (next_ - last <= window) & (zone[last] == zone[np.minimum(next_, n - 1)]) & (zone[last] == zone)
    # A stretch grows to the ends of its zone or to a short list item.
    stop = listed & ~inside & ~surge & ~between & (size < SURGE)
    part = np.cumsum(change | stop | np.concatenate(([False], stop[:-1])))
    kept = np.isin(part, part[surge]) & ~plain
    return "\n".join(x[0] for x, k in zip(found, kept.tolist(), strict=True) if k)


def extract_pages(pages: DataFrame, window: int = WINDOW) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages(page_id, url, html)``; one map stage, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [extract(x.as_py(), window) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
