"""Main text of web pages by nearest-URL page differencing.

Within a host, pages are ordered by URL path; a page's partners are the `NEAREST` pages on either side of it in that
order. The text lines of page and partner are aligned by longest common subsequence, and the lines they share are
deleted: what a site's template repeats goes, what a page says itself stays. Pages of a host with the same lines are one
in that order, so copies are compared with the next page that differs from them.

Differencing decides about every line; markup settles two cases that it cannot see. Lines in an article or main element
stay although another page has them too (two articles may share a sentence), and lines in navigation, headers, footers,
asides, forms or elements named as adverts, notices or comments go although no partner has them (a menu or an advert
may differ from page to page). A form around an article or a headline is the page's frame and deletes nothing. `extract` counts what either did.

Only hashes of lines are ordered and compared; the pages themselves do not move, unless so many of them have
deleted lines that the planner must join the two by a shuffle.

Defined cases: a null page counts as empty and has the empty text; pages without a host are compared with each other;
the only page of a host with its lines is compared with nothing; a page that would lose every line by differencing, in
no article, keeps those that markup does not delete; repeated rows get equal results; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import join_dealt, map_arrow, materialise, or_empty

# Elements and names that HTML and common page templates give to what is not the article.
CHROME_TAGS = frozenset("nav header footer aside form menu dialog button select iframe noscript template svg object canvas".split())
RAW_TAGS = frozenset("script style textarea title".split())
MAIN_TAGS = frozenset("article main".split())
HEADING_TAGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE_TAGS = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus "
    "footer header masthead menu modal nav navbar navigation newsletter notice notices notification popup promo promoted related "
    "respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget alert login search".split()
)
#: Of those, the names that a paragraph, a table or a quotation of an article does not get for what it says.
ADVERT_NAMES = frozenset("ad ads advert adverts advertisement advertising cookie cookies disqus newsletter promo promoted sponsored subscribe".split())
TEXT_TAGS = frozenset("p blockquote pre ul ol li dl dt dd table tr td th figure figcaption".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_FRAMED = re.compile(r"<(?:article|main|h1)\b|(</form\b)", re.I)
_ANY_NAME = "|".join(sorted(CHROME_NAMES))
# these speak of a layout, as in `has-sidebar` and `comments-open`, not of the element itself
_LAYOUT = "has|no|with|is|open|closed|enabled|disabled|none|on|off"
_ENDS = re.compile(rf"(?!(?:{_LAYOUT})[-_]).+[-_](?:{_ANY_NAME})$")
_BEGINS = re.compile(rf"(?!.*[-_](?:{_LAYOUT})$)(?:{_ANY_NAME})[-_].+")
# in an article a name that begins so may be about its subject (`related-work`), unless it goes on with a thing of a template
_FURNITURE = re.compile(
    rf"(?:{_ANY_NAME})[-_](?:area|articles|bar|block|box|buttons|container|content|form|inner|items|links|list|news|outer|posts|section|slot|stories|unit|widget|wrap|wrapper)$"
)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW_TAGS}

ARTICLE, OTHER, CHROME = "a", "o", "c"
#: Partners on either side.
NEAREST = 2


def _attributes(raw: str) -> dict[str, str]:
    """The attributes of a tag by their lower-cased names; of two with one name the first counts."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), html.unescape("".join(values)))
    return found


def _named_chrome(tag: str, raw: str, in_article: bool) -> bool:
    """Whether an element's class, id or role, or that it is hidden, says that it is no part of an article.

    Inside an article names say less, as they may speak of its subject: an id counts if it is such a name or ends with
    one, a class also if it is put together of a name and a thing of a template, and elements that hold text only by names of adverts.
    """
    if not raw or tag in ("html", "body") or tag in HEADING_TAGS:
        return False
    attributes = _attributes(raw)
    for kind in ("class", "id"):
        for name in attributes.get(kind, "").lower().split():
            if not in_article:
                chrome = name in CHROME_NAMES or _ENDS.match(name) or _BEGINS.match(name)
            elif tag in TEXT_TAGS:
                chrome = name in ADVERT_NAMES
            else:
                chrome = name in CHROME_NAMES or _ENDS.match(name) or (kind == "class" and _FURNITURE.match(name))
                chrome = chrome and not name.endswith("header")  # it holds the headline
            if chrome:
                return True
    roles = attributes.get("role", "").lower().split()
    hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(attributes.get("style", ""))
    return bool(roles and roles[0] in CHROME_ROLES) or bool(hidden)


def _frames(page: str) -> Callable[[int], bool]:
    """Tells of the place of a form's start tag whether an article, a main element or a headline stands in it.

    Such a form is the frame of its page, as some web servers write it, not something to fill in.
    """
    marks = [(m.start(), m[1] is None) for m in _FRAMED.finditer(page)] if "<form" in page.lower() else []
    places = [at for at, _ in marks]

    def is_frame(at: int) -> bool:
        k = bisect_right(places, at)
        return k < len(marks) and marks[k][1]

    return is_frame


def text_lines(page: str) -> tuple[list[str], str]:
    """The text of each block of the page in order, and for each block a letter that says where it stands."""
    lines: list[str] = []
    zones: list[str] = []
    parts: list[str] = []
    stack: list[tuple[str, str]] = []  # open elements that are not inline, each with the zone inside it
    zone = OTHER
    found_article = False
    is_frame = _frames(page)

    def close_block() -> None:
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                lines.append(text)
                zones.append(zone)
            parts.clear()

    at = 0
    while token := _TOKEN.search(page, at):
        if token.start() > at:
            parts.append(page[at : token.start()])
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if token[1]:
            if tag in INLINE_TAGS:
                if zone == CHROME and any(t == tag for t, _ in stack):
                    pass
                else:
                    continue
            close_block()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    zone = stack[-1][1] if stack else OTHER
                    break
            continue
        if tag in RAW_TAGS:
            close_block()
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        named = _named_chrome(tag, token[3], zone == ARTICLE)
        # a header inside an article holds its headline
        chrome = named or (tag in CHROME_TAGS and not (tag == "header" and zone == ARTICLE) and not (tag == "form" and zone == OTHER and is_frame(token.start())))
        if tag in INLINE_TAGS and not chrome:
            if stack and stack[-1][0] == tag and tag not in VOID_TAGS:
                stack.append((tag, zone))  # so that its end tag does not end the one around it
            continue
        close_block()
        if tag in VOID_TAGS or token[3].endswith("/"):
            continue
        if tag in ("p", "li", "td", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
            stack.pop()  # its end tag may be left out
            zone = stack[-1][1] if stack else OTHER
        if chrome:
            zone = CHROME
        elif tag in MAIN_TAGS and (zone != CHROME or not (found_article or any(t in CHROME_TAGS and z == CHROME for t, z in stack))):
            # the first article stays one inside an element that only a name gives away: the name is the layout's
            zone, found_article = ARTICLE, True
        stack.append((tag, zone))
    parts.append(page[at:])
    close_block()
    return lines, "".join(zones)


def _match_rows(a: list[int], b: list[int]) -> list[int]:
    """Bit-parallel longest common subsequence: after each element of `a`, the places of `b` that do not extend it."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    rows = []
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def _lengths(row: int, n: int) -> np.ndarray:
    """From a row: the length of the common subsequence with each prefix of `b`."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes((n + 7) // 8 or 1, "little"), np.uint8), bitorder="little")[:n]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in `a` of one longest common subsequence with `b`, ascending. Memory is linear for long lists."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    inner_a, inner_b = a[head : len(a) - tail], b[head : len(b) - tail]
    ends = list(range(head)), list(range(len(a) - tail, len(a)))
    if not inner_a or not inner_b:
        return ends[0] + ends[1]
    if len(inner_a) > 1 and len(inner_a) * len(inner_b) > 1 << 28:
        # halve `a`, and cut `b` where both halves together reach most
        mid = len(inner_a) // 2
        before = _lengths(_match_rows(inner_a[:mid], inner_b)[-1], len(inner_b))
        after = _lengths(_match_rows(inner_a[mid:][::-1], inner_b[::-1])[-1], len(inner_b))[::-1]
        cut = int(np.argmax(before + after))
        inner = shared_lines(inner_a[:mid], inner_b[:cut]) + [mid + i for i in shared_lines(inner_a[mid:], inner_b[cut:])]
    else:
        rows = _match_rows(inner_a, inner_b)
        inner, j = [], len(inner_b)
        for i in range(len(inner_a) - 1, -1, -1):
            # walk back: the row's highest place below j that extends; it is new if the row before lacks it
            here = ~rows[i] & ((1 << j) - 1)
            if not here:
                break
            prior = ~rows[i - 1] & ((1 << j) - 1) if i else 0
            if here.bit_count() > prior.bit_count():
                inner.append(i)
                j = next_place(here, inner_b, inner_a[i])
        inner.reverse()
    return ends[0] + [head + i for i in inner] + ends[1]


def next_place(extending: int, b: list[int], x: int) -> int:
    """The highest place of `x` in `b` at or below the last extending place."""
    j = extending.bit_length() - 1
    while b[j] != x:
        j -= 1
    return j


def _line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def with_neighbours(df: DataFrame, order: list[str], value: str, nearest: int) -> DataFrame:
    """`df` with the column `near`: the struct column `value` of the `nearest` rows on either side in `order`.

    A range sort deals the rows out evenly whatever their keys; only the rows at the ends of each range are looked up
    across ranges, in a table of 2 x `nearest` rows for each range.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(
        df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    )
    inside, back = Window.partitionBy("part").orderBy("place"), Window.partitionBy("part").orderBy(F.desc("place"))
    steps = [f(value, k) for f in (F.lag, F.lead) for k in range(1, nearest + 1)]
    ends = placed.select("part", "place", value, F.row_number().over(inside).alias("from_first"), F.row_number().over(back).alias("from_last"))
    ends = ends.filter(F.least("from_first", "from_last") <= nearest)
    across = Window.orderBy("place")  # places grow with the ranges
    ends = ends.select("part", "place", *[x.over(across).alias(f"__across{k}") for k, x in enumerate(steps)])
    found = placed.withColumns({f"__inside{k}": x.over(inside) for k, x in enumerate(steps)}).join(ends, ["part", "place"], "left")
    near = F.array_compact(F.array(*[F.coalesce(f"__inside{k}", f"__across{k}") for k in range(len(steps))]))
    return found.select(*df.columns, near.alias("near"))


def _host(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def _digest(name: str) -> Column:
    """The first 16 bytes of the SHA-256 of a text column; null counts as empty."""
    return F.unhex(F.substring(F.sha2(or_empty(name), 256), 1, 32))


def read_lines(pages: DataFrame) -> DataFrame:
    """`sha, host, path, list, lines` of each distinct page of a host: its lines' hashes, and their digest."""

    def read(batches: Iterator[list]) -> Iterator[dict[str, list]]:
        for shas, hosts, paths, pages_ in batches:
            lines = [np.array([_line_hash(x) for x in text_lines(p)[0]], "<i8").tobytes() for p in pages_]
            yield {"sha": shas, "host": hosts, "path": paths, "list": [hashlib.sha256(x).digest()[:16] for x in lines], "lines": lines}

    path = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    named = pages.select(_digest("html").alias("sha"), _host("url").alias("host"), path.alias("path"), or_empty("html").alias("html"))
    return map_arrow(named, ["sha", "host", "path", "html"], read, "sha binary, host string, path string, list binary, lines binary")


def shared_by_lists(lists: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """`host, list, shared`: for each list of lines of a host the numbers of those that partners share, little-endian 32 bits."""
    near = with_neighbours(lists.withColumn("value", F.struct("host", "lines")), ["host", "path", "list"], "value", nearest)

    def compare(batches: Iterator[list]) -> Iterator[dict[str, list]]:
        for hosts, lists_, lines, partners in batches:
            shared = []
            for host, own, others in zip(hosts, lines, partners, strict=True):
                mine = np.frombuffer(own, "<i8").tolist()
                found: set[int] = set()
                for other in others:
                    if other["host"] == host:
                        found.update(shared_lines(mine, np.frombuffer(other["lines"], "<i8").tolist()))
                shared.append(np.array(sorted(found), "<u4").tobytes())
            yield {"host": hosts, "list": lists_, "shared": shared}

    found = map_arrow(near, ["host", "list", "lines", "near"], compare, "host string, list binary, shared binary")
    return found.filter(F.length("shared") > 0)


def template_lines(pages: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """`sha, host, n, shared` of the pages (by their digest) that share lines with partners, and how many rows each is."""
    read = materialise(read_lines(pages))
    lists = read.groupBy("host", "list").agg(F.min("path").alias("path"), F.first("lines").alias("lines"))
    shared = materialise(shared_by_lists(lists, nearest))
    pages_ = read.groupBy("sha", "host", "list").agg(F.count("*").alias("n"))
    return materialise(pages_.join(shared, ["host", "list"]).select("sha", "host", "n", "shared"))


def kept_lines(lines: list[str], zones: str, shared: set[int]) -> tuple[str, int, int, int]:
    """The text of a page, some of whose lines partners share, and the numbers of lines that went by differencing, went by
    markup alone, and were kept by markup against differencing. `lines` are those that `zones` does not call chrome."""
    if len(shared) == len(zones) and ARTICLE not in zones:
        shared = set()
    places = [i for i, z in enumerate(zones) if z != CHROME]
    text = "\n\n".join(x for i, x in zip(places, lines, strict=True) if zones[i] == ARTICLE or i not in shared)
    kept = sum(zones[i] == ARTICLE for i in shared)
    return text, len(shared) - kept, sum(z == CHROME and i not in shared for i, z in enumerate(zones)), kept


def extract(pages: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """One row per row of `pages`: `page_id, url, text, n_chars, n_shared, n_marked, n_restored` (see `kept_lines`).

    What meets the shared lines in a join is the pages' text, not their markup.
    """
    shared = template_lines(pages, nearest)
    named = pages.select("page_id", "url", or_empty("html").alias("html"), _digest("html").alias("sha"), _host("url").alias("host"))

    def read(batches: Iterator[list]) -> Iterator[dict[str, list]]:
        for *kept, pages_ in batches:
            found = [text_lines(p) for p in pages_]
            texts = ["\n".join(x for x, z in zip(lines, zones, strict=True) if z != CHROME) for lines, zones in found]
            yield dict(zip(("page_id", "url", "sha", "host"), kept, strict=True)) | {"lines": texts, "zones": [z for _, z in found]}

    parsed = map_arrow(named, ["page_id", "url", "sha", "host", "html"], read, "page_id long, url string, sha binary, host string, lines string, zones string")
    joined = join_dealt(parsed, shared, ["sha", "host"], "n", "left")

    def keep(batches: Iterator[list]) -> Iterator[dict[str, list]]:
        for page_ids, urls, texts, zones, gone in batches:
            # a line holds no line break
            found = [kept_lines(t.split("\n") if t else [], z, set(np.frombuffer(g or b"", "<u4").tolist())) for t, z, g in zip(texts, zones, gone, strict=True)]
            counts = {c: [f[k] for f in found] for k, c in enumerate(("n_shared", "n_marked", "n_restored"), 1)}
            yield {"page_id": page_ids, "url": urls, "text": [f[0] for f in found], "n_chars": [len(f[0]) for f in found], **counts}

    return map_arrow(joined, ["page_id", "url", "lines", "zones", "shared"], keep, "page_id long, url string, text string, n_chars long, n_shared long, n_marked long, n_restored long")
