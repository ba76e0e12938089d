"""Main text of web pages: nearest-URL page differencing under a structural guard.

Pages are range-sorted by (host, URL path), so the pages with the nearest URLs of a host lie next to each
other.  Each page's text lines, those of menus and footers too, are aligned with those of both neighbours by longest
common subsequence, and the lines that they share are deleted as the site's template.

Differencing alone can't give right results where a site's pages carry different menus and notices (nothing
is shared) or the same article (everything is), so a structural guard stands beside it: lines inside an
``article`` or ``main`` element stay though a neighbour shares them; of the lines that no neighbour shares, those in
elements that are menus, headers, footers, sidebars, notices, adverts, forms or comments go, and on a page with an
article or main element those outside it.  So differencing decides on pages without such an element only.  ``shared_lines`` counts the lines that it
deleted and the guard would have kept, ``guarded_lines`` those that the guard deletes.

Range bounds are on (host, path, page_id, digest), which splits a host that has a third of all pages.  The first and
last page of each range are sent to the ranges beside it as well, where they only serve as neighbours, so a page's
text depends neither on the bounds nor on the number of partitions.

Edge cases: elements marked hidden or aria-hidden are no text, since readers don't see them; null or empty html has an empty text; a null or odd URL has an empty host; repeated rows are
extracted one by one, and neighbours with the same lines as the page itself aren't used to delete
lines; an empty table gives no rows; markup that is never closed ends with the page.  Aligning takes memory in
proportion to the lines of a page, and time in proportion to the product of those that occur on both pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|textarea|title|iframe|object|select|svg|canvas)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)(?:>|\Z)"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)",  # the last: markup with an open quote
    re.S | re.I,
)
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("nav aside footer form button dialog menu head".split())
#: Whole class names, ids and roles of elements that are never main text: a word, perhaps with a place before and parts after it.
_NAMES = re.compile(
    r"(?:(?:site|page|main|top|bottom|left|right|global|primary|secondary|mobile)[-_])*"
    r"(?:ads?|advert(?:s|isement|isements|ising)?|banners?|sponsor(?:ed|s)?|promo(?:s|tion|tions)?|sidebars?|side-bar|widgets?|menus?|nav|navbar|navigation|breadcrumbs?|header|footer"
    r"|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|subscription|shar(?:e|ing)|social|related|comments?|disqus|replies|pagination|pager|masthead|topbar|toolbar)"
    r"(?:[-_](?:area|bar|banner|block|box|button|buttons|container|content|form|header|footer|icons?|inner|items?|left|right|top|bottom|links?|list|media|menu|message|notice|panel|popup|posts?|articles?|section|slot|text|thread|title|unit|wrap|wrapper|\d+))*",
    re.I,
)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?=[\s=/]|$)|\saria-hidden\s*=\s*["']?true|role\s*=\s*["']?(?:navigation|banner|contentinfo|complementary|search|alert|dialog)\b""", re.I)
#: A line's place: inside an article or main element, outside any, or in an element that is never main text.
ARTICLE, OTHER, NEVER = 1, 0, -1


def _never_text(tag: str, attributes: str, inside: bool) -> bool:
    if tag in _DROPPED or tag == "header" and not inside:
        return True
    if tag in ("html", "body", "main") or "=" not in attributes and "hidden" not in attributes:
        return False
    return bool(_HIDDEN.search(attributes)) or any(_NAMES.fullmatch(name) and not (inside and name.lower() == "header") for found in _ATTRIBUTE.findall(attributes) for name in "".join(found).split())


def lines_of(html: str) -> list[tuple[str, int]]:
    """The page's text blocks in page order, each with its place."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    skip, depth, inside, at = "", 0, 0, 0

    def flush() -> None:
        if parts:
            if line := " ".join(unescape("".join(parts)).split()):
                out.append((line, NEVER if skip else ARTICLE if inside else OTHER))
            parts.clear()

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        if not m[3]:
            continue
        tag, closes = m[3].lower(), bool(m[2])
        if tag == "br":
            parts.append(" ")
        if tag in _BLOCKS or skip and tag == skip:
            flush()
        if skip:
            opens = not closes and (tag in ("article", "main") and not inside and skip not in ("head", "form") and not _never_text(tag, m[4], False) or skip == "head" and tag == "body")
            if opens:  # the element that is never text was never closed
                skip = ""
                inside += tag != "body"
            elif tag == skip:
                depth += -1 if closes else 1
                if depth == 0:
                    skip = ""
        elif not closes and tag not in _VOID and not m[4].endswith("/") and _never_text(tag, m[4], inside > 0):
            flush()
            skip, depth = tag, 1
        elif tag in ("article", "main"):
            inside = max(0, inside + (-1 if closes else 1))
    if at < len(html):
        parts.append(html[at:])
    flush()
    return out


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The lengths of longest common subsequences of ``x`` with every beginning of ``y``; one row of the table at a time."""
    row = np.zeros(len(y) + 1, np.int32)
    for v in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == v, row[:-1] + 1, 0)))
    return row


def _matched(x: np.ndarray, y: np.ndarray, base: int, found: set[int]) -> None:
    """Add the places (from ``base``) in ``x`` of a longest common subsequence: x is halved, y cut where both halves' lengths add up best."""
    if not len(x) or not len(y):
        return
    if len(x) == 1:
        if (y == x[0]).any():
            found.add(base)
        return
    half = len(x) // 2
    cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
    _matched(x[:half], y[:cut], base, found)
    _matched(x[half:], y[cut:], base + half, found)


def shared_by_lcs(a: list[str], b: list[str]) -> set[int]:
    """Indices of the lines of ``a`` in a longest common subsequence with ``b``; equal ends are matched first."""
    low, high = 0, 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    found = {*range(low), *range(len(a) - high, len(a))}
    known = set(b[low : len(b) - high])
    x = [i for i in range(low, len(a) - high) if a[i] in known]
    number = {a[i]: k for k, i in enumerate(x)}
    places: set[int] = set()
    _matched(np.array([number[a[i]] for i in x], np.int64), np.array([number[t] for t in b[low : len(b) - high] if t in number], np.int64), 0, places)
    return found | {x[k] for k in places}


def main_text(page: list[tuple[str, int]], neighbours: list[list[tuple[str, int]]]) -> tuple[str, int, int]:
    """The text, the number of lines that differencing deleted and the guard would have kept, and of those that the guard deletes."""
    lines, places = [t for t, _ in page], [p for _, p in page]
    shared: set[int] = set()
    for other in neighbours:
        if other != page:
            shared |= shared_by_lcs(lines, [t for t, _ in other])
    wanted = ARTICLE if ARTICLE in places else OTHER
    gone = {i for i in shared if places[i] == wanted != ARTICLE}
    kept = [i for i, p in enumerate(places) if p == wanted and i not in gone]
    return "\n".join(lines[i] for i in kept), len(gone), len(lines) - len(gone) - len(kept)


def _borders(keys: DataFrame) -> tuple[Column, int]:
    """The first and last key of each range of pages in order, as an array, and the number of ranges."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = keys.repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("first"), F.max("key").alias("last"))
    found = ranges.orderBy("first").collect()  # a row for each partition
    key = lambda k: F.struct(*(F.lit(v).cast(t).alias(c) for v, t, c in zip(k, ("string", "string", "long", "long"), ("host", "path", "page_id", "mark"), strict=True)))
    pairs = [(r["first"], r["last"]) for r in found] or [(("", "", None, 0),) * 2]
    return F.array(*(F.struct(key(a).alias("first"), key(z).alias("last")) for a, z in pairs)), len(pairs)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, shared_lines, guarded_lines of every page."""
    url = F.col("url").cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keys = ["host", "path", "page_id", "mark"]
    marked = rows.withColumn("mark", F.xxhash64("url", "html"))
    borders, n = _borders(marked.select(F.struct(*keys).alias("key")))
    dealt = marked.withColumn("key", F.struct(*keys)).withColumn("part", F.size(F.filter(borders, lambda b: b["first"] <= F.col("key"))) - 1)
    copies = F.array(*(F.struct((F.col("part") + by).alias("part"), F.lit(by != 0).alias("ghost")) for by in (0, 1, -1)))
    at = F.get(borders, F.col("part"))
    wanted = lambda c: ~c["ghost"] | ((c["part"] > F.col("part")) & (F.col("key") == at["last"])) | ((c["part"] < F.col("part")) & (F.col("key") == at["first"]))
    inside = lambda c: (c["part"] >= 0) & (c["part"] < n)
    sent = dealt.withColumn("copy", F.explode(F.filter(copies, lambda c: inside(c) & wanted(c)))).select(*keys, "url", "html", F.col("copy.part").alias("part"), F.col("copy.ghost").alias("ghost"))
    ordered = sent.repartitionById(n, F.col("part")).sortWithinPartitions(*keys)

    def parsed(batches) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "host")), map(lines_of, (x.as_py() for x in b.column("html"))), b.column("ghost").to_pylist(), strict=True)

    def run(batches):
        out: list[tuple] = []
        before = None
        now = None

        def emit(after) -> int:
            if now[4]:
                return 0
            near = [x[3] for x in (before, after) if x is not None and x[2] == now[2]]
            text, shared, guarded = main_text(now[3], near)
            out.append((now[0], now[1], text, len(text), shared, guarded))
            return len(text)

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["page_id", "url", "text", "n_chars", "shared_lines", "guarded_lines"])
            out.clear()
            return made

        size = 0
        for page in parsed(batches):
            if now is not None:
                size += emit(page)
                if size > 8 << 20 or len(out) >= 5000:
                    yield batch()
                    size = 0
            before, now = now, page
        if now is not None:
            emit(None)
            yield batch()

    return ordered.mapInArrow(run, "page_id long, url string, text string, n_chars long, shared_lines long, guarded_lines long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
