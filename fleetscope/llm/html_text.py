"""Main text of web pages by nearest-URL page differencing.

A page is cut into text lines, one for each block. Markup decides what it can:
lines in menus, headers, footers, sidebars, forms, adverts, notices and comments
go, lines in an ``article`` or ``main`` element stay. What is left is open: pages
are paired with their nearest neighbour by URL path on the same host, their lines
are aligned by a longest common subsequence, and open lines that both pages have
are the site's, not the article's, and go as well.
"""

from __future__ import annotations

import html
import os
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetscope.session import materialize, scratch_path

# What HTML elements mean.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var", "wbr",
}
ASIDE = {
    "nav", "footer", "aside", "form", "noscript", "template", "button", "select", "dialog", "menu", "svg", "canvas",
    "object", "audio", "video", "head",
}
CONTAINER = {"article", "main"}
ASIDE_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar"}
#: Words in a class or id that mark an element as not the article.
ASIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "nav", "navbar",
    "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "comment", "comments", "disqus", "cookie",
    "cookies", "consent", "notice", "popup", "modal", "newsletter", "subscribe", "share", "sharing", "social", "related",
    "pagination", "pager", "login", "signup", "search", "masthead", "skip", "toolbar", "widget",
}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S
)
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
KEEP, OPEN, DROP = 0, 1, 2


def _is_aside(tag: str, attrs: str, inside: int) -> bool:
    if tag in ASIDE or (tag == "header" and not inside):
        return True
    if tag in ("body", "html") or "=" not in attrs:
        return False
    for name, *values in _MARKS.findall(attrs):
        value = "".join(values).lower()
        if name.lower() == "role":
            if value.strip() in ASIDE_ROLE:
                return True
        elif tag not in CONTAINER and any(word in ASIDE_WORDS for word in _WORD.findall(value)):
            return True
    return False


def page_lines(page: str) -> list[tuple[str, int]]:
    """(text, KEEP | OPEN | DROP) of every block of a page that has text, in page order.

    Character references are decoded, white space in a block becomes one space.
    An unclosed element ends with the element around it.
    """
    lines, parts = [], []
    stack: list[tuple[str, bool, bool]] = []  # element, is an aside, is a container
    asides = containers = at = 0

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                lines.append((text, DROP if asides else KEEP if containers else OPEN))

    while at < len(page):
        found = _TAG.search(page, at)
        if not found:
            parts.append(page[at:])
            break
        if found.start() > at:
            parts.append(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            close()
        elif tag == "br":
            parts.append(" ")
        if found[1]:
            if any(name == tag for name, _, _ in stack):
                while True:
                    name, aside, container = stack.pop()
                    if aside or container:
                        close()
                    asides -= aside
                    containers -= container
                    if name == tag:
                        break
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            at = end.start() if end else len(page)
            continue
        if tag in VOID or found[3].rstrip().endswith("/"):
            continue
        if tag == "body":  # what stood open in the head ends here
            while stack and stack[-1][0] != "html":
                _, aside, container = stack.pop()
                asides -= aside
                containers -= container
        aside, container = _is_aside(tag, found[3], containers), tag in CONTAINER
        if aside:
            close()
        if tag == "p":  # a paragraph ends where the next begins
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    del stack[depth:]
                    break
                if stack[depth][1] or stack[depth][2] or stack[depth][0] not in INLINE:
                    break
        stack.append((tag, aside, container))
        asides += aside
        containers += container
    close()
    return lines


def _row_of_lengths(a: list, b: list) -> list[int]:
    """Length of a longest common subsequence of ``a`` and each prefix of ``b``, by bit-parallel rows."""
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    lengths, n = [0], 0
    for bit in format(row, f"0{len(b)}b")[::-1] if b else "":
        n += bit == "0"
        lengths.append(n)
    return lengths


def common_places(a: list, b: list) -> list[int]:
    """Places of ``a`` that a longest common subsequence with ``b`` uses.

    Halves ``a`` and finds where ``b`` splits (Hirschberg), so memory is linear.
    """
    out: list[int] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append(a0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append(a1)
        if a0 >= a1 or b0 >= b1:
            continue
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                out.append(a0)
            continue
        half = (a0 + a1) // 2
        ahead = _row_of_lengths(a[a0:half], b[b0:b1])
        back = _row_of_lengths(a[half:a1][::-1], b[b0:b1][::-1])
        cut = b0 + max(range(b1 - b0 + 1), key=lambda j: ahead[j] + back[b1 - b0 - j])
        work += [(a0, half, b0, cut), (half, a1, cut, b1)]
    return sorted(out)


def _extract(pages: DataFrame, html_col: str) -> DataFrame:
    """(row, page_id, url, host, path, lines, open, marks): the lines that markup leaves, with hashes."""
    names = ["row", "page_id", "url", "host", "path", "lines", "open", "marks"]

    def extract(batches):
        for batch in batches:
            lines, opened, marks = [], [], []
            for page in batch.column(5):
                own = [(text, kind) for text, kind in page_lines(page.as_py() or "") if kind != DROP]
                lines.append([text for text, _ in own])
                opened.append([kind == OPEN for _, kind in own])
                marks.append([xxhash.xxh3_64_intdigest(text) - 2**63 for text, _ in own])
            added = [pa.array(lines, pa.list_(pa.string())), pa.array(opened, pa.list_(pa.bool_())), pa.array(marks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *added], names)

    kind = pages.schema["page_id"].dataType.simpleString()
    url = F.coalesce("url", F.lit(""))
    rest = F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"),
        "page_id",
        "url",
        F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0)).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1).alias("path"),
        F.col(html_col).cast("string").alias("html"),
    )
    schema = f"row bigint, page_id {kind}, url string, host string, path string, lines array<string>, open array<boolean>, marks array<bigint>"
    return rows.mapInArrow(extract, schema)


def neighbours(keys: DataFrame) -> DataFrame:
    """``keys`` with ``place``: its number in the order of host, path and row.

    The order is dealt by range and numbered per partition; only one count a
    partition meets in one task.
    """
    dealt = keys.repartitionByRange("host", "path", "row").sortWithinPartitions("host", "path", "row")
    dealt = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "url-order")
    part = F.shiftrightunsigned("_at", 33)
    counts = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    first = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_first"))
    place = F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return dealt.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn("place", place).drop("_part", "_at", "_first")


def _shared_open(batches):
    """For pages with their nearest neighbours: which lines are open and shared."""
    for batch in batches:
        variants, gone = [], []
        for r in batch.to_pylist():
            sides = [x for x in (r["before"], r["after"]) if x is not None and x["host"] == r["host"]]
            sides.sort(key=lambda x: -len(os.path.commonprefix([x["path"], r["path"]])))
            own = {i for i, is_open in enumerate(r["open"]) if is_open}
            shared = [own.intersection(common_places(r["marks"], other["marks"])) for other in sides]
            shared = [places for places in shared if places != own]  # a page with all open lines of this one is a copy
            if not shared:
                continue
            places = shared[0]
            if len(shared) > 1 and 2 * sum(r["sizes"][i] for i in places) > sum(r["sizes"][i] for i in own):
                places = places & shared[1]  # much of an article may be in a near copy, but not on the other side too
            if places:
                variants.append(r["variant"])
                gone.append([i in places for i in range(len(r["marks"]))])
        yield pa.RecordBatch.from_arrays([pa.array(variants, pa.binary()), pa.array(gone, pa.list_(pa.bool_()))], ["variant", "gone"])


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of ``pages`` (columns page_id, url and the html).

    Blocks are joined by a line feed; a null or empty page gives an empty text. A
    page whose host has no other page, or a null url with no other null url, keeps
    its open lines. Pages of a host with equal lines are copies: one stands for all, so
    neighbours differ and copies get the same text. A neighbour that leaves no open line
    is a copy too, and the one on the other side is taken. Where shared lines make more than
    half of a page's open text and both sides are no copies, lines have to be on both.
    Pages without text are nobody's neighbour. Other columns are not read.
    """
    path = scratch_path(pages.sparkSession, "page-lines")
    _extract(pages, html_col).write.option("compression", "zstd").parquet(path)
    joined = lambda name: F.array_join(F.col(name).cast("array<string>"), ",")
    digest = F.unhex(F.sha2(joined("marks"), 256))
    variant = F.unhex(F.sha2(F.concat_ws("\n", "host", joined("marks"), joined("open")), 256))
    lines = pages.sparkSession.read.parquet(path).withColumn("variant", variant)
    stored = lines.where(F.size("marks") > 0).withColumn("digest", digest)
    first = F.min(F.struct("path", "row")).alias("first")
    alone = stored.groupBy("host", "digest").agg(first, F.first("marks").alias("marks"))
    placed = neighbours(alone.select("first.row", "host", "first.path", "digest", "marks"))
    placed = materialize(placed, "url-places")
    sizes = F.transform("lines", lambda x: F.length(x)).alias("sizes")
    seeking = stored.where(F.exists("open", lambda x: x)).select("variant", "host", "digest", "marks", "open", sizes)
    same = [F.first(name).alias(name) for name in ("host", "digest", "marks", "open", "sizes")]
    seeking = seeking.groupBy("variant").agg(*same).join(placed.select("host", "digest", "path", "place"), ["host", "digest"])
    side = F.struct("host", "path", "marks")
    before = placed.select((F.col("place") + 1).alias("place"), side.alias("before"))
    after = placed.select((F.col("place") - 1).alias("place"), side.alias("after"))
    paired = seeking.join(before, "place", "left").join(after, "place", "left")
    paired = paired.select("variant", "host", "path", "marks", "open", "sizes", "before", "after")
    gone = materialize(paired.mapInArrow(_shared_open, "variant binary, gone array<boolean>"), "page-gone")
    kept = F.expr("transform(filter(arrays_zip(lines, gone), x -> NOT coalesce(x.gone, false)), x -> x.lines)")
    text = F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept), "\n")
    out = lines.join(gone, "variant", "left").select("page_id", "url", text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
