"""The main text of web pages, by comparing each page with its nearest neighbour by URL.

A page becomes text lines, one for each block. Pages are put in order of host,
path and key; the neighbour before or after on the same host whose path shares
the longer prefix (the earlier one on ties) is a page's mate. The two pages'
lines are aligned by their longest common subsequence and shared lines are
deleted, unless the page itself marks them as its article: sites repeat
sentences inside articles too, and a mirror shares all of them. Then lines in
elements that say they are menus, adverts, forms, comments and the like go, as
these often differ from page to page, and a page that marks an article keeps
only lines of it. Without any mark the alignment decides alone.

Only line hashes travel: a page's lines become 8-byte numbers, which are range
partitioned by (host, path, key), so that a host with a third of all pages is
spread over as many partitions as its share. Neighbours across partition ends
are found through one (first, last) pair per partition. Deleted positions come
back to the page by key, by broadcast when few; html is read again, not stored.

Defined cases: a null or empty html has an empty text. A null URL is a page of
the host and path "". A page alone on its host, or whose mate has the very same
lines, deletes nothing. Repeated rows each get the same text. Unclosed and
cut-off markup ends with the page; a head without end tag ends where the body's
content starts.
"""

import re
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from askbase.llm.common import map_columns, stored, table

#: Shared positions up to which they are sent to every task.
BROADCAST_LINES = 1_000_000

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
        "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog",
         "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
         "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup",
         "option", "p", "pre", "search", "section", "summary", "table", "tbody", "tfoot", "thead", "title",
         "tr", "ul"}
SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "audio", "video",
          "canvas", "head", "title"}
#: Elements that stand in a head; others, and text, end a head that was left open.
HEAD = {"base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
CHROME = {"nav", "aside", "form", "footer", "menu", "dialog", "button", "select", "textarea", "search"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog",
         "alert", "menu", "menubar", "toolbar"}
#: Words of a class or id that tell what an element is.
NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "banners",
         "sponsor", "sponsored", "sponsors", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice",
         "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup",
         "login", "register", "sidebar", "sidebars", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb",
         "breadcrumbs", "pagination", "pager", "footer", "footers", "comment", "comments", "disqus", "respond",
         "replies", "share", "sharing", "social", "related", "recommended", "widget", "widgets", "toolbar", "skip"}
#: Words that go with them in a name like sidebar-left; with any other word (no-sidebar, market-share) a name tells nothing.
BESIDE = {"area", "bar", "block", "body", "bottom", "box", "button", "buttons", "column", "container", "content", "fixed",
          "form", "global", "group", "holder", "icons", "inner", "item", "items", "left", "link", "links", "list", "main",
          "mobile", "outer", "page", "panel", "posts", "primary", "right", "secondary", "section", "site", "slot",
          "sticky", "text", "top", "unit", "wrap", "wrapper"}
OUTSIDE_NAMES = {"header", "masthead", "topbar"}
REMARKS = {"comment", "comments", "disqus", "respond", "replies", "ad", "ads", "advert", "sponsored", "promo"}


#: How sure it is that an element is not text: by its tag or role, or only by its name.
BY_TAG, BY_NAME = 2, 1


@lru_cache(1 << 14)
def _told(names: str, kind: str) -> bool:
    """Whether one of a class's or id's names is made of the kind's words and words that go with them."""
    words = KINDS[kind]
    for name in names.split():
        parts = {p for p in re.split(r"[^a-z0-9]+|(?<=[a-z])(?=\d)", name) if p and not p.isdigit()}
        if parts & words and parts <= words | BESIDE:
            return True
    return False


KINDS = {"chrome": NAMES, "outside": OUTSIDE_NAMES, "remark": REMARKS}


class _Lines(HTMLParser):
    """(text, rank, chrome) per block; rank 2: in an article, 1: in main, 0: neither; chrome 0: text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.open: list[tuple[str, int, int, bool]] = []  # tag, rank, chrome, silent
        self.words: list[str] = []

    def _at(self) -> tuple[str, int, int, bool]:
        return self.open[-1] if self.open else ("", 0, 0, False)

    def _end_line(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words.clear()
        if text:
            _, rank, chrome, _ = self._at()
            self.lines.append((text, rank, chrome))

    def _end_head(self, body: bool = False) -> None:
        """Close an open head; one with elements open in it only where the body starts."""
        if body and "template" not in (tags := [x[0] for x in self.open]) and "head" in tags:
            del self.open[tags.index("head"):]
        elif self._at()[0] == "head":
            self.open.pop()

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD:
            self._end_head(tag == "body")
        if tag == "br":
            self.words.append(" ")
        elif tag in ("td", "th"):
            self.words.append(" ")
        if tag in BLOCK:
            self._end_line()
            if tag in ("p", "li", "dt", "dd", "option", "tr"):
                self._close_implied(tag)
        if tag in VOID:
            return
        if tag in ("article", "main"):  # neither stands in these: their end tag is missing
            left_open = [i for i, x in enumerate(self.open) if x[0] in ("nav", "svg")]
            del self.open[left_open[0] if left_open else len(self.open):]
        _, rank, chrome, silent = self._at()
        given = {k: v or "" for k, v in attrs}
        role = given.get("role", "").lower()
        names = f"{given.get('class', '')} {given.get('id', '')}".lower()
        inside = rank > 0
        if tag == "article":
            rank, chrome = 2, max(chrome, BY_TAG * (inside and _told(names, "remark")))
        elif tag == "main" or role == "main":
            rank = max(rank, 1)
        elif "articlebody" in given.get("itemprop", "").lower():
            rank = 2
        elif tag not in ("body", "html"):
            if tag in CHROME or role in ROLES or not inside and tag == "header":
                chrome = BY_TAG
            elif _told(names, "chrome") or not inside and _told(names, "outside"):
                chrome = max(chrome, BY_NAME)
        hides = ("hidden" in given or given.get("aria-hidden", "").lower() == "true"
                 or re.search(r"display\s*:\s*none", given.get("style", ""), re.I) is not None)
        self.open.append((tag, rank, chrome, silent or tag in SILENT or hides))

    def _close_implied(self, tag: str) -> None:
        stop = {"p": BLOCK - {"p"}, "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"},
                "option": {"select", "optgroup"}, "tr": {"table"}}[tag]
        same = {"dt", "dd"} if tag in ("dt", "dd") else {tag}
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in same:
                del self.open[i:]
                return
            if self.open[i][0] in stop:
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self._end_line()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if data.strip():
            self._end_head()
        if not self._at()[3]:
            self.words.append(data)


def lines_of(html: str | None) -> list[tuple[str, int, int]]:
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser._end_line()
    return parser.lines


def main_lines(lines: list[tuple[str, int, int]], shared: set[int]) -> list[str]:
    """What stays of a page whose positions ``shared`` (outside articles) were deleted.

    Where names alone leave nothing, they stood on what holds the text, and do not count.
    """
    for most in (0, BY_NAME):
        left = [(t, r) for i, (t, r, chrome) in enumerate(lines) if chrome <= most and i not in shared]
        if left:
            break
    top = max((r for _, r in left), default=0)
    return [t for t, r in left if r == top]


def common_positions(a: list[int], b: list[int]) -> list[int]:
    """Positions of ``a`` on a longest common subsequence of ``a`` and ``b``.

    Bit-parallel over ``b``; rows too many to keep are halved and solved apart.
    """
    both = set(a) & set(b)
    at = [i for i, x in enumerate(a) if x in both]
    b = [x for x in b if x in both]
    return [at[i] for i in _common([a[i] for i in at], b)]


def _rows(a, b):
    """After each element of ``a`` the row's bits over ``b``: 0 where the length steps up."""
    places: dict[int, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        u = row & places.get(x, 0)
        row = ((row + u) | (row - u)) & full
        yield row


def _steps(row: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(row.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")[:n]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def _common(a: list[int], b: list[int], room: int = 1 << 28) -> list[int]:
    if not a or not b:
        return []
    if len(a) == 1:
        return [0] if a[0] in b else []
    if len(a) * len(b) > room:
        half = len(a) // 2
        *_, head = _rows(a[:half], b)
        *_, tail = _rows(a[half:][::-1], b[::-1])
        cut = int(np.argmax(_steps(head, len(b)) + _steps(tail, len(b))[::-1]))
        return _common(a[:half], b[:cut], room) + [half + i for i in _common(a[half:], b[cut:], room)]
    rows, out, j = list(_rows(a, b)), [], len(b)
    full = (1 << len(b)) - 1
    for i in range(len(a) - 1, -1, -1):
        above = rows[i - 1] if i else full
        mask = (1 << j) - 1
        if ((~rows[i]) & mask).bit_count() > ((~above) & mask).bit_count():
            out.append(i)  # a[i] lengthens the row: go to its last step up, left of which the rest lies
            j = ((~rows[i]) & mask).bit_length() - 1
    return out[::-1]


def _key(pages: DataFrame, id_col: str, url_col: str, html_col: str):
    cols = [F.col(f"`{c}`") for c in (id_col, url_col, html_col)]
    return F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)


def page_lines(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(k1, k2, host, path, hashes, outside): line hashes, and positions outside marked articles."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    k1, k2 = _key(pages, id_col, url_col, html_col)
    source = pages.select(
        k1.alias("k1"), k2.alias("k2"),
        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path"),
        F.col(html_col).alias("html"))

    def fn(columns):
        hashes, outside = [], []
        for html in columns[0].to_pylist():
            lines = lines_of(html)
            hashes.append(np.array([xxhash.xxh64_intdigest(t) for t, _, _ in lines], np.uint64).view(np.int64))
            outside.append([i for i, (_, rank, _) in enumerate(lines) if rank < 2])
        return [pa.array(hashes, pa.list_(pa.int64())), pa.array(outside, pa.list_(pa.int32()))]

    return map_columns(source, {"html": F.col("html")}, "hashes array<bigint>, outside array<int>", fn).drop("html")


def _shared_prefix(a: str, b: str):
    same = F.zip_with(F.split(F.col(a), ""), F.split(F.col(b), ""), lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    return F.when(F.col(b).isNull(), -1).when(first == 0, F.length(a)).otherwise(first - 1)


def shared_lines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """(s1, s2, shared): for each page with any, the deleted positions; stored."""
    lines = page_lines(pages, id_col, url_col, html_col).dropDuplicates(["k1", "k2"])
    order = ["host", "path", "k1", "k2"]
    placed = stored(lines.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("at", F.monotonically_increasing_id()), "page-order")
    part = F.shiftright("at", 33)
    ends = placed.groupBy(part.alias("part")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    line = Window.orderBy("part")  # one row for each partition of the order
    ends = ends.select("part", "first", "last", F.lag("last").over(line).alias("before"),
                       F.lead("first").over(line).alias("after"))
    here = placed.withColumn("part", part).join(F.broadcast(ends), "part").select(
        *order, "at", "hashes", "outside",
        F.when(F.col("at") == F.col("first"), F.col("before")).otherwise(F.col("at") - 1).alias("prev_at"),
        F.when(F.col("at") == F.col("last"), F.col("after")).otherwise(F.col("at") + 1).alias("next_at"))

    def side(name):
        return placed.select(F.col("at").alias(f"{name}_at"), F.col("host").alias(f"{name}_host"),
                             F.col("path").alias(f"{name}_path"), F.col("hashes").alias(f"{name}_hashes"))

    near = here.join(side("prev"), "prev_at", "left").join(side("next"), "next_at", "left")
    reach = {n: F.when(F.col(f"{n}_host") == F.col("host"), _shared_prefix("path", f"{n}_path")).otherwise(-1)
             for n in ("prev", "next")}
    mate = F.when(F.greatest(*reach.values()) < 0, F.lit(None)).when(
        reach["prev"] >= reach["next"], F.col("prev_hashes")).otherwise(F.col("next_hashes"))
    paired = near.select("k1", "k2", "hashes", "outside", mate.alias("mate")).where(
        F.col("mate").isNotNull() & (F.size("outside") > 0) & (F.col("mate") != F.col("hashes")))

    def align(batches):
        for batch in batches:
            k1, k2, found = [], [], []
            for row in batch.to_pylist():
                common = set(common_positions(row["hashes"], row["mate"])) & set(row["outside"])
                if common:
                    k1.append(row["k1"])
                    k2.append(row["k2"])
                    found.append(sorted(common))
            yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                                              pa.array(found, pa.list_(pa.int32()))], names=["s1", "s2", "shared"])

    return stored(paired.mapInArrow(align, "s1 bigint, s2 bigint, shared array<int>"), "page-shared")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """``pages`` with text, n_lines_deleted (shared ones); columns with these names are replaced."""
    shared = shared_lines(pages, id_col, url_col, html_col)
    size = shared.agg(F.count("*") + F.coalesce(F.sum(F.size("shared")), F.lit(0))).first()[0]
    k1, k2 = _key(pages, id_col, url_col, html_col)
    held = pages.select(F.struct("*").alias("row"), k1.alias("k1"), k2.alias("k2"), F.col(html_col).alias("html"))
    joined = held.join(F.broadcast(shared) if size <= BROADCAST_LINES else shared,
                       (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")), "left").select(
        "row", "html", "shared")

    def fn(columns):
        texts, gone = [], []
        for html, positions in zip(columns[0].to_pylist(), columns[1].to_pylist()):
            texts.append("\n".join(main_lines(lines_of(html), set(positions or ()))))
            gone.append(len(positions or ()))
        return [pa.array(texts, pa.string()), pa.array(gone, pa.int64())]

    out = map_columns(joined, {"html": F.col("html"), "shared": F.col("shared")},
                      "text string, n_lines_deleted bigint", fn)
    return out.select(*[F.col("row").getField(c).alias(c) for c in pages.columns
                        if c not in ("text", "n_lines_deleted")], "text", "n_lines_deleted")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"),
                                      "n_lines_deleted")
