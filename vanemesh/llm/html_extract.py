"""Main text of web pages by inferred wrappers.

The pages of a host come from few templates. Each page is read into a stream of tags and texts; its shape is the tree of its
elements, in which adjacent repeats are folded into one repeated item. A host's distinct shapes are aligned pair by pair, in
a reduction tree of small buckets: items that match are merged, items that do not become optional, and an optional item beside its
like makes a repeated one. The result is the host's wrapper, a union-free regular expression with a text slot wherever texts stand.

The slots of the wrapper are judged by where they stand: never inside boilerplate (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments: by element, role, class or id; a word among others that may be a subject counts if most pages of the
host, and two at least, have that name), and inside the best region that the host's wrapper has: article, main, an element
named like content, or else the body. Forms and words that stand around a region do not count if the page
has no other region and more text in this one than outside. Inside a header only headings count, and only within the article. Texts
that stand at the same place on most pages of the host (three at least) are template and go; for hosts without a region, so do
blocks that are mostly links. All stay if nothing else would be left, or less than half of a region's text.

A page's text: its main slots, in page order, a block per line; character references are decoded, white space inside a block is
one space. Null html is empty, and so is the text of a page without any. A null or odd url belongs to the host "". Pages that repeat are
extracted each; ill-formed markup is read as browsers would: open paragraphs end at the next block, stray end tags are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Set
from functools import lru_cache
from html import unescape
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import keep, settle

# Shapes that are aligned in one task at a time; bytes of wrappers that may be broadcast.
BUCKET = 32
BROADCAST_BYTES = 16 << 20
# Elements nested deeper belong to the place of this depth.
DEEPEST = 100
SAME_PAGES = 3

# Names of elements, and words that mark elements by class, id or role.
SKIPPED = {"script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "textarea", "select", "title", "math", "audio", "video"}
# Of these the first hold plain characters up to their end tag, except within the second.
RAW = ("script", "style", "noscript", "iframe", "textarea", "title")
FOREIGN = {"svg", "math"}
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.IGNORECASE) for name in RAW}
BOILERPLATE = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "link", "map", "mark", "meter", "nobr", "output", "progress", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike",
    "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "input", "embed", "source", "track", "param", "area", "meta", "base",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BOILERPLATE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary",
    "consent", "contentinfo", "cookie", "cookies", "dialog", "disqus", "footer", "gdpr", "login", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination", "paywall", "popup", "promo", "promotion", "related",
    "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar",
    "widget", "alert",
}
HEADER_WORDS = {"header", "masthead"}
CONTENT_WORDS = {"article", "content", "entry", "post", "story", "main"}
# What the element holds, not what it is: in the same name as a word, or (the last two) as a name of its own beside it.
LAYOUT_WORDS = {"has", "with", "no", "layout", "wrapper", "container"}
FRAMES = {"wrapper", "container"}
# Beside a word in one name these say no more than where or how; any other word may be a subject ("social-impact").
PLAIN_WORDS = {"site", "page", "post", "posts", "entry", "content", "main", "primary", "secondary", "top", "bottom", "left", "right", "inner", "outer", "list", "item",
               "items", "link", "links", "box", "bar", "area", "block", "section", "button", "buttons", "form", "title", "text", "message", "wrapper", "container"}
# Marks of these elements hold over whatever stands inside; a form or a word may be around a whole page.
HARD = BOILERPLATE - {"form", "fieldset"}
# Opening one of the first inside an open one of the second ends that one.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
        "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
FENCES = {"ul", "ol", "dl", "table", "select"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|([^<]++|<)", re.DOTALL)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


@lru_cache(maxsize=1 << 14)
def label(name: str, attributes: str) -> str:
    """The element in the wrapper: its name, and - for boilerplate, ^ for a header, + for content.

    A name that holds a word of boilerplate beside other words (class="social-impact") is put in between, with ? at the end: it
    is boilerplate if the host has it on several pages. Ids of headings and inline elements are anchors and tell nothing.
    """
    if name in ("html", "body"):
        return name
    given = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)] if "=" in attributes else []
    anchor = name in HEADINGS or name in INLINE
    tokens = [(t, {w.lower() for w in WORDS.findall(t)}) for kind, value in given if not (anchor and kind == "id") for t in value.split()]
    words = set().union(*(w for _, w in tokens))
    content = bool(words & CONTENT_WORDS)
    odd = [(t, w) for t, w in tokens if w & BOILERPLATE_WORDS and not w & (LAYOUT_WORDS - FRAMES)]
    if content and words & LAYOUT_WORDS or any(len(w) == 1 and w <= FRAMES for _, w in tokens):
        odd = []
    sure = any(all(x in BOILERPLATE_WORDS or x in PLAIN_WORDS or x.isdigit() for x in w) for _, w in odd)
    if name in BOILERPLATE or sure or re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes):
        return name + "-"
    if name == "header" or words & HEADER_WORDS:
        return name + "^"
    if odd:
        return f"{name}{'+' if content else ''} {min(t for t, _ in odd)}?"
    return name + "+" if content else name


OPEN, END, TEXT = "open", "end", "text"
Place = tuple[str, ...]


def read(html: str) -> Iterator[tuple[str, str, Place, bool]]:
    """What a page holds, in order: (kind, text, place, linked).

    A place is the labels of the block elements around, and of other elements that are boilerplate. OPEN tells of a new
    element at its place, END of any other bound of a block; TEXT has a decoded text and whether it stands in a link.
    """
    names: list[str] = []
    is_block: list[bool] = []
    marked: list[bool] = []  # whether the element is in the place
    place: list[str] = []
    skip = ""

    def pop_to(i: int) -> None:
        while len(names) > i:
            names.pop()
            is_block.pop()
            if marked.pop():
                place.pop()

    found = TOKEN.finditer(html)
    while m := next(found, None):
        text = m[7]
        if text is not None:
            if not skip:
                yield TEXT, unescape(text) if "&" in text else text, tuple(place[:DEEPEST]), "a" in names
            continue
        name = (m[2] or m[5] or "").lower()
        closing = (m[1] or m[4]) == "/"
        if name in RAW_END and not closing and skip not in FOREIGN:
            end = RAW_END[name].search(html, m.end())
            found = TOKEN.finditer(html, end.end() if end else len(html))
            continue
        if not name or skip:
            skip = "" if closing and name == skip else skip
            continue
        block = name not in INLINE
        if closing:
            for i in range(len(names) - 1, -1, -1):
                if names[i] == name:
                    pop_to(i)
                    break
                if is_block[i] and not block:
                    break  # an inline end tag ends nothing beyond its block
            if block:
                yield END, "", tuple(place[:DEEPEST]), False
            continue
        attributes = m[3] or m[6] or ""
        if name in SKIPPED:
            skip = "" if attributes.endswith("/") and name in FOREIGN else name
            continue
        if name == "br":
            yield TEXT, " ", tuple(place[:DEEPEST]), False
        if block:
            for i in range(len(names) - 1, -1, -1):
                if names[i] == "p":
                    pop_to(i)
                if i >= len(names) or is_block[i]:
                    break
            for i in range(len(names) - 1, -1, -1) if name in ENDS else ():
                if names[i] in FENCES:
                    break
                if names[i] in ENDS[name]:
                    pop_to(i)
        if name in VOID:
            if block:
                yield END, "", tuple(place[:DEEPEST]), False
            continue
        mark = label(name, attributes)
        names.append(name)
        is_block.append(block)
        marked.append(block or mark[-1] in "-?")
        if marked[-1]:
            place.append(mark)
        if block:
            yield OPEN, "", tuple(place[:DEEPEST]), False


# An item of a wrapper: [how often, label, items]; how often: 1, ? (optional), + (repeated), * (both). A text slot is "#"; a group
# of several items that repeat together has the label "".


def shape(html: str) -> list:
    """The folded tree of a page's elements."""
    root: list = ["1", "", []]
    path: list[tuple[str, list]] = []
    for kind, text, place, _ in read(html):
        common = 0
        while common < min(len(path), len(place)) and path[common][0] == place[common]:
            common += 1
        if kind == OPEN and len(place) < DEEPEST:
            common = min(common, len(place) - 1)
        del path[common:]
        for mark in place[common:]:
            item: list = ["1", mark, []]
            (path[-1][1] if path else root)[2].append(item)
            path.append((mark, item))
        if kind == TEXT and not text.isspace():
            items = (path[-1][1] if path else root)[2]
            if not items or items[-1][1] != "#":
                items.append(["1", "#", []])
    return fold(root[2])


def often(a: str, b: str) -> str:
    return "1?+*"[(a in "?*" or b in "?*") + 2 * (a in "+*" or b in "+*")]


def alike(a: list, b: list) -> bool:
    return a[1] == b[1] and (a[1] != "" or [x[1] for x in a[2]] == [x[1] for x in b[2]])


def merged(a: list, b: list) -> list:
    return [often(a[0], b[0]), a[1], align(a[2], b[2])]


def fold(items: list) -> list:
    """Adjacent repeats, of one item or of a few in turn, become one repeated item."""
    return fold_level([[n, mark, fold(inner)] for n, mark, inner in items])


def fold_level(items: list) -> list:
    out: list = []
    for item in items:
        if out and alike(out[-1], item) and item[1] != "#":
            out[-1] = ["*" if out[-1][0] in "?*" and item[0] in "?*" else "+", item[1], align(out[-1][2], item[2])]
        elif not (out and item[1] == "#" == out[-1][1]):
            out.append(item)
    for width in (2, 3, 4):
        i = 0
        while i + 2 * width <= len(out):
            if all(alike(out[i + k], out[i + width + k]) for k in range(width)):
                group = [merged(out[i + k], out[i + width + k]) for k in range(width)]
                j = i + 2 * width
                while j + width <= len(out) and all(alike(group[k], out[j + k]) for k in range(width)):
                    group = [merged(group[k], out[j + k]) for k in range(width)]
                    j += width
                out[i:j] = [["+", "", group]]
            i += 1
    return out


def align(a: list, b: list) -> list:
    """The items of both: matches merged, the rest optional, repeats folded."""
    if a == b:
        return a
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + 1 if alike(a[i], b[j]) else 0)
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and alike(a[i], b[j]) and best[i][j] == best[i + 1][j + 1] + 1:
            out.append(merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append([often(a[i][0], "?"), *a[i][1:]])
            i += 1
        else:
            out.append([often(b[j][0], "?"), *b[j][1:]])
            j += 1
    return fold_level(out)


def slots(items: list, place: Place = ()) -> Iterator[Place]:
    for _, mark, inner in items:
        if mark == "#":
            yield place
        else:
            yield from slots(inner, (*place, mark) if mark else place)


def kind(mark: str) -> str:
    """A mark without what is still to be confirmed."""
    return mark.split(" ")[0] if mark[-1] == "?" else mark


REGIONS: tuple[Callable[[Place], int | None], ...] = (
    lambda place: next((i for i, x in enumerate(place) if kind(x).rstrip("+") == "article"), None),
    lambda place: next((i for i, x in enumerate(place) if kind(x).rstrip("+") == "main"), None),
    lambda place: next((i for i, x in enumerate(place) if kind(x)[-1] == "+"), None),
    lambda place: 0 if place else -1,
)


def boilerplate(mark: str, confirmed: Set[int]) -> bool:
    return mark[-1] == "-" or mark[-1] == "?" and _digest(mark) in confirmed


def in_region(place: Place, region: int, confirmed: Set[int] = frozenset(), around: bool = False) -> bool:
    """Whether a text at ``place`` is main text, if that region holds the host's articles and those marks are ``confirmed``.

    With ``around`` words and forms around the region do not count.
    """
    start = REGIONS[region](tuple("-" if boilerplate(x, confirmed) else x for x in place) if region < 3 else place)
    if start is None or any(boilerplate(x, confirmed) and not (around and i < start and x[:-1] not in HARD) for i, x in enumerate(place)):
        return False
    headers = [i for i, x in enumerate(place) if x[-1] == "^"]
    return not headers or region < 3 and headers[0] > start and kind(place[-1]).rstrip("+") in HEADINGS


@lru_cache(maxsize=4096)
def main_slots(wrapper: str, template: str | None = None) -> list[tuple[bool, frozenset[Place]]]:
    """The main slots of a wrapper for each region that it has, best first, and whether words and forms around it were passed over."""
    places = set(slots(json.loads(wrapper)))
    order = [(r, False) for r in range(3)] + [(r, True) for r in range(3)] + [(3, False)]
    found = [(around, frozenset(p for p in places if in_region(p, r, _template(template), around))) for r, around in order]
    return [(around, s) for around, s in found if s]


@lru_cache(maxsize=4096)
def regionless(wrapper: str, template: str | None = None) -> bool:
    return not any(in_region(p, r, _template(template), True) for p in slots(json.loads(wrapper)) for r in range(len(REGIONS) - 1))


def blocks(html: str, chosen: Callable[[Place], bool]) -> Iterator[tuple[Place, str, int]]:
    """Blocks of the chosen texts: place, text, linked characters."""
    parts: list[str] = []
    at: Place = ()
    links = 0
    for kind, text, place, linked in chain(read(html), [(END, "", (), False)]):
        if kind == TEXT:
            if chosen(place):
                at = at if parts else place
                parts.append(text)
                links += linked * len(text)
        elif parts:
            if joined := " ".join("".join(parts).split()):
                yield at, joined, links
            parts, links = [], 0


def host(url: str = "url") -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def infer_wrappers(pages: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """host and wrapper (JSON) for every host of ``pages`` (url, html), as a written table."""

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([json.dumps(shape(h or "")) for h in batch.column(1).to_pylist()], pa.string())],
                                  ["host", "wrapper"])

    def aligned(group: pa.Table) -> pa.Table:
        wrapper: list = []
        for i, text in enumerate(sorted(group.column("wrapper").to_pylist())):
            wrapper = align(wrapper, json.loads(text)) if i else json.loads(text)
        return pa.table({"host": group.column("host")[:1], "wrapper": pa.array([json.dumps(wrapper)], pa.string())})

    found = pages.select(host().alias("host"), "html").mapInArrow(shapes, "host string, wrapper string")
    found = settle(found.distinct(), "shapes")
    while True:
        counts = found.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        counts, hosts = keep(counts)
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return found
        buckets = found.join(counts, "host").select(
            "host", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / F.lit(bucket))).alias("bucket"), "wrapper")
        found = settle(buckets.groupBy("host", "bucket").applyInArrow(aligned, "host string, wrapper string").distinct(), "wrappers")


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _text_digest(place: Place, text: str) -> int:
    return _digest("\0".join([*place, "", text]))


def repeated(pages: DataFrame) -> DataFrame:
    """host and ``template``: JSON of the digests of texts, at their places, and of marks to be confirmed that stand on most of
    the host's ``pages`` (host, html), texts on three at least and marks on two. Each page has few such, so a host's list is no longer
    than a page."""

    def counted(place: Place) -> bool:
        return not any(x[-1] == "-" and (x[:-1] in HARD or x[:-1] in INLINE) for x in place)

    def digests(html: str) -> dict[int, bool]:
        found = {_text_digest(place, text): False for place, text, _ in blocks(html, counted)}
        return found | {_digest(x): True for x in {x for kind, _, place, _ in read(html) if kind == OPEN or kind == TEXT for x in place if x[-1] == "?"}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, *key) for h, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for key in digests(html or "").items()]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.bool_()))], ["host", "digest", "mark"])

    found = pages.mapInArrow(run, "host string, digest long, mark boolean").groupBy("host", "digest", "mark").agg(F.count(F.lit(1)).alias("n"))
    of = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    least = F.when(F.col("mark"), 2).otherwise(SAME_PAGES)
    return found.where(F.col("n") >= least).join(of, "host").where(F.col("n") * 2 > F.col("pages")).groupBy("host").agg(
        F.to_json(F.sort_array(F.collect_list("digest"))).alias("template"))


@lru_cache(maxsize=4096)
def _template(template: str | None) -> frozenset[int]:
    return frozenset(json.loads(template or "[]"))


def main_text(html: str, wrapper: str, template: str | None) -> str:
    found: list[tuple[Place, str, int]] = []
    for around, places in main_slots(wrapper, template):
        here = list(blocks(html, places.__contains__))
        # A region inside boilerplate counts if it is the longer part of the page.
        if here and (not found or not around and sum(len(t) for _, t, _ in here) > sum(len(t) for _, t, _ in found)):
            found = here
        if here and not around:
            break
    gone, odd = _template(template), regionless(wrapper, template)
    kept = [text for place, text, links in found if _text_digest(place, text) not in gone and not (odd and 2 * links > len(text))]
    if not odd and 2 * sum(map(len, kept)) < sum(len(text) for _, text, _ in found):
        kept = []  # pages that are copies of one another have most of their text in common
    return "\n".join(kept or [text for _, text, _ in found])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""
    wrappers = infer_wrappers(pages)
    with_host = pages.select("page_id", "url", "html", host().alias("host"))
    wrappers = wrappers.join(repeated(with_host.select("host", "html")), "host", "left")
    wrappers, _ = keep(wrappers)
    size = wrappers.agg(F.sum(F.length("wrapper") + F.coalesce(F.length("template"), F.lit(0)))).first()[0] or 0
    rows = with_host.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host").select(
        "page_id", "url", "html", "wrapper", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "", w, t) for h, w, t in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                  ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
