"""Main text of HTML pages by differencing pages of neighbouring URLs.

A page is cut into text lines, one per block.  Pages of a host stand in the order of their URL paths; each is paired
with the nearer of its two neighbours, by the length of the path that they share, their lines are aligned by a longest
common subsequence, and lines that both pages have are deleted: menus, headers and footers of the site.  A neighbour that
is a copy of the page tells nothing, then the other one is taken.

Differencing alone can't give right results: adverts and notices differ from page to page, and articles share passages
with other articles.  So the lines of an article element are never deleted, and what stands in navigation, footers,
sidebars, forms, notices, adverts and comments by its element, role, class or id goes whether a neighbour has it or not.
Where a page has an article (else a main part), its text is all that is returned.

Only hashes of lines are shuffled for the pairing, dealt by ranges of (host, path), so one host may span many tasks;
pages meet the lines they lose by a join on a digest, and a page that loses none by it has no row there.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.shared import free_name, stored

#: Pages that share this part of both texts are copies of each other, not two pages of one template.
COPY = 0.8
#: Lines of one page aligned at once with bit vectors that are kept; longer pages are halved first.
KEPT_ROWS = 256

# Elements by what they are.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "template", "xmp", "svg", "math"}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "keygen",
}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
    "ins", "kbd", "label", "mark", "meter", "output", "picture", "progress", "q", "rp", "rt", "ruby", "s", "samp", "small",
    "source", "span", "strike", "strong", "sub", "sup", "td", "th", "time", "tt", "u", "var", "wbr",
}
AROUND = {
    "nav", "footer", "aside", "form", "button", "select", "option", "object", "audio", "video", "canvas", "dialog", "menu",
    "head", "fieldset", "datalist",
}
ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu",
    "menubar", "status", "toolbar", "tablist",
}
WORDS = {
    "ad", "ads", "adbox", "adslot", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent",
    "gdpr", "notice", "notices", "alert", "alerts", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup",
    "signin", "login", "register", "nav", "navigation", "menu", "menus", "navbar", "breadcrumb", "breadcrumbs", "sidebar", "rail",
    "widget", "widgets", "footer", "masthead", "topbar", "toolbar", "comment", "comments", "commentlist", "disqus", "respond",
    "replies", "discussion", "share", "sharing", "social", "related", "recommended", "recommendations", "trending", "popular",
    "search", "pagination", "pager", "skip", "toc", "disclaimer", "feedback", "paywall",
}
PREFIXES = ("advert", "comment", "cookie", "breadcrumb", "sidebar", "newsletter", "navbar", "googlead", "dfp")
SAYS_OF_OTHERS = {"has", "with", "no", "without"}
ARTICLE = {"article", "articlebody", "post", "entry", "story"}
MAIN = {"content", "main", "maincontent"}

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))|\b(hidden)\b")
PART = re.compile(r"[a-z0-9]+|[A-Z]+(?![a-z])|[A-Z][a-z0-9]*")


@dataclass
class Element:
    name: str
    gone: bool
    level: int  # 2: in an article, 1: in a main part, 0: elsewhere


@dataclass
class Line:
    """The text of a block; ``gone`` if its element says that it is no main text."""

    text: str
    gone: bool
    level: int
    heading: bool


@dataclass
class Page:
    lines: list[Line] = field(default_factory=list)
    stack: list[Element] = field(default_factory=lambda: [Element("", False, 0)])
    held: list[str] = field(default_factory=list)
    heading: bool = False

    def close(self) -> None:
        """Ends a block."""
        if self.held:
            text = " ".join(entities.unescape("".join(self.held)).split())
            self.held.clear()
            if text:
                top = self.stack[-1]
                self.lines.append(Line(text, top.gone, top.level, self.heading))


def judged(name: str, attributes: str, above: Element) -> Element:
    """What an element is by its name, role, class and id, and by the one it stands in."""
    gone, level = above.gone, above.level
    if name == "article" or name == "main":
        level = max(level, 2 if name == "article" else 1)
    elif name in AROUND or name == "header" and level < 2:
        gone = True
    if attributes and attributes.strip(" /"):
        found = {}
        for m in ATTRIBUTE.finditer(attributes):
            found[(m[1] or m[5]).lower()] = m[2] or m[3] or m[4] or ""
        words = {w.lower() for key in ("class", "id") for w in PART.findall(found.get(key, ""))}
        role = found.get("role", "").lower()
        hides = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        if hides or role in ROLES:
            gone = True
        elif words and name not in ("html", "body", "main") and not words & SAYS_OF_OTHERS:
            comments = any(w.startswith("comment") for w in words)
            if comments or name != "article" and (words & WORDS or any(w.startswith(PREFIXES) for w in words)):
                gone = True
            elif "header" in words and level < 2:
                gone = True
            elif words & ARTICLE and not words - ARTICLE - MAIN - {"body", "text"}:
                level = 2
            elif words & MAIN and level < 1:
                level = 1
        if role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody":
            level = max(level, 1 if role == "main" else 2)
    return Element(name, gone, level)


def lines_of(html: str) -> list[Line]:
    """The blocks of a page in their order, white space turned into single spaces, empty ones left out."""
    page, at, length = Page(), 0, len(html)
    while at < length:
        start = html.find("<", at)
        if start < 0:
            page.held.append(html[at:])
            break
        if start > at:
            page.held.append(html[at:start])
        m = TOKEN.match(html, start)
        if m is None:  # a lone sign
            page.held.append("<")
            at = start + 1
            continue
        at = m.end()
        name = m[2] or m[5]
        if not name:  # comments and declarations
            continue
        name, ends = name.lower(), m[1] or m[4]
        if name in RAW and not ends:
            if not (m[3] or "").rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
                at = end.end() if end else length
            continue
        if name in INLINE:
            if name in ("br", "td", "th"):
                page.held.append(" ")
            if name not in VOID:
                _inline(page, name, bool(ends), m[3] or m[6] or "")
            continue
        page.close()
        if ends:
            _end(page, name)
        elif name not in VOID:
            if name in ("p", "li", "tr", "dt", "dd", "option") or name[0] == "h" and name[1:].isdigit():
                _unclosed(page, name)
            page.stack.append(judged(name, m[3] or m[6] or "", page.stack[-1]))
        page.heading = name[0] == "h" and name[1:].isdigit() and not ends
    page.close()
    return page.lines


def _inline(page: Page, name: str, ends: bool, attributes: str) -> None:
    """Inline elements split a block only where they are no main text or end one that is none."""
    if ends:
        for n in range(len(page.stack) - 1, 0, -1):
            if page.stack[n].name not in INLINE:
                return
            if page.stack[n].name == name:
                if page.stack[n].gone != page.stack[n - 1].gone:
                    page.close()
                del page.stack[n:]
                return
    elif attributes.strip(" /"):
        element = judged(name, attributes, page.stack[-1])
        if element.gone != page.stack[-1].gone:
            page.close()
            page.stack.append(element)


def _end(page: Page, name: str) -> None:
    for n in range(len(page.stack) - 1, 0, -1):
        if page.stack[n].name == name:
            del page.stack[n:]
            return


def _unclosed(page: Page, name: str) -> None:
    """A paragraph or item that opens ends the one that is open right above it."""
    for n in range(len(page.stack) - 1, 0, -1):
        above = page.stack[n].name
        if above == name or above == "p" or name in ("dt", "dd") and above in ("dt", "dd"):
            del page.stack[n:]
            return
        if above not in INLINE:
            return


def main_text(lines: list[Line], shared: set[int]) -> str:
    """The lines that stay: those of the article, else of the main part, else all; ``shared`` ones go outside articles."""
    left = [line for n, line in enumerate(lines) if not line.gone and (line.level == 2 or n not in shared)]
    level = max((line.level for line in left), default=0)
    inside = [line for line in left if line.level == level]
    if level and not any(line.heading for line in inside):  # its title may stand before it
        title = next((n for n, line in enumerate(left) if line.heading), None)
        inside = [line for n, line in enumerate(left) if line.level == level or n == title]
    return "\n\n".join(line.text for line in inside)


def common_lines(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by bit vectors; long sequences are halved where both parts fit best."""
    both = np.intersect1d(a, b)
    left, right = np.flatnonzero(np.isin(a, both)), np.flatnonzero(np.isin(b, both))
    pairs = _aligned(a[left].tolist(), b[right].tolist())
    return [(int(left[i]), int(right[j])) for i, j in pairs]


def _vectors(a: list[int], b: list[int]) -> Iterator[int]:
    """After each of ``a``: a bit for each of ``b``, 0 where the common subsequence grows."""
    full, places = (1 << len(b)) - 1, {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    vector = full
    for x in a:
        met = vector & places.get(x, 0)
        vector = (vector + met | vector - met) & full
        yield vector


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The common length of ``a`` and each prefix of ``b``."""
    vector = (1 << len(b)) - 1
    for vector in _vectors(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(vector.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ends = [(len(a) - n, len(b) - n) for n in range(tail, 0, -1)]
    one, two = a[head : len(a) - tail], b[head : len(b) - tail]
    middle: list[tuple[int, int]] = []
    if len(one) > KEPT_ROWS and two:
        half = len(one) // 2
        fits = _lengths(one[:half], two) + _lengths(one[half:][::-1], two[::-1])[::-1]
        cut = int(fits.argmax())
        middle = _aligned(one[:half], two[:cut]) + [(half + i, cut + j) for i, j in _aligned(one[half:], two[cut:])]
    elif one and two:
        vectors = list(_vectors(one, two))
        i, j = len(one), len(two)
        while i and j:
            if vectors[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if not i or vectors[i - 1] >> (j - 1) & 1:
                    j -= 1
                    middle.append((i, j))
        middle.reverse()
    return [(n, n) for n in range(head)] + [(head + i, head + j) for i, j in middle] + ends


LINES = "key string, host string, path string, hashes binary, sizes binary, open binary"


@dataclass
class Neighbour:
    """What a page shows to the pages beside it: hashes and sizes of its lines; ``open``: lines that differencing decides."""

    key: str
    host: str
    path: str
    hashes: np.ndarray
    sizes: np.ndarray
    open: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Neighbour:
        return cls(row["key"], row["host"], row["path"], np.frombuffer(row["hashes"], "<i8"), np.frombuffer(row["sizes"], "<i4"), np.frombuffer(row["open"], bool))

    def row(self, prefix: str = "") -> dict:
        out = {"key": self.key, "host": self.host, "path": self.path, "hashes": self.hashes.tobytes(), "sizes": self.sizes.tobytes(), "open": self.open.tobytes()}
        return {prefix + k: v for k, v in out.items()}

    def near(self, other: Neighbour) -> int:
        """Characters at the start of both paths."""
        n = 0
        for x, y in zip(self.path, other.path, strict=False):
            if x != y:
                break
            n += 1
        return n

    def shared(self, before: Neighbour | None, after: Neighbour | None) -> list[int]:
        """Open lines that the nearest neighbour on the same host has too, if it is no copy; ties take the one before."""
        if not self.open.any():
            return []
        beside = [p for p in (before, after) if p is not None and p.host == self.host]
        for other in sorted(beside, key=lambda p: -self.near(p)):
            pairs = common_lines(self.hashes, other.hashes)
            mine, its = [i for i, _ in pairs], [j for _, j in pairs]
            if self.sizes[mine].sum() < COPY * self.sizes.sum() or other.sizes[its].sum() < COPY * other.sizes.sum():
                return [i for i in mine if self.open[i]]
        return []


def _show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of pages as hashes."""
    schema = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.binary()) for f in LINES.split(", ")])
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            out = []
            for row in batch.slice(at, 64).to_pylist():
                lines = lines_of(row["html"])
                hashes = np.array([xxhash.xxh64_intdigest(x.text) for x in lines], np.uint64).view("<i8")
                sizes = np.array([len(x.text) for x in lines], "<i4")
                free = np.array([not x.gone and x.level < 2 for x in lines], bool)
                out.append(Neighbour(row["key"], row["host"], row["path"], hashes, sizes, free).row())
            yield pa.RecordBatch.from_pylist(out, schema)


EDGES = f"{LINES}, " + ", ".join(f"inner_{f}" for f in LINES.split(", ")) + ", task int, last boolean, marks binary"


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Lines that pages lose (key, marks), and what the first and last page of a task must ask the next tasks for."""
    before: Neighbour | None = None
    page: Neighbour | None = None
    task, count = 0, 0

    def edge(own: Neighbour, inner: Neighbour | None, last: bool) -> pd.DataFrame:
        return pd.DataFrame([own.row() | (inner.row("inner_") if inner else {}) | {"task": task, "last": last}])

    def marks(own: Neighbour, shared: list[int]) -> Iterator[pd.DataFrame]:
        if shared:
            yield pd.DataFrame([{"key": own.key, "marks": np.array(shared, "<i4").tobytes()}])

    for batch in batches:
        for row in (r for at in range(0, batch.num_rows, 64) for r in batch.slice(at, 64).to_pylist()):
            task, after = row["task"], Neighbour.of(row)
            if page is not None and after.key == page.key:  # a repeated row
                continue
            if page is not None:
                count += 1
                if count == 1:
                    yield edge(page, after, False)
                else:
                    yield from marks(page, page.shared(before, after))
            before, page = page, after
    if page is not None:
        yield edge(page, before, True)  # alone in its task it is the last one too


COLUMNS = [f.split()[0] for f in EDGES.split(", ")]
PAIRED = pa.schema(
    [(f.split()[0], {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_()}[f.split()[1]]) for f in EDGES.split(", ")]
)


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for frame in _pair(batches):
        held += frame.to_dict("records")
        if len(held) >= 256:
            yield pa.RecordBatch.from_pylist(held, PAIRED)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, PAIRED)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last pages of all tasks in their order: each meets its inner neighbour and the one in the next task."""
    schema = pa.schema([("key", pa.string()), ("marks", pa.binary())])

    def found(row: dict, outer: dict | None, single: dict | None) -> list[dict]:
        page = Neighbour.of(row)
        inner = Neighbour.of({f.split()[0]: row[f"inner_{f.split()[0]}"] for f in LINES.split(", ")}) if row["inner_key"] else None
        if inner is None and single is not None:  # alone in its task: a neighbour on either side
            inner = Neighbour.of(single)
        other = Neighbour.of(outer) if outer is not None else None
        shared = page.shared(inner, other) if row["last"] else page.shared(other, inner)
        return [{"key": page.key, "marks": np.array(shared, "<i4").tobytes()}] if shared else []

    before: dict | None = None
    held: dict | None = None
    for batch in batches:
        for row in (r for at in range(0, batch.num_rows, 64) for r in batch.slice(at, 64).to_pylist()):
            if held is not None:
                outer = row if held["last"] else before
                if out := found(held, outer, before if held["last"] else None):
                    yield pa.RecordBatch.from_pylist(out, schema)
            before, held = held, row
    if held is not None and (out := found(held, None if held["last"] else before, before if held["last"] else None)):
        yield pa.RecordBatch.from_pylist(out, schema)


def shared_lines(pages: DataFrame) -> DataFrame:
    """key, marks: the lines that each page loses to its neighbour.  ``pages`` hold key, host, path and html."""
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shown = pages.mapInArrow(_show, LINES)
    dealt = shown.repartitionByRange(tasks, "host", "path", "key").sortWithinPartitions("host", "path", "key")
    found = stored(dealt.withColumn("task", F.spark_partition_id()).mapInArrow(_paired, EDGES), "page-pairs")
    edges = found.where("task is not null").repartition(1).sortWithinPartitions("task", "last")  # two rows a task
    inside = found.where("task is null").select("key", "marks")
    return inside.union(edges.mapInArrow(_edges, "key string, marks binary"))


def extract(pages: DataFrame) -> DataFrame:
    """The table with ``text`` (its main text, empty if none) and ``n_chars`` (its code points) in place of html.

    The table holds page_id, url and html; null html is empty, pages of null or unparsable URLs are neighbours of each
    other.  Repeated rows are extracted each for itself and are no neighbours of each other.  Character references
    are decoded, white space in a block becomes one space, blocks are joined by two line feeds.  A page that ends in
    the middle of a tag loses the tag.  An empty table gives an empty result; columns named text or n_chars are
    replaced, others stay.
    """
    key, marks, row = (free_name(pages, n) for n in ("page_key", "page_marks", "page_html"))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    digest = F.md5(F.concat_ws("\x00", F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, html))
    after = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    host = F.lower(F.regexp_extract(after, r"^//([^/?#]*)", 1))
    path = F.regexp_replace(after, r"^//[^/?#]*", "")
    keyed = pages.select(digest.alias("key"), host.alias("host"), path.alias("path"), html.alias("html"))
    lost = shared_lines(keyed).groupBy("key").agg(F.first("marks").alias("marks"))
    lost = stored(lost.select(F.col("key").alias(key), F.col("marks").alias(marks)), "page-marks")
    kept = [c for c in pages.columns if c.lower() not in ("html", "text", "n_chars")]
    rows = pages.select(*kept, html.alias(row), digest.alias(key)).join(lost, key, "left").drop(key)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = []
                for source, mark in zip(part.column(row).to_pylist(), part.column(marks).to_pylist(), strict=True):
                    found.append(main_text(lines_of(source), set(np.frombuffer(mark, "<i4").tolist()) if mark else set()))
                columns = [part.column(c) for c in kept] + [pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "text", "n_chars"])

    schema = pages.select(*kept).withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    return rows.mapInArrow(texts, schema)
