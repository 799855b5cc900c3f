"""Main text of web pages by nearest-URL page differencing.

A page is cut into text lines (blocks).  Pages are range-sorted by host and
path; each is aligned with the nearest page before and after it on its host
that is not a copy of it, by longest common subsequence of lines, and shared lines are the template's:
they are deleted.  Markup guards the method on both sides: lines of menus,
headers, footers, sidebars, notices, adverts, forms and comments go even where
a page is alone with them, and lines inside an article or main element stay
even if a neighbour quotes them.  A copy is told by what it does not share:
next to nothing on either side.  It tells nothing and is passed over; so is a
page without text.

Only line hashes are sorted, not pages.  The deletions are joined back by page
and content; that table is broadcast only if its size is below Spark's own
limit.  Pairs across the edge of two partitions are made in a second pass
over the first and the last run of copies of each, one row for each form.

Defined results: null html is empty; a page without text has the empty text;
a null or broken URL is a host of its own; equal rows give equal results; rows
without id are extracted like others, but the lines that only their neighbours
show as shared stay; ids that are not integers are refused; an empty table gives
an empty table; further columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, range_count, text_or_empty, whole_ids, write_scratch

#: Two pages are copies if each has at most this share of its text, and at most
#: so many characters, to itself: a date or a counter.
OWN_SHARE = 0.05
OWN_CHARS = 40

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|textarea|iframe|title|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: Fixed words of class and id names that mark what is not the article; a name
#: like ``has-sidebar`` speaks of another part of the page.
_NOT_OF_OTHERS = r"(?:^|(?<!\bhas)(?<!\bwith)(?<!\bno)(?<!\bhide)[\s_-])"
_CHROME = re.compile(
    _NOT_OF_OTHERS + r"(?:nav|navbar|navigation|menu|footer|sidebar|aside|ad|ads|adslot|advert\w*|banner|promo\w*|sponsor\w*|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay"
    r"|subscribe|newsletter|signup|login|search|comments?|comment-\w+|commentlist|disqus\w*|discussion|replies|reply|respond|share|sharing|social|breadcrumbs?|pagination|pager|related|recommended|widget|toolbar|copyright|skip-link)(?:$|[\s_-])",
    re.I,
)
#: The same outside an article, which has a header of its own.
_PAGE_TOP = re.compile(_NOT_OF_OTHERS + r"(?:header|masthead|topbar)(?:$|[\s_-])", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
_DROPPED = {"head", "nav", "footer", "aside", "form", "button", "dialog", "menu", "object", "canvas", "audio", "video"}
_MAIN = {"article", "main"}
_CONTAINERS = {
    "html", "head", "body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr",
    "figure", "figcaption", "blockquote", "fieldset", "details", "summary", "dialog", "menu", "button", "object", "canvas", "audio", "video", "center", "address", "hgroup",
}
_LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "caption", "pre", "option", "label", "legend"}
_SPACE = re.compile(r"\s+")
FREE, DROPPED, MAIN = 0, 1, 2


def _is_chrome(tag: str, attributes: str, zone: int) -> bool:
    if not attributes or tag in ("html", "body"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
        if name in ("class", "id") and (_CHROME.search(value) or (zone != MAIN and _PAGE_TOP.search(value))):
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if (name == "hidden" and value.lower() != "until-found") or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return True
    return False


def lines_of(html: str) -> list[tuple[int, str]]:
    """(zone, text) of every non-empty block in page order."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    zone, leaf, held, has_main = FREE, False, [], False

    def flush():
        if held:
            text = _SPACE.sub(" ", html_lib.unescape("".join(held))).strip()
            if text:
                out.append((DROPPED if leaf else zone, text))
            held.clear()

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        tag = m.group(3) or m.group(6)
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), m.group(2) or m.group(5), m.group(4) or m.group(7) or ""
        if tag in ("br", "hr"):
            flush()
        elif tag in _LEAVES:
            flush()
            leaf = not closing and _is_chrome(tag, attributes, zone)
        elif tag in _CONTAINERS:
            flush()
            leaf = False
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        zone = stack[k][1]
                        del stack[k:]
                        break
            elif not attributes.endswith("/"):
                stack.append((tag, zone))
                if zone == DROPPED:
                    # a page's first article counts even in a wrapper with an odd class
                    if tag in _MAIN and not has_main and not any(t in _DROPPED for t, _ in stack) and not _is_chrome(tag, attributes, zone):
                        zone, has_main = MAIN, True
                elif tag in _DROPPED or (tag == "header" and zone != MAIN) or _is_chrome(tag, attributes, zone):
                    zone = DROPPED
                elif tag in _MAIN:
                    zone, has_main = MAIN, True
    if at < len(html):
        held.append(html[at:])
    flush()
    return out


#: Rows of the alignment that are kept at once; the others are made again.
ROWS = 256


def _next_row(row: int, met: int, full: int) -> int:
    """One line further: a 0 bit tells where the common length grows."""
    both = row & met
    return ((row + both) | (row - both)) & full if both else row


def common_lines(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Longest common subsequence as index pairs.

    Rows of the length table are bit vectors, so that the cost is the product of
    the line numbers by 64, however often lines repeat; every ROWS-th row is kept.
    """
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    places: dict[int, int] = {}
    for j, line in enumerate(y):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(y)) - 1
    row, kept = full, []
    for i, line in enumerate(x):
        if i % ROWS == 0:
            kept.append(row)
        row = _next_row(row, places.get(line, 0), full)
    middle, j = [], len(y)
    for block in range(len(kept) - 1, -1, -1):
        rows = [kept[block]]
        for line in x[block * ROWS : (block + 1) * ROWS]:
            rows.append(_next_row(rows[-1], places.get(line, 0), full))
        i = len(rows) - 1
        while i and j:
            bit = 1 << (j - 1)
            if rows[i] & bit:
                j -= 1
            else:
                i -= 1
                if rows[i] & bit:  # the length grew with this very line
                    j -= 1
                    middle.append((start + block * ROWS + i, start + j))
    return [(i, i) for i in range(start)] + middle[::-1] + [(len(a) - end + i, len(b) - end + i) for i in range(end)]


_PAGE = "host string, path string, id bigint, content bigint, hashes array<bigint>, sizes array<int>, zones array<int>"
_FOUND = (
    "kind string, part int, place int, gap boolean, host string, ids array<bigint>, contents array<bigint>, hashes array<bigint>, sizes array<int>, zones array<int>, id bigint, content bigint, dropped array<int>"
)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            rows = []
            for i, url, page, content in zip(*[c.to_pylist() for c in part.columns], strict=True):
                try:
                    u = urlsplit(url)
                    host, path = (u.hostname or "").removeprefix("www."), u.path
                except ValueError:
                    host, path = url, ""
                lines = lines_of(page)
                rows.append((host, path, i, content, [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - 2**63 for _, t in lines], [len(t) for _, t in lines], [z for z, _ in lines]))
            if rows:
                c = list(zip(*rows, strict=True))
                types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], names=["host", "path", "id", "content", "hashes", "sizes", "zones"])


def _body(page: dict) -> int:
    return sum(s for s, z in zip(page["sizes"], page["zones"], strict=True) if z != DROPPED)


def _copies(a: dict, b: dict, pairs: list[tuple[int, int]]) -> bool:
    """Whether next to nothing of either page is its own."""
    for page, shared in ((a, [i for i, _ in pairs]), (b, [j for _, j in pairs])):
        body = _body(page)
        own = body - sum(page["sizes"][k] for k in shared if page["zones"][k] != DROPPED)
        if own > min(OWN_CHARS, OWN_SHARE * body):
            return False
    return True


def _drops(page: dict, lines: Iterator[int]) -> list[dict]:
    gone = [k for k in lines if page["zones"][k] == FREE]
    return [{"kind": "drop", "id": i, "content": c, "dropped": gone} for i, c in zip(page["ids"], page["contents"], strict=True)] if gone else []


class _CopyRuns:
    """Pages in order, as runs of copies of the run's first page.  A run's
    pages are aligned with the last page before it and the first one after it;
    pages of equal lines are one form."""

    def __init__(self):
        self.before, self.forms = None, {}
        self.n_runs, self.first, self.second, self.last_before = 0, [], None, None

    def add(self, page: dict) -> list[dict]:
        if not _body(page):
            return []
        key = (tuple(page["hashes"]), tuple(page["zones"]))
        out: list[dict] = []
        forms = list(self.forms.values())
        if forms and forms[0]["host"] == page["host"]:
            pairs = [] if key in self.forms else common_lines(forms[0]["hashes"], page["hashes"])
            if key in self.forms or _copies(forms[0], page, pairs):
                if self.before is not None:
                    out += _drops(page, [j for _, j in common_lines(self.before["hashes"], page["hashes"])])
                if key in self.forms:
                    self.forms[key]["ids"] += page["ids"]
                    self.forms[key]["contents"] += page["contents"]
                else:
                    self.forms[key] = page
                return out
            for k, form in enumerate(forms):
                if k:
                    pairs = common_lines(form["hashes"], page["hashes"])
                out += _drops(form, [i for i, _ in pairs])
            out += _drops(page, [j for _, j in pairs])
            self.before = forms[-1]
        else:
            self.before = None
        if self.n_runs == 1:
            self.first, self.second = forms, _alone(page)
        self.last_before = _alone(forms[-1]) if forms else None
        self.n_runs += 1
        self.forms = {key: page}
        return out

    def ends(self) -> list[dict]:
        """Pages that other partitions may have to be aligned with."""
        last = list(self.forms.values())
        if self.n_runs < 3:
            return [x | {"kind": "end", "gap": False} for x in [*self.first, *last]]
        rows = [*[(x, False) for x in self.first], (self.second, False), (self.last_before, True), *[(x, False) for x in last]]
        return [x | {"kind": "end", "gap": gap} for x, gap in rows]


def _alone(page: dict) -> dict:
    """The lines of a page that is only there to be aligned with."""
    return page | {"ids": [], "contents": []}


def _rows(rows: list[dict]) -> pa.RecordBatch:
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    types = {"kind": pa.string(), "part": pa.int32(), "place": pa.int32(), "gap": pa.bool_(), "host": pa.string(), "ids": longs, "contents": longs, "hashes": longs, "sizes": ints, "zones": ints, "id": pa.int64(), "content": pa.int64(), "dropped": ints}
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in types.items()], names=list(types))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    runs = _CopyRuns()
    for batch in batches:
        out = []
        for page in batch.to_pylist():
            out += runs.add(page | {"ids": [page.pop("id")], "contents": [page.pop("content")]})
        if out:
            yield _rows(out)
    ends = [x | {"part": part, "place": k} for k, x in enumerate(runs.ends())]
    if ends:
        yield _rows(ends)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: (r["part"], r["place"]))
    runs, out = _CopyRuns(), []
    for r in ends:
        if r["gap"]:
            runs = _CopyRuns()
        out += runs.add({k: r[k] for k in ("host", "ids", "contents", "hashes", "sizes", "zones")})
    if out:
        yield _rows(out)


def template_lines(pages: DataFrame) -> DataFrame:
    """(id, content, gone): numbers of the lines that a neighbour shares."""
    narrow, _ = write_scratch(pages.mapInArrow(_pages, _PAGE), "page-lines")
    parts = range_count(narrow, 4096)
    ordered = narrow.repartitionByRange(parts, "host", "path", "id").sortWithinPartitions("host", "path", "id", "content")
    found, _ = write_scratch(ordered.mapInArrow(_neighbours, _FOUND), "page-pairs")
    across = found.where("kind <> 'drop'").coalesce(1).mapInArrow(_edges, _FOUND)  # two runs of each partition
    gone = found.where("kind = 'drop'").union(across).groupBy("id", "content").agg(F.array_distinct(F.flatten(F.collect_list("dropped"))).alias("gone"))
    return write_scratch(gone, "template-lines")[0]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            texts = []
            for page, gone in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                lines = lines_of(page)
                drop = set(gone or ())
                has_main = any(z == MAIN for z, _ in lines)
                texts.append(" ".join([t for k, (z, t) in enumerate(lines) if k not in drop and (z == MAIN or (z == FREE and not has_main))]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page."""
    whole_ids(pages, id_col)
    html = text_or_empty(html_col)
    base = pages.select(pages[id_col].cast("bigint").alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.xxhash64(html).alias("content"))
    gone = template_lines(base.select("id", F.coalesce("url", F.lit("")).alias("url"), "html", "content"))
    joined = base.join(gone, ["id", "content"], "left").select("id", "url", "html", "gone")
    return joined.mapInArrow(_texts, "id bigint, url string, text string, n_chars bigint").withColumnRenamed("id", id_col)
