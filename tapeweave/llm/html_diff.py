"""Main text of web pages by differencing pages with near addresses.

Pages are ordered by host and path; each is paired with the nearest page before
or behind it, their text lines are aligned by a longest common subsequence, and
shared lines, which the site's template put there, are deleted.  Markup has its
say on both sides of that: what it names as furniture (menus, forms, adverts,
comments) goes without a pair, and what it names as article stays, since
paragraphs of articles repeat too.
"""

from __future__ import annotations

import hashlib
import html as entities
import os
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices

SCHEMA = "page_id long, url string, text string, n_chars long"

#: Kinds of lines: not decided by markup, in an article, furniture.
OPEN, ARTICLE, FURNITURE = 0, 1, 2

# Elements by what they do to text.
RAW = "script|style|noscript|template|textarea|select|svg|math|iframe|object|title|button|canvas|audio|video"
FURNITURE_TAGS = frozenset("nav aside form footer dialog menu".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: The next block ends these; a list item or row ends the one before it.
OPEN_ENDED = frozenset("p h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li dt dd tr option".split())
#: Words in class, id or role that name furniture; for elements inside a line
#: only the last list counts, and for articles only the comments.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login register nav navbar navigation menu breadcrumb breadcrumbs sidebar rail widget "
    "header masthead footer comment comments commentlist disqus respond reply replies discussion share sharing social related recommended recommendations "
    "pagination pager search toolbar copyright contentinfo complementary skip".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
INLINE_WORDS = frozenset("ad ads adv advert advertisement sponsored share sharing social skip nav navigation menu breadcrumb breadcrumbs".split())

_ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})\b{_ATTRS}(?<!/)>.*?(?:</(?P=raw)\s*+>|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attrs>{_ATTRS})>"
    rf"|<[!?/][^>]*+>",
    re.S | re.I,
)
_MARK = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_URL = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?([^/?#]*)([^?#]*)([^#]*)", re.I)


def _named(attrs: str, tag: str) -> bool:
    """Whether attributes name an element as furniture, or hide it."""
    for m in _MARK.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if name not in ("class", "id", "role") or tag in ("html", "body"):
            continue
        words = COMMENT_WORDS if tag in ("article", "main") else FURNITURE_WORDS if tag in BLOCK_TAGS else INLINE_WORDS
        for part in value.split():
            ends = re.split(r"[-_]+", part)
            if ends[0] not in ("has", "with", "no", "is", "not") and (ends[0] in words or ends[-1] in words):
                return True
    return False


@dataclass(frozen=True)
class _Place:
    """An open element, and what holds inside it."""

    tag: str = ""
    furniture: bool = False
    article: bool = False
    main: bool = False
    skipped: bool = False


def page_lines(page: str) -> tuple[list[str], list[int]]:
    """The text lines (blocks) of a page in order, and the kind of each.

    Character references are decoded, white space inside a line is one space,
    and so are ``br`` and the borders of table cells.  Inside an article a header
    is not furniture, for it holds the title.  Elements inside a line that are
    named as furniture are left out of it.  A page with an article has nothing
    else to say; with a ``main`` element, nothing outside it.
    """
    lines: list[str] = []
    kinds: list[int] = []
    in_main: list[bool] = []
    stack = [_Place()]
    n_open: Counter[str] = Counter()
    text: list[str] = []

    def end_line(here: _Place) -> None:
        line = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if line:
            lines.append(line)
            kinds.append(FURNITURE if here.furniture else ARTICLE if here.article else OPEN)
            in_main.append(here.main)

    def close_to(k: int) -> None:
        n_open.subtract(x.tag for x in stack[k:])
        del stack[k:]

    at = 0
    for m in _TOKEN.finditer(page):
        here = stack[-1]
        if m.start() > at and not here.skipped:
            text.append(page[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        block = tag in BLOCK_TAGS
        if block:
            if text:
                end_line(here)
        elif tag in ("br", "td", "th"):
            text.append(" ")
        if m["close"]:
            if n_open[tag] > 0:
                close_to(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
        elif tag not in VOID_TAGS:
            if block:
                while stack[-1].tag in OPEN_ENDED or (tag in ITEMS and stack[-1].tag == tag):
                    close_to(len(stack) - 1)
            up = stack[-1]
            marked = not (tag == "header" and up.article) and (tag in FURNITURE_TAGS or tag == "header" or (m["attrs"] != "" and _named(m["attrs"], tag)))
            if block or marked:
                stack.append(_Place(tag, up.furniture or marked, up.article or tag == "article", up.main or tag == "main", up.skipped or (marked and not block)))
                n_open[tag] += 1
    if at < len(page) and not stack[-1].skipped:
        text.append(page[at:])
    end_line(stack[-1])
    if ARTICLE in kinds:
        kinds = [k if k == ARTICLE else FURNITURE for k in kinds]
    elif any(m and k == OPEN for m, k in zip(in_main, kinds, strict=True)):
        kinds = [k if m else FURNITURE for m, k in zip(in_main, kinds, strict=True)]
    return lines, kinds


def _row(a: Sequence[int], b: Sequence[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and every prefix of
    ``b``, bit-parallel: one step on a long integer for each item of ``a``."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def common_lines(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Which items of ``a`` lie on a longest common subsequence with ``b``.

    Halves ``a`` and finds where ``b`` divides, so memory is linear in the
    lengths, and time their product over the machine word.
    """
    out: list[int] = []
    held = set(b)
    work = [([(i, x) for i, x in enumerate(a) if x in held], list(b))]
    while work:
        left, right = work.pop()
        while left and right and left[0][1] == right[0]:
            out.append(left[0][0])
            left, right = left[1:], right[1:]
        while left and right and left[-1][1] == right[-1]:
            out.append(left[-1][0])
            left, right = left[:-1], right[:-1]
        if not left or not right:
            continue
        if len(left) == 1:
            if left[0][1] in right:
                out.append(left[0][0])
            continue
        half = len(left) // 2
        items = [x for _, x in left]
        fore, back = _row(items[:half], right), _row(items[half:][::-1], right[::-1])
        cut_at = int(np.argmax(fore + back[::-1]))
        work += [(left[:half], right[:cut_at]), (left[half:], right[cut_at:])]
    return sorted(out)


@dataclass
class Signature:
    """What pairing knows of a page: its address and its lines' hashes, lengths
    and kinds."""

    host: str
    path: str
    hashes: list[int]
    sizes: list[int]
    kinds: list[int]


def _same_text(a: Signature, b: Signature, shared: Sequence[int]) -> bool:
    """Whether two pages are versions of one text: less than a tenth of what
    markup leaves open in either is its own."""
    common = sum(a.sizes[i] for i in shared if a.kinds[i] == OPEN)
    return any(10 * (total - common) < total for total in (sum(n for n, k in zip(x.sizes, x.kinds, strict=True) if k == OPEN) for x in (a, b)))


def _nearness(a: str, b: str) -> tuple[int, int]:
    same = len(os.path.commonprefix((a, b)))
    return a.count("/", 0, same), same


def template_lines(page: Signature, before: Signature | None, behind: Signature | None) -> list[int]:
    """Lines of ``page`` that its nearest neighbour shares and markup leaves open.

    Of the pages before and behind it, the one whose path agrees further comes
    first (ties: before).  One that is a version of the same text says nothing
    about the template, and the other is asked.
    """
    if OPEN not in page.kinds:
        return []
    near = [x for x in (before, behind) if x is not None and x.host == page.host]
    for other in sorted(near, key=lambda x: _nearness(page.path, x.path), reverse=True):
        shared = common_lines(page.hashes, other.hashes)
        if not _same_text(page, other, shared):
            return [i for i in shared if page.kinds[i] == OPEN]
    return []


def _hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest(), "little", signed=True)


def _address(url: str) -> tuple[str, str]:
    """Host, and path with query, by which pages are ordered."""
    m = _URL.match(url)
    return m[1].lower(), m[2] + m[3]


SIGNATURE = "host string, path string, digest long, hashes array<long>, sizes array<int>, kinds array<tinyint>"
ORDER = ["host", "path", "page_id", "content"]
PAIRED = f"page_id long, content long, part int, run long, gone array<int>, item boolean, {SIGNATURE}"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        columns: list[list] = [[] for _ in range(6)]
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            lines, kinds = page_lines(page or "")
            hashes = [_hash(x) for x in lines]
            digest = _hash(repr((hashes, kinds)))
            for column, value in zip(columns, (*_address(url), digest, hashes, [len(x) for x in lines], kinds), strict=True):
                column.append(value)
        types = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int8()))
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("content"), *arrays], names=["page_id", "content", "host", "path", "digest", "hashes", "sizes", "kinds"])


@dataclass
class _Run:
    """Neighbouring pages with equal lines."""

    number: int
    digest: int
    signature: Signature
    pages: list[tuple[int | None, int]]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[_Run]:
    run = None
    number = 0
    for batch in batches:
        for r in batch.to_pylist():
            # equal lines on another host are another run
            if run is None or r["digest"] != run.digest or r["host"] != run.signature.host:
                if run is not None:
                    yield run
                run = _Run(number, r["digest"], Signature(r["host"], r["path"], r["hashes"], r["sizes"], r["kinds"]), [])
                number += 1
            run.pages.append((r["page_id"], r["content"]))
    if run is not None:
        yield run


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decide the runs of one range of addresses, but for the first and the last,
    whose neighbours may lie in another range: these, and the runs beside them,
    are given on as items."""
    part = TaskContext.get().partitionId()
    schema = [("page_id", pa.int64()), ("content", pa.int64()), ("part", pa.int32()), ("run", pa.int64()), ("gone", pa.list_(pa.int32())), ("item", pa.bool_()),
              ("host", pa.string()), ("path", pa.string()), ("digest", pa.int64()), ("hashes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("kinds", pa.list_(pa.int8()))]
    rows: list[dict] = []

    def out(run: _Run, gone: list[int] | None) -> None:
        if gone is None or gone:
            rows.extend({"page_id": i, "content": c, "part": part, "run": run.number, "gone": gone, "item": False} for i, c in run.pages)

    def item(run: _Run) -> None:
        rows.append({"part": part, "run": run.number, "item": True, "digest": run.digest, **vars(run.signature)})

    def flush(least: int) -> Iterator[pa.RecordBatch]:
        if len(rows) >= least:
            yield pa.RecordBatch.from_pylist(rows, pa.schema(schema))
            rows.clear()

    older = old = None
    for run in _runs(batches):
        if old is None or older is None:
            item(run)
        if older is not None:
            out(old, template_lines(old.signature, older.signature, run.signature))
        elif old is not None:
            out(old, None)
        older, old = old, run
        yield from flush(1000)
    if old is not None:
        out(old, None)
        for last in (older, old):
            # the first two are given already
            if last is not None and last.number > 1:
                item(last)
    yield from flush(1)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts, runs, gone = [], [], []
        for r in batch.to_pylist():
            here, before, behind = (None if x is None else Signature(x["host"], x["path"], x["hashes"], x["sizes"], x["kinds"]) for x in (r["here"], r["before"], r["behind"]))
            parts.append(r["part"])
            runs.append(r["run"])
            gone.append(template_lines(here, before, behind))
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(runs, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["part", "run", "gone"])


def shared_lines(pages: DataFrame) -> DataFrame:
    """``(page_id, content, gone)``: for ``pages(page_id, url, html, content)``,
    the numbers of the lines that differencing deletes, of pages that have any.

    Only addresses and hashes of lines are shuffled, by ranges of host and path;
    so a host with a third of all pages is many ranges.  Pages at the border of
    a range look for their neighbours among four runs of every range, which
    alone meet in one task.
    """
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: finding the borders of the ranges reads them too
    signed = cut(pages.where("url IS NOT NULL").select("page_id", "content", "url", "html").mapInArrow(_signatures, f"page_id long, content long, {SIGNATURE}"))
    paired = cut(signed.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER).mapInArrow(_pair, PAIRED))
    here = F.struct("host", "path", "hashes", "sizes", "kinds")
    ahead, back = Window.orderBy("part", "run"), Window.orderBy(F.desc("part"), F.desc("run"))
    items = paired.where("item").select("part", "run", "digest", "host", here.alias("here"))
    for name, order in (("before", ahead), ("behind", back)):
        new = (F.lag("digest").over(order) != F.col("digest")) | (F.lag("host").over(order) != F.col("host"))
        items = items.withColumn(name, F.when(new, F.lag("here").over(order)))
    for name, order in (("before", ahead), ("behind", back)):
        items = items.withColumn(name, F.last(name, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    edges = items.select("part", "run", "here", "before", "behind").mapInArrow(_edges, "part int, run long, gone array<int>").where("size(gone) > 0")
    pages_of = paired.where("NOT item")
    at_edges = pages_of.where("gone IS NULL").select("page_id", "content", "part", "run").join(edges, ["part", "run"])
    return pages_of.where("gone IS NOT NULL").select("page_id", "content", "gone").unionByName(at_edges.select("page_id", "content", "gone"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = []
        for page, gone in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            lines, kinds = page_lines(page or "")
            deleted = set(gone or ())
            texts.append("\n".join(x for i, (x, k) in enumerate(zip(lines, kinds, strict=True)) if k != FURNITURE and i not in deleted))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: its lines without furniture and without the
    lines that the nearest page of its host shares (``SCHEMA``).

    One row per input row.  Null or empty html gives an empty text; a null
    address has no neighbour; identifiers may be null or repeated, and repeated
    rows get the same text each.  An empty table gives an empty one; other
    columns are ignored.  A page is parsed whole, twice: for its lines' hashes
    and for its text.  Spark sizes the join of the two: where few pages lose
    lines these travel, else the pages are shuffled once.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html")
    ).withColumn("content", F.xxhash64("url", "html"))
    # repeated rows are neighbours, and lose the same lines; written, for the size of this table says how it is joined
    gone = cut(shared_lines(rows).groupBy("page_id", "content").agg(F.first("gone").alias("gone")))
    joined = rows.alias("r").join(gone.alias("g"), F.expr("r.content = g.content AND r.page_id <=> g.page_id"), "left")
    return joined.select("r.page_id", "r.url", "r.html", "g.gone").mapInArrow(_texts, SCHEMA)
