"""Text of web pages without the templates of their sites."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.arrowtext import trimmed
from trawl.llm.exchange import stored, tuned
from trawl.llm.urls import host

#: A subtree is a template if it is on at least this many different pages of its host. No share of them is
#: asked for: on a large host that would keep the templates of its sections.
LEAST_PAGES, LEAST_SHARE = 3, 0.0
#: Templates whose keys take at most this many bytes are shipped to every task, others joined by host and subtree.
BROADCAST_BYTES = 64 << 20

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never text of the page.
HIDDEN = frozenset("script style noscript template svg math iframe object head title canvas select option".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: Open elements that a start tag ends, up to the nearest of the second set.
_ITEMS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}), "body": ({"head"}, {"html"}),
}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

_MARKUP = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*+)(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+>|!--|[!?/][^>]*+>)""")
_SPACES = re.compile(r"\s+")


class Page:
    """A page's visible text in chunks, and its elements as ranges of chunks with hashes of their subtrees.

    Tags that HTML lets authors leave out are implied: items end the items before them, blocks end
    paragraphs, an end tag ends what is open inside its element, and the end of the page ends all.
    End tags of elements that aren't open, comments, declarations and attributes are ignored. A
    subtree's hash is of its tag, its texts with white space normalised, and its children's hashes.
    """

    def __init__(self, html: str):
        self.chunks: list[str] = []
        self.elements: list[tuple[int, int, int]] = []
        self._open: list[tuple[str, int, list[str]]] = [("", 0, [])]
        self._count: Counter[str] = Counter()  # of open elements, so that deep pages aren't searched in vain
        self._hidden = 0
        last, at, end = html.rfind(">"), 0, len(html)
        while at < end:
            m = _MARKUP.search(html, at, last + 1) if at <= last else None
            if m is None:  # no tag can end any more, but a comment may begin
                comment = html.find("<!--", at)
                self._text(html[at:] if comment < 0 else html[at:comment])
                break
            self._text(html[at : m.start()])
            at = m.end()
            name = m.group(2)
            if name is None:
                if m.group() == "<!--":
                    close = html.find("-->", at)
                    at = end if close < 0 else close + 3
                continue
            name = name.lower()
            if m.group(1):
                self._end(name)
                continue
            self._start(name)
            if name in RAW:
                close = re.compile(rf"</{name}(?![\w-])[^>]*>", re.I).search(html, at)
                self._text(html[at : close.start()] if close else html[at:])
                at = close.end() if close else end
                self._end(name)
        while len(self._open) > 1:
            self._close()
        self.root = xxhash.xxh64_intdigest("\n".join(self._open[0][2]))

    def _text(self, raw: str) -> None:
        if self._hidden or not raw:
            return
        text = _SPACES.sub(" ", unescape(raw) if "&" in raw else raw)
        if text != " ":
            self._open[-1][2].append(text.strip())
        self.chunks.append(text)

    def _start(self, name: str) -> None:
        if name in _ENDS_P:
            self._close_within({"p"}, {"table", "td", "th", "button", "object"})
        if name in _ITEMS:
            self._close_within(*_ITEMS[name])
        if name not in INLINE and name not in HIDDEN and not self._hidden:
            self.chunks.append("\n")
        if name in VOID:
            return
        self._open.append((name, len(self.chunks), []))
        self._count[name] += 1
        self._hidden += name in HIDDEN

    def _close_within(self, names: set[str], scope: set[str]) -> None:
        if not any(self._count[n] for n in names):
            return
        for k in range(len(self._open) - 1, 0, -1):
            tag = self._open[k][0]
            if tag in names:
                while len(self._open) > k:
                    self._close()
                return
            if tag in scope:
                return

    def _end(self, name: str) -> None:
        if not self._count[name]:
            return
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k][0] == name:
                while len(self._open) > k:
                    self._close()
                return

    def _close(self) -> None:
        tag, first, content = self._open.pop()
        self._count[tag] -= 1
        self._hidden -= tag in HIDDEN
        if tag not in INLINE and not self._hidden and tag not in HIDDEN:
            self.chunks.append("\n")
        if content:
            digest = xxhash.xxh64_intdigest("\n".join([tag, *content]))
            self._open[-1][2].append(f"\0{digest:x}")
            if tag not in INLINE and tag not in ("html", "body"):
                self.elements.append((first, len(self.chunks), digest))

    def text(self, templates: frozenset | set | None = None) -> tuple[str, int, int]:
        """Text without the largest subtrees among the templates, how many were deleted, and their visible characters."""
        return text_of(self.chunks, self.elements, templates)


def text_of(chunks: list[str], elements: list[tuple[int, int, int]], templates: frozenset | set | None = None) -> tuple[str, int, int]:
    """The same of a page's chunks and elements."""
    kept, deleted, chars, at = [], 0, 0, 0
    if templates:
        # Outer elements come first, so what lies inside a deleted one is skipped.
        for first, end, digest in sorted((e for e in elements if e[2] in templates), key=lambda e: (e[0], -e[1])):
            if first >= at:
                kept += chunks[at:first]
                kept.append("\n")
                chars += sum(len(c) for c in chunks[first:end] if c != "\n")
                deleted += 1
                at = end
    kept += chunks[at:]
    lines = (_SPACES.sub(" ", x).strip() for x in "".join(kept).split("\n"))
    return "\n".join(x for x in lines if x), deleted, chars


def _salted(hosts: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """A template's key: its host's hash and its own."""
    x = (hosts ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) ^ digests


#: A page as it is read: its chunks between NULs, and each element's first and last chunk and digest.
_READ = "row long, page_id long, host string, key long, root long, chunks string, firsts array<int>, ends array<int>, digests array<long>"


@trimmed
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lists = pa.list_(pa.int32())
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            pages = [None if h is None else Page(h.replace("\0", "\ufffd")) for h in part.column(4).to_pylist()]
            roots = pa.array([None if p is None else p.root - (1 << 64 if p.root >> 63 else 0) for p in pages], pa.int64())
            elements = [np.array(p.elements if p else [], dtype=object).reshape(-1, 3) for p in pages]
            digests = [e[:, 2].astype(np.uint64).view(np.int64) for e in elements]
            columns = [roots, pa.array([p and "\0".join(p.chunks) for p in pages], pa.string()), pa.array([e[:, 0].astype(np.int32) for e in elements], lists), pa.array([e[:, 1].astype(np.int32) for e in elements], lists), pa.array(digests, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], *columns], names=["row", "page_id", "host", "key", "root", "chunks", "firsts", "ends", "digests"])


def _pages(pages: DataFrame, url: str, html: str, page_id: str | None) -> DataFrame:
    """The pages, each read once, as a table of their visible text and the digests of their elements."""
    h = host(F.col(url).cast("string"))
    own = F.col(page_id).cast("long") if page_id else F.lit(None).cast("long")
    rows = tuned(pages).select(F.monotonically_increasing_id().alias("row"), own.alias("page_id"), h.alias("host"), F.xxhash64(h).alias("key"), F.col(html).cast("string").alias("html"))
    return stored(rows.mapInArrow(_read, _READ), "pages")


def _counted(read: DataFrame, least_pages: int, least_share: float) -> DataFrame:
    known = read.filter("host is not null and root is not null and chunks <> ''").select(F.col("key").alias("host"), F.col("root").alias("page"), "digests")
    # Pages of a host with the same content count as one; only their hashes are compared.
    seen = known.select("host", "page", F.explode(F.array_distinct("digests")).alias("subtree")).distinct()
    counts = seen.groupBy("host", "subtree").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages)
    total = known.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    return counts.join(total, "host").filter(F.col("n") >= F.col("pages") * least_share).select("host", "subtree", "n", "pages")


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, url: str = "url", html: str = "html") -> DataFrame:
    """(host, subtree, n, pages): by the hash of a host, the subtrees on many of its different pages.

    Pages of a host with the same content count as one. Tasks send hashes only.
    """
    return _counted(_pages(pages, url, html, None), least_pages, least_share)


def _texts(shared=None):
    """The pages' texts, without templates that are looked up in sorted keys, or given with each page."""

    @trimmed
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value if shared is not None else None
        for batch in batches:
            hosts = batch.column(2).fill_null(0).to_numpy().view(np.uint64)
            known = batch.column(1).is_valid().to_pylist()
            digests, offsets = batch.column(6).flatten().to_numpy().view(np.uint64), batch.column(6).offsets.to_numpy()
            offsets = offsets - offsets[0]
            if own is not None and len(own) and len(digests):
                key = _salted(np.repeat(hosts, np.diff(offsets)), digests)
                hit = own[np.minimum(np.searchsorted(own, key), len(own) - 1)] == key
            else:
                hit = np.zeros(len(digests), bool)
            given = batch.column(7).to_pylist() if own is None else None
            firsts, ends = (batch.column(k).flatten().to_numpy() for k in (4, 5))
            out = []
            for i, chunks in enumerate(batch.column(3).to_pylist()):
                if chunks is None:
                    out.append((None, 0, 0))
                    continue
                at = slice(offsets[i], offsets[i + 1])
                wanted = set(digests[at][hit[at]].tolist()) if given is None else set(np.array(given[i] or [], dtype=np.int64).view(np.uint64).tolist())
                elements = list(zip(firsts[at].tolist(), ends[at].tolist(), digests[at].tolist())) if wanted and known[i] else []
                out.append(text_of(chunks.split("\0"), elements, wanted if known[i] else None))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int64()))] if out else [pa.array([], t) for t in (pa.string(), pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["page_id", "host", "text", "deleted", "deleted_chars"])

    return texts


def page_texts(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, url: str = "url", html: str = "html", page_id: str = "page_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, host, text, deleted, deleted_chars): each page's text without its site's templates.

    Every block-level element's subtree is hashed; a subtree on at least 3 different pages of a
    host, however many it has, is a template of that host. The largest template subtrees of a page
    are deleted with all they hold, and the rest's visible text is returned, one line a block.
    Inline elements (links, emphasis and such) are only deleted as part of a block, so recurring
    words never go from a sentence. Scripts, styles, heads, comments and hidden elements give no text.

    Pages whose text is the same count once, so a page that is stored many times is not its own
    template. Hosts are compared in lower case, without port. A null html gives a null text, an empty one an
    empty text. A page whose URL is null or has no host has no site, so nothing is deleted. Rows
    are judged one by one, also repeated ones and those with a null page_id; an empty table gives
    an empty result. Extra columns are ignored. Broken markup is read leniently, and never fails.
    A page of any length is read whole, in memory of some times its size.

    Every page is read once; its visible text and its elements' digests are a table. Digests are
    counted by host and subtree, so a large host's are spread over all tasks, and html is never
    shuffled. The templates' keys go to all tasks if they take at most 64 MB; beyond that the
    pages' digests are joined with them, digest by digest, and each page gets those it has, with
    the same result.
    """
    spark = pages.sparkSession
    read = _pages(pages, url, html, page_id)
    found = stored(_counted(read, least_pages, least_share), "templates")
    schema = "page_id long, host string, text string, deleted int, deleted_chars long"
    columns = ["page_id", "host", "key", "chunks", "firsts", "ends", "digests"]
    if 16 * found.count() <= broadcast_bytes:
        table = found.select("host", "subtree").toArrow()
        keys = np.sort(_salted(table.column("host").to_numpy().view(np.uint64), table.column("subtree").to_numpy().view(np.uint64)))
        return read.select(columns).mapInArrow(_texts(spark.sparkContext.broadcast(keys)), schema)
    each = read.filter("host is not null").select("row", F.col("key").alias("host"), F.explode(F.array_distinct("digests")).alias("subtree"))
    own = each.join(found.select("host", "subtree"), ["host", "subtree"], "left_semi").groupBy("row").agg(F.collect_list("subtree").alias("_templates"))
    return read.join(own, "row", "left").select(*columns, "_templates").mapInArrow(_texts(), schema)
