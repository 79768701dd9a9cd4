"""Benchmark decontamination through a distributed positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.arrowtext import PUNCT, parts, pieces, trimmed
from trawl.llm.exchange import pack, release, stored, tuned, unpack

#: Words of a phrase that no training text may share with a test item; shorter items are matched whole.
PHRASE = 13
#: Items of fewer words are only matched whole and word by word, and marked: they are found in many innocent texts.
LEAST_WORDS = 8
#: In a proximity match this share of an item's words stand within SLOP places of where they should.
SHARE, SLOP = 0.8, 3
#: Places between two documents of an index segment; more than twice the slop, so nothing matches across.
GAP = 16
#: Bytes of text of an index segment. Longer texts are cut into several, which overlap by more than the longest item.
SEGMENT_BYTES = 1 << 20
#: Test items are searched in chunks of so many words, one pass over the index each.
CHUNK_WORDS = 2_000_000
#: Places that are compared at a time.
_STEP = 400_000

_INDEX = "docs binary, bases binary, starts binary, ends binary, terms binary, sizes binary, postings binary"
_KINDS = {"docs": np.int64, "bases": np.int64, "starts": np.int32, "ends": np.int32, "terms": np.uint64, "sizes": np.int32, "postings": np.int32}


def _segments(overlap: int):
    @trimmed
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, j, p, base, _ in parts(batch.column(1), PUNCT, most=SEGMENT_BYTES, lower=True, overlap=overlap):
                starts = np.cumsum(p.counts) - p.counts + np.arange(j - i) * GAP
                places = (np.arange(len(p.rows)) + p.rows * GAP).astype(np.int32)
                order = np.argsort(p.hashes, kind="stable")
                terms = p.hashes[order]
                new = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
                steps = np.diff(places[order], prepend=np.int32(0)).astype(np.int32)
                columns = [ids[i:j], np.full(j - i, base), starts, starts + p.counts, terms[new], np.diff(np.append(new, len(terms))), steps]
                yield pa.RecordBatch.from_arrays([pa.array([pack(c.astype(k))], pa.binary()) for c, k in zip(columns, _KINDS.values())], names=list(_KINDS))

    return segments


def positional_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", overlap: int = 0) -> DataFrame:
    """The index as a table: one row per segment of some 1 MB of texts, with its documents, their
    first and last places, its terms in order of their hashes, and each term's ascending places.

    Segments hold whole documents, or parts of a longer one that share `overlap` words with the
    next (`bases` counts the words before), so the index is built without a shuffle, and every
    match of so many words can be decided within one segment.
    """
    known = tuned(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null")
    return stored(known.mapInArrow(_segments(overlap), _INDEX), "index")


def _ragged(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of integers that begin at `first`: all of them in order, and the range of each."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes), owner


class Tests:
    """Test items as one array of words, with what to look for and in which order; the same for all segments.

    Rarity is that of the whole corpus. Of each phrase of n words the rarest anchors it; a
    proximity match lacks at most m - need of m words, so it has one of the m - need + 1 rarest.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], counts: dict[int, int], phrase: int, share: float):
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.sizes = np.array([len(t) for _, t in items], dtype=np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        words = np.concatenate([np.zeros(0, np.uint64), *(t for _, t in items)])
        self.terms, self.word = np.unique(words, return_inverse=True)
        total = np.array([counts.get(int(t), 0) for t in self.terms.view(np.int64)], dtype=np.int64)
        self.phrase = np.minimum(phrase, self.sizes)
        self.need = np.where(self.sizes < LEAST_WORDS, self.sizes + 1, np.ceil(share * self.sizes - 1e-9).astype(np.int64))
        owner = np.repeat(np.arange(len(items)), self.sizes)
        offset = np.arange(len(words)) - self.first[owner]
        #: Offsets of each item, its rarest words first.
        self.order = offset[np.lexsort((offset, total[self.word], owner))]
        anchors = []
        for k, (f, m, n) in enumerate(zip(self.first, self.sizes, self.phrase)):
            if n:
                windows = np.lib.stride_tricks.sliding_window_view(total[self.word[f : f + m]], n)
                found = np.unique(windows.argmin(axis=1) + np.arange(m - n + 1))
                anchors.append(np.stack([np.full(len(found), k), found], axis=1))
        self.anchors = np.concatenate(anchors) if anchors else np.zeros((0, 2), np.int64)


class _Segment:
    def __init__(self, row: dict):
        for name, kind in _KINDS.items():
            setattr(self, name, unpack(row[name], kind))
        self.places = np.cumsum(self.postings, dtype=np.int64)
        self.begin = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        # A term's number and a place in one integer: in order, so that all lists are searched as one.
        self.keys = (np.repeat(np.arange(len(self.terms)), self.sizes) << 32) | self.places

    def seek(self, tests: Tests) -> None:
        """Finds all terms of the tests at once: the number of each here, or -1."""
        at = np.minimum(np.searchsorted(self.terms, tests.terms), max(0, len(self.terms) - 1))
        here = self.terms[at] == tests.terms if len(self.terms) else np.zeros(len(tests.terms), bool)
        self.number = np.where(here, at, -1)[tests.word]

    def has(self, number: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = (number << 32) | place
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (number >= 0) & (place >= 0) & (self.keys[at] == key)

    def near(self, number: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a term stands in a range of places."""
        at = np.searchsorted(self.keys, (number << 32) | low)
        key = self.keys[np.minimum(at, len(self.keys) - 1)]
        return (number >= 0) & (low <= high) & (at < len(self.keys)) & (key >> 32 == number) & (key & 0xFFFFFFFF <= high)

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, "right") - 1

    def exact(self, t: Tests) -> list[tuple[np.ndarray, ...]]:
        """(item, document, start place, words) of the longest runs around the anchors of phrases."""
        item, offset = t.anchors[:, 0], t.anchors[:, 1]
        number = self.number[t.first[item] + offset]
        # An anchor counts if the words on one side of it at least are here.
        left, right = (np.where((o >= 0) & (o < t.sizes[item]), self.number[np.clip(t.first[item] + o, 0, len(self.number) - 1)], -1) for o in (offset - 1, offset + 1))
        ok = np.flatnonzero((number >= 0) & ((t.phrase[item] == 1) | (left >= 0) | (right >= 0)))
        out = []
        sizes = np.cumsum(self.sizes[number[ok]])
        for lo, hi in _steps(sizes):
            own = ok[lo:hi]
            at, k = _ragged(self.begin[number[own]], self.sizes[number[own]].astype(np.int64))
            k = own[k]
            start = self.places[at] - offset[k]
            beside = self.has(left[k], start + offset[k] - 1) | self.has(right[k], start + offset[k] + 1) | (t.phrase[item[k]] == 1)
            start, k = start[beside], k[beside]
            for a, b in _steps(np.cumsum(t.sizes[item[k]])):
                out.append(self._runs(t, item[k[a:b]], offset[k[a:b]], start[a:b]))
        return out

    def _runs(self, t: Tests, item, offset, start) -> tuple[np.ndarray, ...]:
        m = t.sizes[item]
        word, row = _ragged(t.first[item], m)
        o = word - t.first[item][row]
        place = start[row] + o
        doc = self.document(start + offset)
        hit = self.has(self.number[word], place) & (place >= self.starts[doc][row]) & (place < self.ends[doc][row])
        # Length of the run of hits that ends at each word, begun anew with each row.
        index = np.arange(len(hit))
        last = np.maximum.accumulate(np.where(~hit | (o == 0), index - hit, -1))
        run = np.where(hit, index - last, 0)
        first = np.cumsum(m) - m
        most = np.maximum.reduceat(run, first) if len(run) else run
        best = np.full(len(m), len(run))
        at = np.flatnonzero(run == most[row])[::-1]
        best[row[at]] = at
        good = np.flatnonzero(most >= t.phrase[item])
        begins = place[best[good]] - most[good] + 1
        return item[good], doc[good], begins, most[good], np.ones(len(good), bool)

    def proximate(self, t: Tests, slop: int) -> list[tuple[np.ndarray, ...]]:
        """The same of items most of whose words stand about where they should: rarest words first, given up as soon as too few are left."""
        present = np.add.reduceat(self.number >= 0, t.first) if len(self.number) else np.zeros(len(t.ids), np.int64)
        able = np.flatnonzero(present >= t.need)
        if not len(able):
            return []
        # The rarest words one of which a match must have.
        rank, k = _ragged(t.first[able], t.sizes[able] - t.need[able] + 1)
        item, offset = able[k], t.order[rank]
        number = self.number[t.first[item] + offset]
        ok = np.flatnonzero(number >= 0)
        item, offset, number = item[ok], offset[ok], number[ok]
        shift, out = np.arange(-slop, slop + 1), []
        # Whole items at a time, so that each start is looked at once.
        weight = np.cumsum(self.sizes[number].astype(np.int64) * len(shift))
        last = np.append(np.flatnonzero(item[1:] != item[:-1]), len(item) - 1) if len(item) else item
        for lo, hi in _steps(weight[last]):
            own = slice(last[lo - 1] + 1 if lo else 0, last[hi - 1] + 1)
            at, k = _ragged(self.begin[number[own]], self.sizes[number[own]].astype(np.int64))
            who, place = item[own][k], self.places[at]
            doc, start = self.document(place), place - offset[own][k]
            both = np.stack([np.repeat(who, len(shift)), np.repeat(doc, len(shift)), (start[:, None] + shift).ravel()])
            both = both[:, np.lexsort(both[::-1])]
            new = np.concatenate([[True], (both[:, 1:] != both[:, :-1]).any(axis=0)])[: both.shape[1]]
            out.append(self._counted(t, *both[:, new], slop))
        return out

    def _counted(self, t: Tests, item, doc, start, slop: int) -> tuple[np.ndarray, ...]:
        lo, hi = self.starts[doc].astype(np.int64), self.ends[doc].astype(np.int64) - 1
        found, done = np.zeros(len(item), dtype=np.int64), []
        for k in range(int(t.sizes[item].max()) if len(item) else 0):
            more = k < t.sizes[item]
            o = t.order[t.first[item] + np.minimum(k, t.sizes[item] - 1)]
            at = start + o
            found += more & self.near(self.number[t.first[item] + o], np.maximum(at - slop, lo), np.minimum(at + slop, hi))
            left = np.maximum(t.sizes[item] - 1 - k, 0)
            alive, ended = found + left >= t.need[item], ~more | (left == 0)
            if (alive & ended).any():
                done.append((item[alive & ended], doc[alive & ended], start[alive & ended], found[alive & ended]))
            alive &= ~ended
            if not alive.all():
                item, doc, start, lo, hi, found = (x[alive] for x in (item, doc, start, lo, hi, found))
                if not len(item):
                    break
        if not done:
            none = np.zeros(0, np.int64)
            return none, none, none, none, np.zeros(0, bool)
        item, doc, start, found = (np.concatenate(x) for x in zip(*done))
        best = np.lexsort((start, -found, doc, item))
        item, doc, start, found = item[best], doc[best], start[best], found[best]
        new = np.concatenate([[True], (item[1:] != item[:-1]) | (doc[1:] != doc[:-1])])
        item, doc, start, found = item[new], doc[new], start[new], found[new]
        return item, doc, np.maximum(start, self.starts[doc]), found, np.zeros(len(item), bool)


def _steps(cumulative: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges whose weights, given as running sums, come to _STEP each, or to one element's."""
    i = 0
    while i < len(cumulative):
        before = cumulative[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(cumulative, before + _STEP, "right")))
        yield i, j
        i = j


@trimmed
def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [p.counts for _, _, p in pieces(batch.column(0), PUNCT, lower=True, with_hash=False)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *words]).astype(np.int64))], names=["n"])


def _items(tests: DataFrame, text: str, item_id: str) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Chunks of (item, its terms), read one after the other so that no chunk exceeds its bound."""
    held, words = [], 0
    rows = tests.select(F.col(item_id).cast("long"), F.col(text).cast("string")).dropna().distinct().toLocalIterator()
    for item, t in rows:
        for _, _, p in pieces(pa.array([t]), PUNCT, lower=True):
            if len(p.hashes):
                held.append((item, p.hashes))
                words += len(p.hashes)
        if words >= CHUNK_WORDS:
            yield held
            held, words = [], 0
    yield held


def _counts(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """How often each term occurs in the corpus, from the index; as many rows as terms of a chunk reach the driver."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, total = shared.value, None
        for batch in batches:
            total = np.zeros(len(terms), np.int64) if total is None else total
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own, sizes = unpack(a, np.uint64), unpack(b, np.int32)
                if len(own):
                    at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                    total += np.where(own[at] == terms, sizes[at], 0)
        if total is not None:
            has = total > 0
            yield pa.RecordBatch.from_arrays([pa.array(terms[has].view(np.int64)), pa.array(total[has])], names=["term", "n"])

    found = index.select("terms", "sizes").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    return dict(zip(found.column("term").to_pylist(), found.column("n").to_pylist()))


def contaminated(docs: DataFrame, tests: DataFrame, phrase: int = PHRASE, share: float = SHARE, slop: int = SLOP, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, kind, start_word, matched, words): the test items that documents contain.

    kind is `exact` if the document has a phrase of 13 consecutive words of the item (all of a
    shorter item), with the longest such run in `matched`; otherwise `near` if for some start at
    least 0.8 of the item's words occur within 3 places of where they belong, in `matched` the
    most that do. An item of fewer than 8 words is only matched whole, and its kind is `short`.
    Words are lower-cased runs of letters and digits (non-ASCII characters count as letters).
    start_word counts from 0; ties go to the earliest place.

    Postings of all training words are stored as a table of segments. All terms of the tests are
    looked up in a segment at once. Phrases start from the offset-adjusted places of their word
    that is rarest in the corpus, and proximity matches from those of as many rarest words as a
    match can't do without, so no match is lost; the other words' lists are intersected with
    these. Items are sent to the segments in chunks of bounded size.

    Null and empty texts match nothing, nor do items without words. Rows with a null id are left
    out; rows that repeat a doc_id or item_id give one row, of the best match. A text longer than
    a segment is indexed in parts that overlap by more than the longest item, so texts of any
    length are searched whole in bounded memory. Empty tables give an empty result. Extra columns
    are ignored.
    """
    spark = docs.sparkSession
    longest = tests.select(F.col(item_text).cast("string").alias("t")).filter("t is not null").mapInArrow(_item_words, "n long").agg(F.max("n")).first()[0] or 0
    index = positional_index(docs, text, doc_id, int(longest) + 2 * slop + 2)
    out = None
    for chunk in _items(tests, item_text, item_id):
        if not chunk and out is not None:
            break
        terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t for _, t in chunk)]))
        shared = spark.sparkContext.broadcast(Tests(chunk, _counts(index, terms), phrase, share))

        @trimmed
        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tests = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    segment = _Segment(batch.slice(i, 1).to_pylist()[0])
                    if not len(segment.keys) or not len(tests.ids):
                        continue
                    segment.seek(tests)
                    found = [np.concatenate(x) for x in zip(*segment.exact(tests), *segment.proximate(tests, slop))]
                    if found and len(found[0]):
                        item, doc, start, n, exact = found
                        columns = [segment.docs[doc], tests.ids[item], exact, segment.bases[doc] + start - segment.starts[doc], n, tests.sizes[item]]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "item_id", "exact", "start_word", "matched", "words"])

        part = stored(index.mapInArrow(search, "doc_id long, item_id long, exact boolean, start_word long, matched long, words long"), "matches")
        shared.destroy()
        out = part if out is None else out.unionAll(part)
    release(index)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("exact", "matched", (-F.col("start_word")).alias("start"), "words")).alias("b"))
    kind = F.when(F.col("b.words") < LEAST_WORDS, "short").when(F.col("b.exact"), "exact").otherwise("near")
    return best.select("doc_id", "item_id", kind.alias("kind"), (-F.col("b.start")).alias("start_word"), F.col("b.matched").alias("matched"), F.col("b.words").alias("words"))
