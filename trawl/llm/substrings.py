"""Passages that repeat across documents: hashes of stretches, sent to the slot of their winnowed anchor and matched by sorting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.arrowtext import SPACE, gram_hash, mix, parts, running, trimmed
from trawl.llm.exchange import by_slot, gathered, n_slots, slot_of, stored, tuned

#: Words that a repeat has at least, and words of an anchor.
LENGTH, ANCHOR = 50, 20


def _least_in_window(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i+width] for each i, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - have :]) if width > have else out


def _seeds(length: int, anchor: int, slots: int):
    @trimmed
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for i, _, p, ahead, _ in parts(batch.column(1), SPACE, most=1 << 20, overlap=length - 1):
                n = len(p.hashes) - length + 1
                if n <= 0:
                    continue
                total = running(p.hashes)
                # The anchor of a stretch of `length` words is its least anchor-gram: copies of the stretch choose the same.
                least = _least_in_window(gram_hash(p.hashes, anchor, total), length - anchor + 1)
                at = np.flatnonzero(p.rows[:n] == p.rows[length - 1 :])
                least, stretch = least[at], gram_hash(p.hashes, length, total)[at]
                first = np.concatenate([[0], np.cumsum(p.counts)])
                rows = p.rows[at]
                positions = (ahead + at - first[rows]).astype(np.int64)
                docs, hashes = ids[i + rows], texts[i + rows]
                # A seed: consecutive stretches of a document with the same anchor.
                new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (rows[1:] != rows[:-1])])) if len(at) else at
                sizes = np.diff(np.append(new, len(at)))
                slot = slot_of(least[new], slots)
                order = np.argsort(np.repeat(slot, sizes).astype(np.uint16 if slots <= 1 << 16 else np.int64), kind="stable")
                yield _blobs(slot, slots, least[new], docs[new], hashes[new], positions[new], sizes, (stretch >> np.uint64(32)).astype(np.uint32)[order])

    return seeds


def _blobs(slot, slots, anchors, docs, texts, positions, sizes, stretches) -> pa.RecordBatch:
    out = by_slot(slot, slots, [anchors, docs, texts, positions.astype(np.int32), sizes.astype(np.int32)], ["anchors", "docs", "texts", "positions", "sizes"])
    per = np.bincount(slot, weights=sizes, minlength=0)
    per = per[per > 0].astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(per)])
    return out.append_column("stretches", pa.array([np.ascontiguousarray(stretches[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()))


@trimmed
def _matched(table: pa.Table) -> pa.Table:
    """Runs of stretches that documents share: consecutive ones of a text that the same places have.

    `head` is a hash of the places of a run's first stretch and `tail` of those one word after its last:
    a run that begins with this head where the other ends continues it, at all its places.
    """
    anchors, docs, texts, positions, sizes = (gathered(table, n, d) for n, d in (("anchors", np.uint64), ("docs", np.int64), ("texts", np.int64), ("positions", np.int32), ("sizes", np.int32)))
    stretches = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(b, np.uint32) for b in table.column("stretches").to_pylist())])
    # Seeds whose anchor occurs once match nothing.
    order = np.argsort(anchors)
    same = anchors[order][1:] == anchors[order][:-1]
    shared = np.zeros(len(anchors), dtype=bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    stretches = stretches[np.repeat(shared, sizes)]
    anchors, docs, texts, positions, sizes = anchors[shared], docs[shared], texts[shared], positions[shared], sizes[shared]
    total = int(sizes.sum())
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    position = np.repeat(positions, sizes).astype(np.int64) + (np.arange(total) - first)
    doc, text = np.repeat(docs, sizes), np.repeat(texts, sizes)
    key = mix(np.repeat(anchors, sizes) + mix(stretches.astype(np.uint64)))
    order = np.lexsort((position, text, doc, key))
    key, doc, text, position = key[order], doc[order], text[order], position[order]
    # A row that is repeated whole has its places once.
    once = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (position[1:] != position[:-1])])[:total]
    key, doc, text, position = key[once], doc[once], text[once], position[once]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(key))).astype(np.int64)
    low, high = (doc[start], doc[start + count - 1]) if len(key) else (doc, doc)
    hit = np.repeat(low != high, count)
    # The least other document that has the stretch: of its least document, the next one.
    beyond = np.flatnonzero(np.concatenate([[False], (key[1:] == key[:-1]) & (doc[1:] != doc[:-1])])) if len(key) else start
    run = np.searchsorted(start, beyond, "right") - 1
    second, several = np.zeros(len(start), dtype=np.int64), np.bincount(run, minlength=len(start)) + 1
    second[run[::-1]] = doc[beyond[::-1]]
    other = np.where(doc == np.repeat(low, count), np.repeat(second, count), np.repeat(low, count))
    place = mix(doc.view(np.uint64)) + mix(text.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))
    here, after = (np.add.reduceat(mix(place + mix(position.view(np.uint64) + np.uint64(k))), start) if len(key) else key for k in (0, 1))
    here, after, n_docs = np.repeat(here, count)[hit], np.repeat(after, count)[hit], np.repeat(several, count)[hit]
    doc, text, position, other = doc[hit], text[hit], position[hit], other[hit]
    order = np.lexsort((position, text, doc))
    doc, text, position, other, here, after, n_docs = (x[order] for x in (doc, text, position, other, here, after, n_docs))
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (position[1:] != position[:-1] + 1) | (here[1:] != after[:-1])])[: len(doc)])
    ends = np.append(new[1:], len(doc))[: len(new)] - 1
    return pa.table({"doc_id": doc[new], "text": text[new], "s": position[new], "e": position[ends], "other": other[new], "n_docs": n_docs[new].astype(np.int64), "head": here[new].view(np.int64), "tail": after[ends].view(np.int64)})


def _runs(docs: DataFrame, length: int, anchor: int, text: str, doc_id: str) -> DataFrame:
    if not 0 < anchor <= length:
        raise ValueError("anchor must be between 1 and length")
    spark = docs.sparkSession
    known = tuned(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null")
    # A slot takes about two million stretches, and a stretch starts at most words: six bytes of text each.
    slots = n_slots(spark, (known.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6)
    seeds = known.withColumn("hash", F.xxhash64("text")).mapInArrow(_seeds(length, anchor, slots), "slot long, anchors binary, docs binary, texts binary, positions binary, sizes binary, stretches binary")
    found = seeds.groupBy("slot").applyInArrow(_matched, "doc_id long, text long, s long, e long, other long, n_docs long, head long, tail long")
    return stored(found, "stretches").withColumn("e", F.col("e") + length)


def passages(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start_word, end_word, n_words, other_doc, passage_id, n_docs): every occurrence of
    every distinct passage of at least `length` words that several documents have.

    A passage is a longest run of stretches of `length` words that all occur in the same places:
    where the set of documents changes, a new passage begins, overlapping the last by length - 1
    words, so nothing is merged and no partner is lost. Its occurrences, in all documents and also
    several in one, share its passage_id: the documents that have it are the rows of that id, one a
    place, so a passage of g documents takes g rows. n_docs counts them, and other_doc is the
    least one other than the row's. What two documents share on end is the union of the passages
    of both. Otherwise as `repeats`.
    """
    found = _runs(docs, length, anchor, text, doc_id)
    # Stretches of one run may have different anchors, thus slots: pieces are put together again.
    w = Window.partitionBy("doc_id", "text").orderBy("s")
    ahead = (F.col("s") == F.lag("e").over(w) - (length - 1)) & (F.col("head") == F.lag("tail").over(w))
    spans = found.withColumn("_new", (~F.coalesce(ahead, F.lit(False))).cast("int")).withColumn("_span", F.sum("_new").over(w)).groupBy("doc_id", "text", "_span")
    spans = spans.agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"), F.first("other").alias("other_doc"), F.min_by("head", "s").alias("passage_id"), F.first("n_docs").alias("n_docs"))
    return spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_doc", "passage_id", "n_docs")


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start_word, end_word, n_words, other_doc): the passages of at least `length` words
    that another document has too, overlapping ones of a document merged into one maximal span.

    Words are maximal runs without ASCII white space, compared byte by byte through 64-bit hashes;
    start_word counts from 0 and end_word is exclusive. A word belongs to a span exactly if some
    stretch of `length` words around it occurs in a document with another doc_id. other_doc is the
    least such document over the span. Repeats within one document alone don't count.

    Each stretch is hashed and goes to the slot of its least gram of `anchor` words (winnowing),
    which copies of the stretch choose alike; there equal hashes are matched by sorting, not in
    pairs: a passage shared by g documents costs work in proportion to g. `passages` gives the
    same words unmerged, with all partners.

    Null and empty texts and texts of fewer than `length` words have no repeats. Rows with a null
    doc_id are left out; rows that repeat a doc_id are the same document, so they don't match each
    other. Extra columns are ignored.
    """
    found = _runs(docs, length, anchor, text, doc_id)
    w = Window.partitionBy("doc_id").orderBy("s", "e")
    begins = F.coalesce(F.col("s") > F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    spans = found.withColumn("_new", begins.cast("int")).withColumn("_span", F.sum("_new").over(w)).groupBy("doc_id", "_span")
    spans = spans.agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"), F.min("other").alias("other_doc"))
    return spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_doc")
