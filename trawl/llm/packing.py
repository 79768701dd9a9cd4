"""Best-fit packing of documents into sequences by hierarchical residual rounds."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.arrowtext import trimmed
from trawl.llm.exchange import stored, tuned
from trawl.llm.tokens import Counter

#: Tokens of a sequence.
CAPACITY = 2048
#: A bin with at most this share of its capacity free is finished.
FREE = 0.01
#: Underfull bins that meet in one group of a merging round.
GROUP_BINS = 200_000
#: Without a tokenizer, tokens are words (runs of letters, digits and underscores, of any script) and single other visible characters.
TOKEN = r"(?U)\w+|[^\w\s]"
#: The vocabulary of the queries.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

_PIECES = [("docs", np.int64), ("starts", np.int64), ("sizes", np.int64)]
_BINS = "used long, full boolean, docs binary, starts binary, sizes binary"


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item: the largest first, each into the fullest bin that has room for it."""
    out = np.zeros(len(sizes), dtype=np.int64)
    room: list[int] = []  # free sizes that occur, ascending
    bins: dict[int, list[int]] = {}
    n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(room, size)
        if at == len(room):
            b, free = n, capacity
            n += 1
        else:
            free = room[at]
            b = bins[free].pop()
            if not bins[free]:
                del bins[free]
                room.pop(at)
        out[i] = b
        free -= size
        if free:
            if free not in bins:
                bins[free] = []
                insort(room, free)
            bins[free].append(b)
    return out


def _rows(bins: np.ndarray, columns: list[np.ndarray], capacity: int, finished: int) -> pa.RecordBatch:
    """One row a bin, its pieces packed."""
    order = np.argsort(bins, kind="stable")
    bins, columns = bins[order], [c[order] for c in columns]
    new = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]])) if len(bins) else np.zeros(0, np.int64)
    ends = np.append(new[1:], len(bins)) if len(new) else new
    used = np.add.reduceat(columns[2], new) if len(new) else new
    packed = [pa.array([c[a:b].tobytes() for a, b in zip(new, ends)], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(capacity - used <= finished), *packed], names=["used", "full", "docs", "starts", "sizes"])


def _local(capacity: int, finished: int):
    @trimmed
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes = [], []
        for batch in batches:
            ids.append(batch.column(0).to_numpy())
            sizes.append(batch.column(1).to_numpy())
        if not ids:
            return
        docs, tokens = np.concatenate(ids), np.concatenate(sizes)
        order = np.lexsort((docs, -tokens))
        docs, tokens = docs[order], tokens[order]
        pieces = -(-tokens // capacity)
        starts = (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
        docs, tokens = np.repeat(docs, pieces), np.repeat(tokens, pieces)
        sizes_ = np.minimum(tokens - starts, capacity)
        bins = best_fit(sizes_, capacity)
        # Bins leave in slices, so that a message stays small whatever the partition holds.
        order = np.argsort(bins, kind="stable")
        bins, columns = bins[order], [docs[order], starts[order], sizes_[order]]
        for lo in range(0, int(bins[-1]) + 1 if len(bins) else 0, 10_000):
            a, b = np.searchsorted(bins, [lo, lo + 10_000])
            yield _rows(bins[a:b], [c[a:b] for c in columns], capacity, finished)

    return local


def _merge(capacity: int, finished: int):
    @trimmed
    def merge(table: pa.Table) -> pa.Table:
        used = table.column("used").to_numpy()
        blobs = {n: table.column(n).to_pylist() for n, _ in _PIECES}
        order = np.lexsort(([int.from_bytes(d[:8], "little", signed=True) for d in blobs["docs"]], -used))
        used = used[order]
        bins = best_fit(used, capacity)
        held: list[list[int]] = [[] for _ in range(int(bins.max()) + 1 if len(bins) else 0)]
        for item, b in zip(order.tolist(), bins.tolist()):
            held[b].append(item)
        total = np.bincount(bins, weights=used, minlength=len(held)).astype(np.int64)
        return pa.table(
            {"used": pa.array(total), "full": pa.array(capacity - total <= finished)}
            | {n: pa.array([b"".join(blobs[n][i] for i in items) for items in held], pa.binary()) for n, _ in _PIECES}
        )

    return merge


def token_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n): tokens of each document, of the byte-level BPE whose ranks are in the file `tokenizer`, or else by TOKEN."""
    known = tuned(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null and text <> ''")
    if tokenizer is None:
        return known.select("doc_id", F.regexp_count("text", F.lit(TOKEN)).cast("long").alias("n"))
    with open(tokenizer, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary: some 1 MB

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter(batch.column(1)))], names=["doc_id", "n"])

    return known.mapInArrow(count, "doc_id long, n long")


@trimmed
def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each bin, numbered by task and row; a bin's id needs nothing but a place in the stored table."""
    task, row = TaskContext.get().partitionId(), 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 2_000):
            part = batch.slice(lo, 2_000)
            blobs = {n: [np.frombuffer(b, k) for b in part.column(n).to_pylist()] for n, k in _PIECES}
            counts = np.array([len(x) for x in blobs["docs"]], dtype=np.int64)
            docs, starts, sizes = (np.concatenate(blobs[n]) for n, _ in _PIECES)
            first = np.cumsum(counts) - counts
            before = np.cumsum(sizes) - sizes
            bins = (task << 40) + row + np.arange(part.num_rows)
            row += part.num_rows
            columns = [np.repeat(bins, counts), np.arange(len(docs)) - np.repeat(first, counts), docs, starts, sizes, before - np.repeat(before[first], counts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["bin_id", "item", "doc_id", "start", "n_tokens", "at"])


def packed(docs: DataFrame, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, group_bins: int = GROUP_BINS) -> DataFrame:
    """(bin_id, item, doc_id, start, n_tokens, at): the pieces of documents in each sequence of `capacity` tokens.

    A piece is n_tokens tokens of a document from its token `start`, placed at token `at` of its
    bin. Documents longer than a bin are cut into full pieces and a rest; a document that fits is
    never cut. Every token of every document is in exactly one bin, and no bin exceeds its capacity.

    Each partition best-fits its own pieces, largest first. Bins with at most 1 % free are
    finished. The others meet as items, some 200,000 in a group, and are best-fitted again, until
    one group is left. Best fit leaves at most one bin of a group half empty, and only half-empty
    bins can join others: so a round needs all of those, and of the bins with the same room no more
    than there are of those; the rest is finished, as it would stay as it is. Groups thus become
    few at any size. Only numbers travel, never texts, and each round is a table, so a lost
    executor repeats one round at most.

    Tokens are those of a byte-level BPE, if its rank file is given, else words and single marks.
    Documents without tokens (null, empty or blank texts) are in no bin. Rows with a null doc_id are
    left out. Rows that repeat a doc_id are packed each. Equal sizes go in order of doc_id. An
    empty table gives no bins. Extra columns are ignored. Bin ids are unique but not consecutive.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    finished = int(capacity * FREE)
    counted = token_counts(docs, text, doc_id, tokenizer).filter("n > 0")
    left = stored(counted.mapInArrow(_local(capacity, finished), _BINS), "bins")
    done, small = [], 2 * F.col("used") <= capacity
    while True:
        done.append(left.filter("full"))
        left = left.filter("not full")
        n_small = left.filter(small).count()
        if not n_small:
            break
        # Of the bins with equal room, as many as there are half-empty ones.
        nth = F.row_number().over(Window.partitionBy("used").orderBy(F.xxhash64("docs", "starts")))
        ranked = stored(left.withColumn("_keep", small | (nth <= n_small)), "residue")
        done.append(ranked.filter("not _keep").drop("_keep"))
        kept = ranked.filter("_keep").drop("_keep")
        groups = max(1, min(-(-kept.count() // group_bins), n_small // 2))  # each round at least halves the half-empty ones
        left = stored(kept.withColumn("slot", F.pmod(F.xxhash64("docs", "starts"), F.lit(groups))).groupBy("slot").applyInArrow(_merge(capacity, finished), _BINS), "bins")
        if groups == 1:
            break
    out = left
    for d in done:
        out = out.unionAll(d)
    return out.mapInArrow(_unpacked, "bin_id long, item long, doc_id long, start long, n_tokens long, at long")
