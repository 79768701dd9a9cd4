"""Fuzzy line deduplication: MinHash candidates, exact Jaccard, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.arrowtext import BLOCK, NEWLINE, Pieces, buffers, gram_hash, mix, parts, slices, trimmed
from trawl.llm.components import components
from trawl.llm.exchange import by_slot, fresh, gathered, n_slots, release, slot_of, stored, tuned

#: Characters of a shingle, and the least Jaccard similarity of two lines' shingle sets.
SHINGLE, SIMILARITY = 5, 0.8
#: Lines of fewer characters are left alone: they repeat by chance.
LEAST_CHARS = 20
#: Lines of similarity 0.8 share a band with probability 0.99, of 0.3 with 0.011: what unrelated
#: lines add to the candidates grows with the square of the corpus, so it must be small.
BANDS, ROWS = 15, 6
#: Short lines are in further bands, of other six bins: their few shingles fill several bins, which makes bands alike (recall 0.996 with these).
MORE_BANDS = 6
#: Of the 48 bits of a long line's sketch, candidates of similarity 0.8 share 43.2 on average, and these with probability 0.999.
SKETCH_BITS, SKETCH_SAME = 48, 36
#: Lines of fewer shingles have a bitmap of their shingles in place of the sketch: sets differ in at
#: least as many elements as their bitmaps in bits, so it rules out only what can't be similar.
SHORT, SIZE_BITS = 100, 7
#: Longer runs of one band are joined to their least line, in one pass, instead of pair by pair.
PAIRWISE = 24
#: Text that is verified in one group, about; lines that share a band with the same line stay together.
GROUP_BYTES = 1 << 20
#: Candidate lines whose ids take at most this many bytes are looked up from a broadcast array, others by a join.
BROADCAST_BYTES = 16 << 20

_BINS = BANDS * ROWS
_MIXED = mix(np.arange(1, 0x10001, dtype=np.uint64))
_order = np.random.default_rng(20240301)
#: Where an empty bin looks for a value, try by try: anywhere, and at last in one bin after the other.
_DONORS = np.concatenate([[_order.permutation(_BINS) for _ in range(48)], (np.arange(_BINS) + np.arange(1, _BINS)[:, None]) % _BINS])
_MORE = np.stack([_order.permutation(_BINS)[:ROWS] for _ in range(MORE_BANDS)])


def _shingles(p: Pieces, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a slice's lines that are long enough, and wanted: which they are, their shingle hashes, and each shingle's line (counted among them)."""
    chars = p.chars()
    long = chars >= LEAST_CHARS
    if wanted is not None:
        long &= wanted
    raw = p.data.tobytes()
    codes = p.data if raw.isascii() else np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    codes = codes[codes != 10]
    codes = codes[np.repeat(long, chars)]
    line = np.repeat(np.arange(int(long.sum()), dtype=np.int32), chars[long])
    n = max(0, len(codes) - SHINGLE + 1)
    inside = line[:n] == line[len(line) - n :]
    rare = np.flatnonzero(codes > 0xFFFF) if codes.itemsize > 1 else codes[:0]
    mixed = _MIXED.take(np.minimum(codes, 0xFFFF) if len(rare) else codes)
    if len(rare):
        mixed[rare] = mix(codes[rare].astype(np.uint64) + np.uint64(1))
    return np.flatnonzero(long), gram_hash(mixed, SHINGLE)[inside], line[:n][inside]


def minhash(shingles: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """One-permutation MinHash of n lines, a column each: the least hash in each bin.

    An empty bin takes the value of the first bin that has one in an order of its own, the same for
    all lines. Were it the next bin, a short line's bands would be made of one or two shingles, and
    unrelated lines would share them.
    """
    empty = np.uint64(1 << 63)
    sig = np.full(_BINS * n, empty, dtype=np.uint64)
    bins = ((shingles >> np.uint64(40)) * np.uint64(_BINS)) >> np.uint64(24)
    np.minimum.at(sig, bins.astype(np.int64) * n + line, shingles & np.uint64((1 << 40) - 1))
    bare = np.flatnonzero(sig >= empty)
    filled = []
    for donors in _DONORS:
        if not len(bare):
            break
        b, k = np.divmod(bare, n)
        value = sig[donors[b] * n + k]
        found = value < empty
        filled.append((bare[found], value[found]))
        bare = bare[~found]
    for at, value in filled:  # at the end, so that only bins with shingles of their own give
        sig[at] = value
    return sig.reshape(_BINS, n)


def _line_hash(p: Pieces, which: np.ndarray) -> np.ndarray:
    return p.hashes[which].view(np.int64)


def _sketches(sig: np.ndarray, shingles: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """A word a line: of short ones the number of shingles and a bitmap of them, of others zero and bits of the minima."""
    base = np.uint64(0x9E3779B97F4A7C15)
    size = np.bincount(line, minlength=n)
    # One bit of each of 48 minima: equal minima give equal bits, others do half of the time.
    out, short = np.zeros(n, dtype=np.uint64), size < SHORT
    many, few = np.flatnonzero(~short), np.flatnonzero(short & (size > 0))
    bits = (sig[:SKETCH_BITS, many] * base >> np.uint64(63)) << np.arange(SKETCH_BITS, dtype=np.uint64)[:, None]
    out[many] = np.bitwise_or.reduce(bits, axis=0) << np.uint64(SIZE_BITS)
    if len(few):
        bit = np.uint64(1) << (((shingles[short[line]] >> np.uint64(32)) * np.uint64(64 - SIZE_BITS)) >> np.uint64(32))
        bitmap = np.bitwise_or.reduceat(bit, np.cumsum(size[few]) - size[few])
        out[few] = (bitmap << np.uint64(SIZE_BITS)) | size[few].astype(np.uint64)
    return out


def _possible(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether lines with these sketches can be similar: for two short ones a bound, for two long ones with probability 0.999; a short and a long one always."""
    low = np.uint64((1 << SIZE_BITS) - 1)
    n, m = (a & low).astype(np.int64), (b & low).astype(np.int64)
    apart = np.bitwise_count((a ^ b) >> np.uint64(SIZE_BITS))
    short = (n > 0) & (m > 0)
    most = np.where(short, (1 - similarity) / (1 + similarity) * (n + m) + 1e-9, SKETCH_BITS - SKETCH_SAME)
    return (apart <= most) | ((n > 0) != (m > 0))


#: Entries that a task gathers before it sends them, so that a slot's blobs hold many.
_SENT = 500_000
#: Entries of a slot, estimated; more in fewer slots, as the rows of blobs are lots times slots.
_SLOT = 800_000
#: Different lines that a task knows, so that it sends repeated ones once.
_KNOWN = 200_000


def _keys(sig: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bands' keys and the lines that have them; short ones have more."""
    n, base = sig.shape[1], np.uint64(0x9E3779B97F4A7C15)
    key = np.repeat(np.arange(BANDS, dtype=np.uint64), n).reshape(BANDS, n)
    more = np.repeat(np.arange(BANDS, BANDS + MORE_BANDS, dtype=np.uint64), len(short)).reshape(MORE_BANDS, len(short))
    few = sig[:, short]
    for r in range(ROWS):
        key = mix(key * base + sig[r::ROWS])
        more = mix(more * base + few[_MORE[:, r]])
    return np.concatenate([key.ravel(), more.ravel()]), np.concatenate([np.tile(np.arange(n), BANDS), np.tile(short, MORE_BANDS)])


def _bands(slots: int):
    @trimmed
    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        known: set[int] = set()

        def new(lines: np.ndarray) -> np.ndarray:
            out = np.ones(len(lines), dtype=bool)
            for k, x in enumerate(lines.tolist()):
                if x in known:
                    out[k] = False
                elif len(known) < _KNOWN:
                    known.add(x)
            return out

        def sent() -> pa.RecordBatch:
            key, refs, sketch = (np.concatenate(x) for x in zip(*held))
            held.clear()
            # Within a slot 32 bits of a key tell bands apart; in their order they pack to half of that.
            slot, key = slot_of(key, slots), key.astype(np.uint32)
            order = np.argsort(key)
            return by_slot(slot[order], slots, [key[order], refs[order], sketch[order]], ["keys", "refs", "sketches"])

        for batch in batches:
            for _, _, p, _, _ in parts(batch.column(0), NEWLINE, BLOCK, lower=True):
                which, shingles, line = _shingles(p, new(p.hashes))
                if not len(which):
                    continue
                sig = minhash(shingles, line, len(which))
                sketch = _sketches(sig, shingles, line, len(which))
                key, of = _keys(sig, np.flatnonzero(sketch & np.uint64((1 << SIZE_BITS) - 1)))
                held.append((key, _line_hash(p, which)[of], sketch[of]))
                if sum(len(k) for k, _, _ in held) >= _SENT:
                    yield sent()
        if held:
            yield sent()

    return bands


def _blocks(similarity: float):
    @trimmed
    def blocks(table: pa.Table) -> pa.Table:
        """(head, line): lines that share a band and whose sketches allow for the similarity, by the least line they match.

        Every such pair is together in the rows of some head: either both lines have the same least
        match, or one is the other's, or the pair has a row of its own. Long runs go to their least
        line as a whole. The head itself is one of its lines.
        """
        keys, refs, sketch = gathered(table, "keys", np.uint32), gathered(table, "refs", np.int64), gathered(table, "sketches", np.uint64)
        order = np.argsort(keys)
        keys, refs, sketch = keys[order], refs[order], sketch[order]
        length = np.diff(np.append(_firsts(keys), len(keys)))
        some = np.repeat(length > 1, length)
        keys, refs, sketch = keys[some], refs[some], sketch[some]
        order = np.lexsort((refs, keys))
        keys, refs, sketch = keys[order], refs[order], sketch[order]
        fresh = np.ones(len(keys), dtype=bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (refs[1:] != refs[:-1])
        keys, refs, sketch = keys[fresh], refs[fresh], sketch[fresh]
        start = _firsts(keys)
        length = np.diff(np.append(start, len(keys)))
        first, many = np.repeat(start, length), np.repeat(length > PAIRWISE, length)
        long = np.flatnonzero(many & (first != np.arange(len(keys))))
        at = np.flatnonzero(~many & np.repeat(length > 1, length)).astype(np.int32)
        own, bits, line = keys[at], sketch[at], refs[at]
        least = np.arange(len(at), dtype=np.int32)
        x, y = [at[:0]], [at[:0]]
        for d in range(1, PAIRWISE):
            same = np.flatnonzero(own[d:] == own[:-d]).astype(np.int32) if len(own) > d else at[:0]
            if not len(same):
                break
            same = same[_possible(bits[same], bits[same + d], similarity)]
            np.minimum.at(least, same + d, same)
            x.append(same)
            y.append((same + d).astype(np.int32))
        pairs = [np.stack([refs[first[long]], refs[long]], axis=1)]
        for a, b in zip(x, y):  # distance by distance, so that only what is needed is held
            needed = (least[b] == a) | (least[a] != least[b])
            pairs.append(np.stack([line[a[needed]], line[b[needed]]], axis=1))
        pairs = np.concatenate(pairs)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)])[: len(pairs)]]
        heads = pairs[_firsts(pairs[:, 0]), 0]
        return pa.table({"head": pa.array(np.concatenate([heads, pairs[:, 0]])), "line": pa.array(np.concatenate([heads, pairs[:, 1]]))})

    return blocks


def _firsts(groups: np.ndarray) -> np.ndarray:
    """Places of the first element of each run."""
    return np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.zeros(0, np.int64)


def _verify(similarity: float):
    """Edges that join, within each block, all lines that are joined by pairs whose shingle sets are similar enough.

    A breadth-first search over all blocks of a slot at once: in each round every block takes one
    line of its queue (or a new one) and compares it with all its lines that aren't reached yet.
    """

    @trimmed
    def verify(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("head", "ascending"), ("line", "ascending")]))
        heads, refs = table.column("head").to_numpy(), table.column("line").to_numpy()
        block = np.zeros(len(heads), dtype=np.int64)
        block[1:] = np.cumsum(heads[1:] != heads[:-1])
        data, offsets = buffers(table.column("text"))
        bits = np.uint64(64 - max(1, int(block[-1] + 1 if len(block) else 1).bit_length()))
        keys, sizes = [], [np.zeros(0, np.int64)]
        for i, j in slices(offsets, BLOCK):
            # The lower-cased line without its end: exactly what the hashes were taken of.
            p = Pieces(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], NEWLINE, with_hash=False)
            _, shingles, line = _shingles(p)
            # A line's number and the upper 44 bits of a shingle in one integer: sorted, they are the lines' sets.
            own = np.sort((line.astype(np.uint64) << np.uint64(44)) | (shingles >> np.uint64(20)))
            own = own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
            line = (own >> np.uint64(44)).astype(np.int64)
            own = (own & np.uint64((1 << 44) - 1)) >> np.uint64(max(0, 44 - int(bits)))
            keys.append((block[i + line].astype(np.uint64) << bits) | own)
            sizes.append(np.bincount(line, minlength=j - i))
        key, sizes = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate(sizes)
        row = np.repeat(np.arange(len(refs), dtype=np.int32), sizes)
        all_keys, begin = key, np.cumsum(sizes) - sizes
        left, queue = np.ones(len(refs), dtype=bool), np.zeros(0, dtype=np.int64)
        node_of = np.full(int(block[-1]) + 1 if len(block) else 0, -1)
        a, b = [refs[:0]], [refs[:0]]
        while left.any():
            at = np.flatnonzero(left)
            first = at[_firsts(block[at])]
            node_of[:] = -1
            node_of[block[first]] = first
            queue = queue[node_of[block[queue]] >= 0]
            first = queue[_firsts(block[queue])]
            node_of[block[first]] = first
            queue = queue[node_of[block[queue]] != queue]
            nodes = node_of[node_of >= 0]
            left[nodes] = False
            n = sizes[nodes]
            chosen = all_keys[np.repeat(begin[nodes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]  # in order, as the blocks are
            alive = left[row]
            key, row = key[alive], row[alive]
            hit = chosen[np.minimum(np.searchsorted(chosen, key), len(chosen) - 1)] == key
            both = np.bincount(row[hit], minlength=len(refs))
            node = node_of[block]
            near = np.flatnonzero(left & (both >= similarity * (sizes + sizes[node] - both) - 1e-9))
            left[near] = False
            queue = np.sort(np.concatenate([queue, near]))
            a.append(refs[node[near]])
            b.append(refs[near])
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    return verify


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, text) of the wanted lines, each once."""
    spark, n = docs.sparkSession, wanted.count()
    few = 8 * n <= BROADCAST_BYTES
    ids = np.sort(wanted.toArrow().column(0).to_numpy()) if few else np.zeros(0, np.int64)
    shared = spark.sparkContext.broadcast(ids)

    @trimmed
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value
        for batch in batches:
            for _, _, p, _, _ in parts(batch.column(0), NEWLINE, lower=True):
                which = np.flatnonzero(p.chars() >= LEAST_CHARS)
                line, first = np.unique(_line_hash(p, which), return_index=True)
                which = which[first]
                if few and len(ids):
                    hit = ids[np.minimum(np.searchsorted(ids, line), len(ids) - 1)] == line
                    line, which = line[hit], which[hit]
                elif few:
                    continue
                raw = p.data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(line), pa.array([raw[a:b] for a, b in zip(p.starts[which], p.ends[which])], pa.binary()).cast(pa.string())], names=["line", "text"])

    found = docs.select("text").mapInArrow(texts, "line long, text string")
    return found if few else found.join(wanted, "line", "left_semi")


def similar_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of the lines, by hash, that are joined to another line by exact Jaccard similarities."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = n_slots(spark, size / 200 * BANDS, _SLOT)
    found = docs.select("text").mapInArrow(_bands(slots), "slot long, keys binary, refs binary, sketches binary").groupBy("slot").applyInArrow(_blocks(similarity), "head long, line long")
    members = stored(found.distinct(), "members")
    texts = _texts(docs, members.select("line").distinct()).groupBy("line").agg(F.first("text").alias("text"))
    groups = n_slots(spark, 2 * size, GROUP_BYTES)
    verify = members.join(texts, "line").withColumn("slot", F.pmod(F.xxhash64("head"), F.lit(groups))).groupBy("slot").applyInArrow(_verify(similarity), "a long, b long")
    roots = components(verify)
    release(members)
    return roots


@trimmed
def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, before = batch.column(0).to_numpy(), 0
        for i, _, p, _, whole in parts(batch.column(1), NEWLINE, lower=True):
            which = np.flatnonzero(p.chars() >= LEAST_CHARS)
            feeds = np.concatenate([[0], np.cumsum(p.data == 10, dtype=np.int32)])
            rows = p.rows[which]
            yield pa.RecordBatch.from_arrays([pa.array(_line_hash(p, which)), pa.array(ids[i + rows]), pa.array(before + feeds[p.starts[which]] - feeds[p.offsets[rows]], pa.int32())], names=["line", "doc_id", "line_no"])
            before = 0 if whole else before + int(feeds[-1])  # lines of the parts of a long text are counted on


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, line_no, kept_doc, kept_line): every line that repeats another one, with the line kept for it.

    Of each component of similar lines the first by (doc_id, line_no) is kept. line_no counts the
    pieces between line feeds from 0.
    """
    known = tuned(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null")
    roots = similar_lines(known, similarity)
    lines = known.mapInArrow(_occurrences, "line long, doc_id long, line_no int")
    lines = lines.join(roots, lines["line"] == roots["node"], "left").select(F.coalesce("root", "line").alias("root"), F.struct("doc_id", "line_no").alias("at"))
    first = lines.groupBy("root").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1")
    gone = lines.join(first, "root").filter("at <> first").select("at.doc_id", "at.line_no", F.col("first.doc_id").alias("kept_doc"), F.col("first.line_no").alias("kept_line"))
    return gone


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents with repeated lines taken out of the text, and lines_removed.

    Lines are the pieces between line feeds, lower-cased for comparison. Two lines are similar if
    the Jaccard similarity of their sets of 5-character shingles is at least 0.8. Candidates share
    one of fifteen bands of six values of a one-permutation MinHash (recall 0.99 at the threshold) and
    agree in a sketch of 48 bits, every candidate is verified on its exact shingles, and of each connected component of similar
    lines the first by (doc_id, line_no) stays, all over the corpus.

    Lines of fewer than 20 characters stay. Null texts stay null and empty ones empty; a text all
    of whose lines repeat others becomes empty. Rows with a null doc_id stay as they are. Rows
    that repeat a doc_id are one document: the same line_no of theirs counts as one line. Other
    columns are kept; an own column named lines_removed is replaced.
    """
    columns = [c for c in docs.columns if c != "lines_removed"]
    gone = repeated_lines(docs, similarity, text, doc_id).groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias(fresh("_gone", columns)))
    key = fresh("_gone_id", columns)
    kinds = docs.select(columns).schema
    at = columns.index(text)

    @trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            gone = batch.column(batch.num_columns - 1)
            for lo in range(0, batch.num_rows, 500):
                part = []
                for t, g in zip(column.slice(lo, 500).to_pylist(), gone.slice(lo, 500).to_pylist()):
                    if t is not None and g:
                        drop = set(g)
                        t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop)
                    part.append(t)
                columns_ = [c.slice(lo, 500) for c in batch.columns[:-1]]
                columns_[at] = pa.array(part, pa.string())
                removed = pc.fill_null(pc.list_value_length(gone.slice(lo, 500)), 0).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([*columns_, removed], names=[*batch.schema.names[:-1], "lines_removed"])

    gone = gone.withColumnRenamed("doc_id", key).hint("shuffle_hash")
    joined = docs.select(columns).join(gone, F.col(doc_id).cast("long") == F.col(key), "left").drop(key)
    return joined.mapInArrow(cut, kinds.add("lines_removed", T.IntegerType()))
