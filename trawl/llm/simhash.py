"""SimHash near-duplicate groups through signatures that agree in sampled bits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.arrowtext import PUNCT, Pieces, parts, trimmed
from trawl.llm.components import components
from trawl.llm.exchange import by_slot, gathered, n_slots, release, slot_of, stored, tuned

BITS = 256
#: Documents at most this many of the 256 bits apart are near duplicates.
DISTANCE = 40
#: Words are hashed with a sign into this many dimensions before the projection.
DIMENSIONS = 4096
#: Words of fewer bytes say little about a document; they count, but little.
LONG_WORD, SHORT_WEIGHT = 4, 0.05
#: Bits of a key, at least and at most. Between these they grow with the logarithm of the signatures, so that
#: each meets about as many unrelated ones under a key at every size.
LEAST_KEY, MOST_KEY = 20, 32
#: The chance that two signatures DISTANCE apart, by flips at random, agree in the bits of no table.
MISSED = 0.005
#: The tables are built in so many rounds, one after another, so that the disk holds the entries of one.
ROUNDS = 5
#: Signatures of a part of the table that is read in each round.
HEADS_A_PART = 20_000
#: Longer runs of one key are searched by themselves, others all at once.
PAIRWISE = 32
#: Pairs of a long run that are compared at once.
_AT_ONCE = 1 << 18

_signs = (np.random.default_rng(7).integers(0, 2, (DIMENSIONS, BITS)) * 2 - 1).astype(np.float32)


def _agreeing(key_bits: int, apart: int) -> float:
    """The chance that so many bits, drawn at random, are equal in two signatures that differ in `apart`."""
    return math.comb(BITS - apart, key_bits) / math.comb(BITS, key_bits)


def _tables(signatures: int, distance: int) -> np.ndarray:
    """The bits of each table's key for so many signatures, a row of places a table; BITS stands for none."""
    key_bits = min(MOST_KEY, max(LEAST_KEY, max(1, signatures - 1).bit_length() + 2))
    count = math.ceil(math.log(MISSED) / math.log1p(-_agreeing(key_bits, distance))) if distance else 1
    rng = np.random.default_rng(11)
    out = np.full((count, MOST_KEY), BITS)
    for row in out:
        row[:key_bits] = rng.permutation(BITS)[:key_bits]
    return out


def _projected(p: Pieces, rows: int) -> np.ndarray:
    """Sums of the words' weights over DIMENSIONS, projected on the bits, of a slice of texts; parts of one text add up."""
    out = np.zeros((rows, BITS), dtype=np.float64)
    weights = np.where(p.ends - p.starts >= LONG_WORD, 1.0, SHORT_WEIGHT) * np.where(p.hashes >> np.uint64(63), 1.0, -1.0)
    where = (p.hashes & np.uint64(DIMENSIONS - 1)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(p.counts)])
    for i in range(0, rows, 128):
        j = min(rows, i + 128)
        own = slice(first[i], first[j])
        x = np.bincount((p.rows[own] - i) * DIMENSIONS + where[own], weights=weights[own], minlength=(j - i) * DIMENSIONS)
        out[i:j] = x.astype(np.float32).reshape(j - i, DIMENSIONS) @ _signs
    return out


def signed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, s0, s1, s2, s3): signatures of the documents that have words."""

    @trimmed
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = np.zeros((1, BITS)), 0
        for batch in batches:
            for i, j, p, _, whole in parts(batch.column(1), PUNCT, lower=True):
                total, has = _projected(p, j - i), p.counts > 0
                if not whole or words:  # a part of a long text
                    held, words = held + total, words + len(p.hashes)
                    if not whole:
                        continue
                    total, has = held, np.array([words > 0])
                    held, words = np.zeros((1, BITS)), 0
                sig = np.packbits(total > 0, axis=1).view(">u8").astype(np.uint64)
                ids = batch.column(0).slice(i, j - i).filter(pa.array(has))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(sig[has, k].view(np.int64)) for k in range(4))], names=["doc_id", "s0", "s1", "s2", "s3"])

    known = tuned(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null")
    return known.mapInArrow(sign, "doc_id long, s0 long, s1 long, s2 long, s3 long")


def _index(slots: int, tables: np.ndarray):
    @trimmed
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4000):
                batch = whole.slice(i, 4000)
                sig = np.stack([batch.column(k).to_numpy().view(np.uint64) for k in range(1, 5)], axis=1)
                n, m = len(sig), len(tables)
                bits = np.zeros((n, BITS + 1), dtype=np.uint8)
                bits[:, :BITS] = np.unpackbits(sig.astype(">u8").view(np.uint8).reshape(n, -1), axis=1)
                keys = np.empty((m, n), dtype=np.uint64)
                for t, places in enumerate(tables):
                    keys[t] = np.packbits(bits[:, places].ravel()).view(">u4") | np.uint64(t << 32)
                keys = keys.ravel()
                # In order of the keys their upper bytes take next to no room in a blob.
                order = np.argsort(keys)
                keys, of = keys[order], order % n
                yield by_slot(slot_of(keys, slots), slots, [keys, batch.column(0).to_numpy()[of], *(sig[of, k] for k in range(4))], ["keys", "refs", "s0", "s1", "s2", "s3"])

    return index


def _apart(sig: list[np.ndarray], a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which of the places a and b hold signatures at most so many bits apart; half of the bits rule out nearly all others."""
    near = np.flatnonzero(np.bitwise_count(sig[0][a] ^ sig[0][b]) + np.bitwise_count(sig[1][a] ^ sig[1][b]) <= most)
    a, b = a[near], b[near]
    return near[sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int64) for x in sig) <= most]


def _searched(sig: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what distances of at most `most` join among these signatures (a row each), by breadth-first search."""
    a, b = [], []
    left, queue = np.arange(len(sig)), np.zeros(0, dtype=np.int64)
    if len(sig) ** 2 <= _AT_ONCE:  # most runs have few near pairs, and what is near to none is not searched
        left = np.flatnonzero((np.bitwise_count(sig[:, None] ^ sig[None]).sum(axis=2, dtype=np.int64) <= most).sum(axis=1) > 1)
    while len(left):
        if not len(queue):
            queue, left = left[:1], left[1:]
        n = max(1, _AT_ONCE // max(1, len(left)))
        nodes, queue = queue[:n], queue[n:]
        near = np.bitwise_count(sig[nodes, None] ^ sig[None, left]).sum(axis=2, dtype=np.int64) <= most
        found = near.any(axis=0)
        a.append(nodes[near[:, found].argmax(axis=0)])
        b.append(left[found])
        queue, left = np.concatenate([queue, left[found]]), left[~found]
    return np.concatenate([left, *a]), np.concatenate([left, *b])


def _links(most: int):
    @trimmed
    def links(table: pa.Table) -> pa.Table:
        """Pairs (a, b) that share a key and are near, as many as it takes to join all that such pairs join."""
        keys, refs = gathered(table, "keys", np.uint64), gathered(table, "refs", np.int64)
        sig = [gathered(table, f"s{k}", np.uint64) for k in range(4)]
        order = np.argsort(keys)
        keys, refs, sig = keys[order], refs[order], [x[order] for x in sig]
        n = len(keys)
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if n else np.zeros(0, np.int64)
        length = np.diff(np.append(start, n))
        end = np.repeat(start + length, length)
        at = np.flatnonzero(np.repeat((length > 1) & (length <= PAIRWISE), length))
        least = np.arange(n)
        pairs = [(at[:0], at[:0])]
        for d in range(1, PAIRWISE):
            at = at[at + d < end[at]]
            if not len(at):
                break
            x = at[_apart(sig, at, at + d, most)]
            np.minimum.at(least, x + d, x)
            pairs.append((x, x + d))
        a, b = (np.concatenate(x) for x in zip(*pairs))
        needed = (least[b] == a) | (least[a] != least[b])  # others are joined through the least that both are near to
        a, b = [a[needed]], [b[needed]]
        for s, m in zip(start[length > PAIRWISE], length[length > PAIRWISE]):
            x, y = _searched(np.stack([w[s : s + m] for w in sig], axis=1), most)
            a.append(x + s)
            b.append(y + s)
        a, b = refs[np.concatenate(a)], refs[np.concatenate(b)]
        found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    return links


def near_edges(sigs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) pairs of doc_ids that join all signatures within the distance that agree in the bits of one of the tables.

    Pairs are exact: an entry holds its whole signature, so all 256 bits are compared where two
    entries meet, and unrelated signatures that share a key never leave that task. Of the pairs
    under one key only those are given that are needed to join the same signatures.
    """
    spark = sigs.sparkSession
    count = sigs.count()
    tables = _tables(count, distance)
    found = None
    for own in np.array_split(tables, min(ROUNDS, len(tables))):
        slots = n_slots(spark, count * len(own))
        linked = sigs.mapInArrow(_index(slots, own), "slot long, keys binary, refs binary, s0 binary, s1 binary, s2 binary, s3 binary").groupBy("slot").applyInArrow(_links(distance), "a long, b long")
        linked = stored(linked, "links")
        found = linked if found is None else found.unionAll(linked)
    return found


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, group_id, keep): groups of near-duplicate documents; the least doc_id of each stays.

    A 256-bit SimHash of the lower-cased words (tf-weighted; words under four bytes at a
    twentieth) is indexed in some hundreds of tables, in each under 20 to 32 of its bits, drawn at
    random. Signatures that share a key are compared on all 256 bits. For flips at random places two
    signatures at the distance of 40 share one with probability 0.995, at 36 with more than 0.999;
    for d <= 19 a miss has a chance under one in 10^15. Unrelated texts are about 124 apart, of 1000 pairs one under 72.
    Keys lengthen with the logarithm of the corpus, so that unrelated texts that share one don't grow
    with its square; the tables, whose number keeps the probability, grow with its 0.28th power.
    Equal signatures are collapsed beforehand, and groups are connected components of the near pairs.

    Null and empty texts, and those without letters or digits, have no signature: each is a group
    of its own. Rows with a null doc_id are left out, and rows that repeat a doc_id are one
    document whose every text counts. Extra columns are ignored. Ties don't arise: groups are
    named by their least doc_id.
    """
    s = [f"s{k}" for k in range(4)]
    sigs = stored(signed(docs, text, doc_id).withColumn("head", F.min("doc_id").over(Window.partitionBy(*s))), "signatures")
    # Read once a round: in many parts, as each row makes some hundred entries.
    heads = sigs.filter("doc_id = head").select("doc_id", *s).distinct()
    heads = stored(heads.repartition(n_slots(docs.sparkSession, sigs.count(), HEADS_A_PART)), "heads")
    same = sigs.filter("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    roots = components(near_edges(heads, distance).unionAll(same))
    release(sigs, heads)
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    grouped = ids.join(roots, ids["doc_id"] == roots["node"], "left").select("doc_id", F.coalesce("root", "doc_id").alias("group_id"))
    return grouped.withColumn("keep", F.col("doc_id") == F.col("group_id"))
