"""Quality rules on repetition: characters inside duplicated n-grams and duplicated lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.arrowtext import NEWLINE, SPACE, Pieces, gram_hash, mix, pieces, row_sums, running

#: Largest admitted share of characters inside repeated n-grams, by n, and inside repeated lines.
#: Both occurrences of a doubled passage count, so these are twice the shares usual where only the
#: copies beyond the first count; one doubled line in a short text stays below them.
NGRAM_LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
LINE_LIMIT = 0.40


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _measure(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    words = Pieces(data, offsets, SPACE)
    chars = words.chars()
    out = [row_sums(chars, words.counts)]
    total, n = running(words.hashes), len(words.rows)
    salt = mix(np.arange(words.n_rows, dtype=np.uint64))[words.rows]
    for length in lengths:
        covered = np.zeros(n + 1, dtype=np.int32)
        if n >= length:
            at = np.flatnonzero(words.rows[: n - length + 1] == words.rows[length - 1 :])
            again = at[_repeated(gram_hash(words.hashes, length, total)[at] ^ salt[at])]
            covered[again] += 1
            covered[again + length] -= 1
        out.append(row_sums(chars * (np.cumsum(covered[:-1]) > 0), words.counts))
    lines = Pieces(data, offsets, NEWLINE)
    chars = lines.chars()
    again = _repeated(lines.hashes ^ mix(np.arange(lines.n_rows, dtype=np.uint64))[lines.rows])
    return [*out, row_sums(chars, lines.counts), row_sums(chars * again, lines.counts)]


def repetition(docs: DataFrame, lengths: tuple[int, ...] = tuple(NGRAM_LIMITS), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: shares of characters inside repeated word n-grams and repeated lines, and the verdict.

    Words are maximal runs without ASCII white space; lines are the non-empty pieces between line
    feeds. An n-gram or line is repeated if it occurs at least twice in its document; every
    occurrence counts, and a character covered by several repeated n-grams counts once. Columns:
    doc_id, word_chars, line_chars, dup_<n>gram for each n, dup_lines, keep. Shares are rounded to
    6 decimals.

    One map pass, no shuffle: rolling hashes come from running sums over all words of a slice of
    documents. A null or empty text, and one without words, has shares of 0 and is kept. A text
    shorter than n words has no n-gram. Rows with the same or a null doc_id are measured one by
    one, and other columns are ignored.
    """
    names = ["word_chars", *(f"g{n}" for n in lengths), "line_chars", "dup"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_measure(p.data, p.offsets, lengths) for _, _, p in pieces(batch.column(1), SPACE, with_hash=False)]
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64) for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *names])

    counted = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(measure, "doc_id long, " + ", ".join(f"{n} long" for n in names))
    share = lambda part, whole: F.when(F.col(whole) > 0, F.round(F.col(part) / F.col(whole), 6)).otherwise(F.lit(0.0))
    out = counted.select("doc_id", "word_chars", "line_chars", *(share(f"g{n}", "word_chars").alias(f"dup_{n}gram") for n in lengths), share("dup", "line_chars").alias("dup_lines"))
    bad = F.col("dup_lines") > LINE_LIMIT
    for n in lengths:
        bad |= F.col(f"dup_{n}gram") > NGRAM_LIMITS.get(n, 0.20)
    return out.withColumn("keep", ~bad)
