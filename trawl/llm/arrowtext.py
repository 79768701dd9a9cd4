"""Vectorised text primitives that work on the buffers of Arrow string columns.

Every helper here treats a null text as an empty one and handles texts of any length. Work is
cut into slices of bounded size, and `parts` cuts a longer text too, so a worker's memory follows
the slice and not the Arrow batch or the text. Byte hashes are taken block by block.
"""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
#: Bytes that are hashed at a time, eight bytes of arrays each; and powers that a worker keeps.
BLOCK, KEPT_POWERS = 1 << 17, 1 << 18
_SCAN = 1 << 20

_rng = np.random.default_rng(20240229)
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE, GRAM_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(chars, dtype=np.uint8)] = True
    return out


#: ASCII white space ends a word; all other bytes belong to words.
SPACE = _table(b" \t\n\r\f\v")
#: ASCII characters other than letters and digits end a word; non-ASCII bytes belong to words.
PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
NEWLINE = _table(b"\n")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit affects every output bit."""
    x = np.asarray(x, dtype=np.uint64)
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; short tables are kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 64), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= KEPT_POWERS:
            _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes data[start:end] of each span, spans in order and apart; it depends on the content only."""
    out = np.empty(len(starts), dtype=np.uint64)
    up, down, i = powers(BASE, BLOCK), powers(inverse(BASE), BLOCK + 1), 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        hi = int(ends[j - 1])
        if hi - lo <= BLOCK:
            total = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum(BYTE_CODES[data[lo:hi]] * up[: hi - lo], out=total[1:])
            a, b = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        else:  # one span longer than a block
            s = 0
            for k in range(lo, hi, BLOCK):
                part = data[k : min(hi, k + BLOCK)]
                s += int((BYTE_CODES[part] * up[: len(part)]).sum(dtype=np.uint64)) * pow(BASE, k - lo, 1 << 64)
            out[i] = mix(np.array([(s + hi - lo) % (1 << 64)], dtype=np.uint64))[0]
        i = j
    return out


def gram_hash(tokens: np.ndarray, n: int, total: np.ndarray | None = None) -> np.ndarray:
    """Hash of tokens[i:i+n] for each i; empty if there are fewer than n tokens."""
    m = len(tokens) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    if total is None:
        total = running(tokens)
    return mix((total[n:] - total[:m]) * powers(inverse(GRAM_BASE), m) + np.uint64(n))


def running(tokens: np.ndarray) -> np.ndarray:
    total = np.zeros(len(tokens) + 1, dtype=np.uint64)
    np.cumsum(tokens * powers(GRAM_BASE, len(tokens)), out=total[1:])
    return total


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and their n+1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    data = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1))
        yield i, j
        i = j


class Pieces:
    """Spans of a slice of texts (words or lines): row, start, end (bytes) and hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, with_hash: bool = True):
        self.data, self.offsets = data, offsets
        self.n_rows = len(offsets) - 1
        starts, ends, n, last = [], [], len(data), False
        for a in range(0, n, _SCAN):  # whether each byte is inside a span is held for a block only
            b = min(n, a + _SCAN)
            edge = np.zeros(b - a + 1, dtype=bool)
            at = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a
            edge[at] = True
            inside = np.empty(b - a + 1, dtype=bool)
            inside[:-1] = ~separators[data[a:b]]
            inside[-1] = b < n and not separators[data[b]]
            before = np.empty(b - a, dtype=bool)
            before[0], before[1:] = last, inside[:-2]
            last = bool(inside[-2])
            starts.append(np.flatnonzero(inside[:-1] & (~before | edge[:-1])) + a)
            ends.append(np.flatnonzero(inside[:-1] & (~inside[1:] | edge[1:])) + a + 1)
        none = np.zeros(0, np.int64)
        self.starts, self.ends = np.concatenate([none, *starts]), np.concatenate([none, *ends])
        self.counts = np.diff(np.searchsorted(self.starts, offsets))
        self.rows = np.repeat(np.arange(self.n_rows), self.counts)
        if with_hash:
            self.hashes = span_hash(data, self.starts, self.ends)

    def chars(self) -> np.ndarray:
        """Characters of each span, not bytes."""
        if not len(self.starts):
            return self.starts
        leads = np.zeros(len(self.data) + 1, dtype=np.uint8)
        np.not_equal(self.data & 0xC0, 0x80, out=leads[:-1].view(bool))
        return np.add.reduceat(leads, np.stack([self.starts, self.ends], axis=1).ravel(), dtype=np.int64)[::2]


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


def pieces(column: pa.Array, separators: np.ndarray, most: int = SLICE_BYTES, lower: bool = False, with_hash: bool = True) -> Iterator[tuple[int, int, Pieces]]:
    """For each slice of the column: first row, end row, and its spans. Texts are whole, so one longer than a slice is a slice."""
    _, rough = buffers(column)
    for i, j in slices(rough, most):
        own = column.slice(i, j - i)
        yield i, j, Pieces(*buffers(_lowered(own) if lower else own), separators, with_hash)


def parts(column: pa.Array, separators: np.ndarray, most: int = SLICE_BYTES, lower: bool = False, with_hash: bool = True, overlap: int = 0) -> Iterator[tuple[int, int, Pieces, int, bool]]:
    """As `pieces`, with texts longer than a slice cut between spans: first row, end row, spans, number of the first span in its text, and whether the text ends here.

    Each further part of a text begins with the last `overlap` spans of the part before. A single
    span is never cut, so a part holds at least one more than those.
    """
    data, offsets = buffers(column)
    for i, j in slices(offsets, most):
        if j - i > 1 or offsets[j] - offsets[i] <= most:
            own = column.slice(i, j - i)
            yield i, j, Pieces(*buffers(_lowered(own) if lower else own), separators, with_hash), 0, True
            continue
        at, end, first, width = int(offsets[i]), int(offsets[j]), 0, most
        while True:
            ahead = at + width
            while ahead < end:  # a part ends at a separator, a block further if there is none
                found = np.flatnonzero(separators[data[ahead : ahead + BLOCK]])
                if len(found):
                    ahead += int(found[0]) + 1
                    break
                ahead += BLOCK
            ahead = min(ahead, end)
            raw = data[at:ahead]
            if lower:
                raw, _ = buffers(_lowered(pa.array([raw.tobytes()], pa.binary()).cast(pa.string())))
            p = Pieces(raw, np.array([0, len(raw)]), separators, with_hash)
            if ahead >= end:
                yield i, j, p, first, True
                break
            n = len(p.starts)
            if n <= overlap:  # too little to be of use: a longer part, from the same place
                width *= 2
                continue
            width = most
            yield i, j, p, first, False
            if overlap:
                # The next part begins at the same span in the text as it is, not as it was lowered.
                own = Pieces(data[at:ahead], np.array([0, ahead - at]), separators, False) if lower else p
                at += int(own.starts[n - overlap])
            else:
                at = ahead
            first += n - overlap


def trim() -> None:
    """Gives freed memory back to the system: a reused worker would hold what its largest task took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def trimmed(f: Callable) -> Callable:
    """A function for mapInArrow or applyInArrow, of one or two arguments, that gives its memory back at its end."""
    if inspect.isgeneratorfunction(f):

        def each(batches):
            try:
                yield from f(batches)
            finally:
                trim()

        return each

    def one(table):
        try:
            return f(table)
        finally:
            trim()

    def two(left, right):
        try:
            return f(left, right)
        finally:
            trim()

    return one if len(inspect.signature(f).parameters) == 1 else two


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the values of each row, given how many values each row has."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
