"""Token counts of byte-level BPE tokenizers: texts are split into words by vectorised rules, and each different word is encoded once.

The rules are those of the published pattern, so counts equal the tokenizer's own:
contractions, letters, numbers and other characters, each with one space before them, and white space.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from trawl.llm.arrowtext import BLOCK, buffers, slices, span_hash

PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text that are split at a time, and different words whose counts a worker keeps.
SLICE, KEPT = 1 << 18, 1 << 20
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_table: np.ndarray | None = None


def _classes() -> np.ndarray:
    """The class of every code point."""
    global _table
    if _table is None:
        import unicodedata

        kinds = {"L": _LETTER, "N": _NUMBER}
        _table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        _table[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return _table


def word_starts(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where words start, of texts that begin at the given places of the code points."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[codes]
    edge = np.zeros(n + 3, dtype=bool)
    edge[begins[begins < n]] = True
    edge[n:] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last white-space character before something else stands alone; a space belongs to what follows.
    at = np.flatnonzero((kind[1:] != _SPACE) & (kind[:-1] == _SPACE) & ~edge[1:n]) + 1
    start[at - 1] = True
    start[at[codes[at - 1] == 32]] = False
    # Contractions: an apostrophe that no space belongs to, with one or two letters.
    at = np.flatnonzero((codes == 39) & start)
    at = at[~edge[at + 1]]
    at = at[kind[at + 1] == _LETTER]
    one = codes[at + 1]
    two = np.where(~edge[at + 2], codes[np.minimum(at + 2, n - 1)], 0)
    size = np.where(np.isin(one, [115, 100, 109, 116]), 1, np.where(((one == 108) & (two == 108)) | ((one == 118) & (two == 101)) | ((one == 114) & (two == 101)), 2, 0))
    at, size = at[size > 0], size[size > 0]
    start[at + 1] = False
    rest = at + 1 + size
    rest = rest[~edge[rest]]
    start[rest[kind[rest] == _LETTER]] = True
    return np.flatnonzero(start)


def _cut(data: np.ndarray, at: int, end: int) -> int:
    """A place beyond `at` where a word surely starts: a space between two other ASCII characters; else the end."""
    while at < end:
        own = data[at - 1 : min(end, at + BLOCK) + 1]
        plain = (own < 128) & (own > 32)
        found = np.flatnonzero((own[1:-1] == 32) & plain[:-2] & plain[2:]) if len(own) > 2 else own[:0]
        if len(found):
            return at + int(found[0])
        at += BLOCK
    return end


class Counter:
    """Counts tokens; ranks is the content of a rank file (base64 of the token, its rank)."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.model = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word."""
        hashes, first, inverse = np.unique(span_hash(data, starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        out = np.zeros(len(hashes), np.int64)
        out[known] = self.counts[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            out[new] = [len(self.model.encode_ordinary(raw[starts[k] : ends[k]].decode())) for k in first[new]]
            if len(self.hashes) + len(new) > KEPT:
                self.hashes, self.counts = hashes, out
            else:
                both = np.concatenate([self.hashes, hashes[new]])
                order = np.argsort(both)
                self.hashes, self.counts = both[order], np.concatenate([self.counts, out[new]])[order]
        return out[inverse]

    def __call__(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text; null texts have none."""
        data, offsets = buffers(column)
        out = np.zeros(len(offsets) - 1, np.int64)
        for i, j in slices(offsets, SLICE):
            for a, b in self._pieces(data, int(offsets[i]), int(offsets[j])):
                own = data[a:b]
                codes = np.frombuffer(own.tobytes().decode().encode("utf-32-le"), np.uint32)
                place = np.append(np.flatnonzero((own & 0xC0) != 0x80), len(own))
                begins = np.searchsorted(place, np.clip(offsets[i:j] - a, 0, len(own)))
                starts = place[word_starts(codes, begins)]
                if len(starts):
                    n = self._words(own, starts, np.append(starts[1:], len(own)))
                    rows = np.searchsorted(offsets, a + starts, "right") - 1
                    out += np.bincount(rows, weights=n, minlength=len(out)).astype(np.int64)
        return out

    @staticmethod
    def _pieces(data: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int]]:
        """A slice as it is, or a longer text in pieces that begin where words do."""
        while b - a > 2 * SLICE:
            c = _cut(data, a + SLICE, b)
            yield a, c
            a = c
        if a < b:
            yield a, b
