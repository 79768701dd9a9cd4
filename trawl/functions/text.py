"""Text analysis: tokens are runs of ASCII letters and digits, lower-cased after splitting."""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[0-9A-Za-z]+"


def tokenize(text: str) -> list[str]:
    """Tokens of a query on the driver; every non-ASCII character separates, as it does in documents."""
    return [t.lower() for t in re.findall(TOKEN, text or "")]


def query_terms(text: str) -> Counter:
    """Each distinct token of a query with its number of occurrences, in order of first appearance."""
    return Counter(tokenize(text))


def tokens(text: Column) -> Column:
    """All tokens of a text in order; null texts have none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"), 1), F.lower)


def token_count(text: Column) -> Column:
    """How many tokens a text has."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN))


_CLASS = np.zeros(256, np.uint8)
for _c in string.ascii_letters + string.digits:
    _CLASS[ord(_c)] = ord(_c.lower())


def token_arrays(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All tokens of an Arrow array of texts in order, and how many each text has; null texts have none.

    Works on the UTF-8 bytes: no byte of a letter outside ASCII is a letter or digit of ASCII.
    """
    texts = pa.compute.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    if first == last:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    lower = _CLASS[np.frombuffer(texts.buffers()[2], np.uint8)[first:last]]
    inside = lower != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    bounds = offsets - first  # a text's first byte begins a token also after another text's last
    starts = bounds[:-1][np.diff(bounds) > 0]
    begins[starts] = inside[starts]
    kept = lower[inside]
    at = np.flatnonzero(begins[inside])
    ends = np.append(at, len(kept)).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(kept))
    return found, np.diff(np.searchsorted(np.flatnonzero(begins), bounds))


def term_counts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(vocabulary in order, term, row, count, tokens of each row): each different term of each text by its number in the vocabulary, by term and row."""
    found, sizes = token_arrays(texts)
    coded = found.dictionary_encode()
    order = pa.compute.sort_indices(coded.dictionary).to_numpy()
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    keys = number[coded.indices.to_numpy()] * max(1, len(sizes)) + np.repeat(np.arange(len(sizes)), sizes)
    keys, counts = np.unique(keys, return_counts=True)
    term, row = np.divmod(keys, max(1, len(sizes)))
    return coded.dictionary.take(pa.array(order)), term, row, counts, sizes


def term_frequency(text: Column, term: str) -> Column:
    """How often a (lower-case ASCII) term is a whole token of the text; (?i) ignores ASCII case only."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"(?i)(?<![0-9A-Za-z]){re.escape(term)}(?![0-9A-Za-z])"))


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z only, so that other letters keep their bytes."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def crc32_hex(data: Column) -> Column:
    """CRC-32 as eight hexadecimal digits."""
    return F.lpad(F.lower(F.hex(F.crc32(data))), 8, "0")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once a row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def to_base64(data: Column) -> Column:
    """Base64 on one line."""
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


def from_base64(text: Column) -> Column:
    """Bytes of base64 text: other characters are skipped, an incomplete last group is dropped to whole bytes, and nothing raises."""
    def decoded(clean: Column) -> Column:
        whole = F.when(F.length(clean) % 4 == 1, F.left(clean, F.length(clean) - 1)).otherwise(clean)
        return F.unbase64(let(whole, lambda w: F.rpad(w, (F.ceil(F.length(w) / 4) * 4).cast("int"), "=")))

    return let(F.regexp_replace(F.regexp_replace(text, "=.*$", ""), "[^A-Za-z0-9+/]", ""), decoded)
