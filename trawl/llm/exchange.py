"""Moving packed numpy columns between tasks, and tables cut loose from their lineage.

Operators that index hundreds of keys per document send them as packed blobs: a map task sorts
its entries by slot (a hash of the key) and emits one row per slot. A slot's blobs meet in one
``applyInArrow`` group, where numpy sorts them. The number of slots grows with the number of
entries, so a slot stays at some hundred thousand entries at every size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.arrowtext import mix
from trawl.operators.ordering import fresh
from trawl.sources.scratch import release, shared_dir, stored

__all__ = ["by_slot", "fresh", "gathered", "n_slots", "pack", "release", "shared_dir", "sized", "slot_of", "stored", "tuned", "unpack"]

#: Entries that meet in one group, some tens of bytes each with what sorting them takes.
ENTRIES_A_SLOT = 400_000
BATCH_BYTES = 4 << 20
#: The largest side of a join, in bytes, that is broadcast.
BROADCAST_BYTES = 32 << 20


def n_slots(spark: SparkSession, entries: float, per_slot: int = ENTRIES_A_SLOT) -> int:
    return int(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // per_slot)))


def pack(a: np.ndarray) -> bytes:
    """Bytes of an array, equal-weight bytes side by side, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b"")


def unpack(b: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel() if len(raw) else np.zeros(0, dtype=dtype)


def slot_of(keys: np.ndarray, slots: int) -> np.ndarray:
    return ((mix(keys) >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)


def by_slot(slot: np.ndarray, slots: int, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """One row per slot that has entries: slot and the packed columns."""
    order = np.argsort(slot.astype(np.uint16) if slots <= 1 << 16 else slot, kind="stable")
    bounds = np.searchsorted(slot[order], np.arange(slots + 1)) if slots <= 1 << 16 else None
    if bounds is None:
        present, first = np.unique(slot[order], return_index=True)
        ends = np.append(first[1:], len(order))
    else:
        present = np.flatnonzero(np.diff(bounds))
        first, ends = bounds[present], bounds[present + 1]
    sent = [c[order] for c in columns]
    return pa.RecordBatch.from_arrays(
        [pa.array(present, pa.int64()), *(pa.array([pack(c[a:b]) for a, b in zip(first, ends)], pa.binary()) for c in sent)],
        names=["slot", *names],
    )


def gathered(table: pa.Table, name: str, dtype: type) -> np.ndarray:
    """A packed column of all blobs of a group."""
    return np.concatenate([np.zeros(0, dtype=dtype), *(unpack(b, dtype) for b in table.column(name).to_pylist())])


def tuned(df: DataFrame) -> DataFrame:
    """The same, in a session whose Arrow batches are bounded by bytes: rows of text make batches of any size otherwise."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def sized(df: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """The side of a join, marked for broadcast only if its counted rows take at most so many bytes; df should be cheap to count."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df

