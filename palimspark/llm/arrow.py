"""Arrow batches in tasks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text that a task holds decoded at one time, in bytes of UTF-8; one longer text stands alone.
SLICE_BYTES = 4_000_000


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose ``column`` holds about ``most`` bytes each."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def id_lists(raw: list[bytes]) -> pa.ListArray:
    """Lists of token ids from little-endian unsigned 32-bit integers."""
    offsets = np.cumsum([0, *(len(r) // 4 for r in raw)], dtype=np.int64).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), dtype="<u4").astype(np.int32)))


def id_checksums(lists: pa.ListArray) -> pa.Array:
    """For each list the crc32 of its ids as little-endian unsigned 32-bit integers; nothing is copied."""
    offsets = (lists.offsets.to_numpy() * 4).tolist()
    raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
    return pa.array([zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.int64())
