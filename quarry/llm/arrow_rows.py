"""Arrow plumbing of the operators that run Python: batches in slices of bounded bytes, list columns from flat arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, column: str, max_bytes: int):
    """Row slices of a batch whose texts have at most ``max_bytes`` together; a longer text is a slice of its own."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0))
    lo = total = 0
    for k, size in enumerate(sizes.tolist()):
        if k > lo and total + size > max_bytes:
            yield batch.slice(lo, k - lo)
            lo, total = k, 0
        total += size
    if lo < batch.num_rows:
        yield batch.slice(lo)


def list_column(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """A list column: ``counts[k]`` values of ``flat`` for row k."""
    ends = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
