"""Arrow batches cut by the size of their texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SLICE_BYTES = 2 << 20


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """``batches`` in slices whose ``column`` holds about ``size`` bytes; one text may be more."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column).cast(pa.large_string())).fill_null(0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            past = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            to = min(batch.num_rows, max(at + 1, past))
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def lists(values, counts, kind: pa.DataType) -> pa.ListArray:
    """Rows of ``counts`` consecutive ``values``."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values if isinstance(values, list) else np.asarray(values), kind))
