"""Arrow batches in slices of bounded size, so that a worker's memory doesn't grow with the length of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``most`` bytes of a text column; a longer text is a slice of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < n:
            base = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(a, b - a)
            a = b
