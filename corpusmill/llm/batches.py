"""Arrow batches in bounded pieces, for tasks that hold more than the batch itself."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

ROWS = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """All rows in pieces of at most ``rows``; an empty batch stays one.

    Workers are used again by later stages, so Arrow's unused memory goes back at the end.
    """
    for batch in batches:
        for start in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(start, rows)
    batch = None
    pa.default_memory_pool().release_unused()
