"""Small helpers for Arrow-batched stages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

SLICE = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose texts hold about `most` bytes, so that working memory stays bounded."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for i in range(n):
            held += int(sizes[i])
            if held >= most:
                yield batch.slice(at, i + 1 - at)
                at, held = i + 1, 0
        if at < n:
            yield batch.slice(at)
