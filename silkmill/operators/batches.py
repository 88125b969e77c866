"""Arrow batches in parts of bounded text: what a Python worker makes of a part stays small, however large batches and tables are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST = 1_000_000


def text_parts(batches: Iterator[pa.RecordBatch], text: str, most: int = MOST) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many bytes of the text column, or of one row."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        k = 0
        while k < len(b):
            before = ends[k - 1] if k else 0
            stop = max(k + 1, int(np.searchsorted(ends, before + most, "right")))
            yield b.slice(k, stop - k)
            k = stop


def table_of(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
