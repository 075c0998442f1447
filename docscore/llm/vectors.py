"""What the operators on embeddings share: which vectors are usable, and reading them from Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_ENTRIES = 4_000_000


def usable(vector: Column, largest: float = float("inf")) -> Column:
    """Is the vector there, with at least one entry, and every entry a number below ``largest`` in size?"""
    fine = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < largest), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def width_of(frame: DataFrame, column: str) -> int:
    """The common length of all vectors, zero for an empty table; an error if lengths differ."""
    low, high = frame.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if low != high:
        raise ValueError(f"vectors of {low} to {high} entries can't be compared")
    return low or 0


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """A batch of lists as a matrix, one row per list."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def slices(batch: pa.RecordBatch, width: int):
    """Parts of a batch with at most ``SLICE_ENTRIES`` vector entries each."""
    step = max(1, SLICE_ENTRIES // max(1, width))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)
