"""Rows of an Arrow list column as dense numpy vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def dense(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the rows that hold exactly ``width`` numbers, none null or non-finite, as doubles.

    A null row, a row of another length and a row with a null, NaN or infinite component are left out.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(lengths == width)
    if not len(fits) or not width:
        return fits[:0], np.zeros((0, width))
    values = pc.cast(column.take(pa.array(fits)).flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    x = values.reshape(-1, width)
    good = np.isfinite(x).all(1)
    return fits[good], x[good]
