"""Arrow batches in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def pieces(array: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Rows from and to of pieces with about ``max_bytes`` of text, one row at least; one empty piece if there are no rows."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(array), 0), dtype=np.int64)
    part = (np.cumsum(sizes) - sizes) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(array)]
    yield from zip(cuts, cuts[1:])
