"""Arrow batches in runs of few bytes, so that what Python holds of a batch does not grow with the length of its texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that become Python objects at once.
MOST = 1 << 20


def runs(sizes: np.ndarray, most: int = MOST) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of whole rows of about ``most`` bytes; a longer row stands alone."""
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(sizes):
        done = ends[start - 1] if start else 0
        end = max(int(np.searchsorted(ends, done + most, side="right")), start + 1)
        yield start, end - start
        start = end


def text_bytes(*texts: pa.Array) -> np.ndarray:
    return sum(pc.fill_null(pc.binary_length(t), 0).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts)


def mapped(f: Callable[..., pa.Array], kind: pa.DataType, *texts: pa.Array) -> pa.Array:
    """f of each run of rows of the columns of texts, as one column."""
    parts = [f(*(t.slice(start, n) for t in texts)) for start, n in runs(text_bytes(*texts))]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
