"""Arrow batches in pieces, so that a task holds little beside the batch itself."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
PIECE = 1 << 20


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Begins and ends of runs of texts of about limit bytes, one text at least."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at, ends = 0, size.cumsum(dtype="int64")
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(ends.searchsorted(before + limit, "right")))
        yield at, to
        at = to
