"""Arrow batches in pieces, so that a helper's Python objects are those of a piece and not of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def pieces(batches, rows: int = 256, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, in pieces of at most `rows` rows and about `size` bytes; a larger row is a piece of its own."""
    for b in batches:
        step = max(1, min(rows, b.num_rows * size // max(b.nbytes, 1)))
        for first in range(0, b.num_rows, step):
            piece = b.slice(first, step)
            if piece.num_rows > 1 and piece.nbytes > 2 * size:
                yield from (piece.slice(k, 1) for k in range(piece.num_rows))
            else:
                yield piece
