"""Whole-number vectors for exact scores: which rows take part, how they reach a task, and which integers hold their scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of vectors that a tile takes on either side, about, and rows at most.
TILE_BYTES, TILE_ROWS = 1 << 23, 4096


def whole(vector: Column) -> Column:
    """Whether a vector of doubles is there and all its components are numbers."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def tile_rows(rows: DataFrame) -> int:
    """Rows of ``rows`` (embedding) for a side of a tile."""
    widest = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    return max(64, min(TILE_ROWS, TILE_BYTES // (8 * max(1, widest))))


def integers(column: pa.ChunkedArray, scale: int) -> np.ndarray:
    """floor(scale * x) of all components as rows of equal length; where a vector ends early, zeros follow."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = lists.flatten().to_numpy()
    np.floor(np.multiply(out, scale, out=out), out=out)
    if np.abs(out).max(initial=0) >= 1 << 31:
        raise OverflowError("components beyond 31 bits: their scores would not fit 64 bits")
    return out.astype(np.int64)


def score_type(left: np.ndarray, right: np.ndarray) -> type:
    """The narrowest integers that hold all inner products of rows of ``left`` and ``right``, and all partial sums."""
    most = int(np.abs(left).sum(axis=1).max(initial=0)) * int(np.abs(right).max(initial=0) + 1) * 2
    for kind in (np.int16, np.int32, np.int64):
        if most <= np.iinfo(kind).max:
            return kind
    raise OverflowError("scores beyond 64 bits")
