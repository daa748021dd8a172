"""Vectors as rows of bytes: float32 where that loses nothing, else float64."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def components(column: pa.Array) -> list[np.ndarray | None]:
    """Each row's components as doubles; None for null rows and rows with null or non-finite ones."""
    lists = column.cast(pa.list_(pa.float64()))
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    bad = ~np.isfinite(flat)
    if lists.values.null_count:
        bad |= lists.values.is_null().to_numpy(zero_copy_only=False)
    ends = ends.astype(np.int64)
    wrong = np.concatenate([[0], np.cumsum(bad)])
    odd = (wrong[ends[1:]] > wrong[ends[:-1]]) | (ends[1:] == ends[:-1])
    odd |= lists.is_null().to_numpy(zero_copy_only=False)
    return [None if o else flat[s:e] for o, s, e in zip(odd, ends[:-1], ends[1:])]


def to_bytes(vector: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        narrow = vector.astype("<f4")
    return narrow.tobytes() if (narrow == vector).all() else vector.astype("<f8").tobytes()


def from_bytes(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of ``dim`` components each as doubles."""
    values = column.to_pylist()
    if all(len(v) == dim * 4 for v in values):
        return np.frombuffer(b"".join(values), "<f4").reshape(-1, dim).astype(float)
    return np.array([np.frombuffer(v, "<f4" if len(v) == dim * 4 else "<f8") for v in values])
