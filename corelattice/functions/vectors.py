"""Vectors as flat arrays: packing, centres, nearest centres."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as rows of ``width`` float64; NaN where a value or a row is missing.

    Rows of another length are missing as a whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.full((len(column), width), np.nan)
    if not len(column):
        return out
    offsets = np.asarray(column.offsets)
    lengths = np.diff(offsets)
    good = np.asarray(column.is_valid()) & (lengths == width)
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    if good.all() and offsets[-1] - offsets[0] == out.size:
        return flat[offsets[0] : offsets[-1]].reshape(-1, width).copy()
    rows = np.flatnonzero(good)
    out[rows] = flat[offsets[:-1][rows][:, None] + np.arange(width)]
    return out


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of ``k`` clusters (fewer if there are fewer rows)."""
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].astype(np.float32)
    for _ in range(rounds):
        a = nearest(x, c)
        n = np.bincount(a, minlength=k).astype(np.float32)
        s = np.stack([np.bincount(a, x[:, j], k) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c


def nearest(x: np.ndarray, c: np.ndarray, block: int = 16384) -> np.ndarray:
    """Number of the nearest centre of each row."""
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmin(half - x[i : i + block] @ c.T, axis=1) for i in range(0, len(x), block)]) if len(x) else np.empty(0, np.int64)
