"""Marker profiles of cells on a log scale, as 16 packed float32."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelattice.functions.vectors import matrix
from corelattice.plans.lineage import written


def packed(m: np.ndarray) -> pa.Array:
    """Rows of a float32 matrix as binary values."""
    m = np.ascontiguousarray(m, np.float32)
    offsets = np.arange(len(m) + 1, dtype=np.int32) * (m.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(m.reshape(-1))])


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """The float32 matrix of ``packed``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, width), np.float32)
    first = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(column.buffers()[2], np.float32, len(column) * width, int(first[0])).reshape(-1, width)


def profiles(df: DataFrame, key: str, values: str, width: int, also: list[str] | None = None, name: str = "profiles") -> DataFrame:
    """``key``, ``v`` (ln(1 + value), NaN where missing) and ``also``, written once.

    Rows without any value are left out, as are values of -1 and less.
    """
    also = also or []
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            m = matrix(t[values], width)
            m[~(m > -1)] = np.nan
            m = np.log1p(m)
            out = pa.RecordBatch.from_arrays([t[key], packed(m), *(t[c] for c in also)], [key, "v", *also])
            yield out.filter(pa.array(~np.isnan(m).all(axis=1)))

    fields = ", ".join([f"{key} {kinds[key]}", "v binary", *(f"{c} {kinds[c]}" for c in also)])
    return written(df.where(F.col(values).isNotNull()).select(key, values, *also).mapInArrow(run, fields), name)


def sample(df: DataFrame, key: str, width: int, rows: int, n: int) -> np.ndarray:
    """At most about ``rows`` profiles, chosen by a hash of the key: a bounded sample for fitting."""
    part = min(1.0, rows / max(n, 1))
    few = df.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1_000_000)) < F.lit(int(part * 1_000_000) + 1))
    # ordered, so that the fit is the same whatever the order of the files
    got = few.select("v", F.xxhash64(key, F.lit(8)).alias("h")).orderBy("h").select("v").toArrow()
    return unpacked(got["v"], width).copy()


def filled(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``x`` with missing values taken from the centre nearest in the values present."""
    gaps = np.isnan(x)
    rows = np.flatnonzero(gaps.any(axis=1))
    if not len(rows):
        return x
    out = x.copy()
    own, there = np.where(gaps[rows], 0, x[rows]), (~gaps[rows]).astype(np.float32)
    d = there @ (c * c).T - 2 * own @ c.T
    out[rows] = np.where(gaps[rows], c[np.argmin(d, axis=1)], x[rows])
    return out
