"""Z-order codes of grid cells and covers of discs by code ranges.

The plane is cut into squares of side ``BASE``; a square's code interleaves the
bits of its column and row.  The squares of one quad of side ``BASE * 2**level``
have consecutive codes, so a quad is the range ``[q << 2*level, (q+1 << 2*level) - 1]``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = 0.25  # side of the finest squares, in the unit of the coordinates
_SHIFT = 1 << 25  # coordinates may be negative: +-8.3 million units


def level_for(side: float) -> int:
    """The lowest level whose quads have at least this side."""
    return max(0, math.ceil(math.log2(max(side, BASE) / BASE)))


def square(v: Column, level: int = 0) -> Column:
    """Column or row of the quad that holds coordinate ``v``."""
    return F.floor(v / F.lit(BASE * 2**level)).cast("long") + F.lit(_SHIFT >> level).cast("long")


# fixed shifts and masks of bit interleaving
_STEPS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def interleaved(df: DataFrame, column: Column, row: Column, out: str, bits: int = 32) -> DataFrame:
    """Adds ``out``, the code of the square (or quad) at ``column``, ``row``.

    Each step is a projection of its own: as one expression, every step would
    double the work, since it uses the step before it twice.  Numbers of fewer
    ``bits`` need fewer steps.
    """
    df = df.withColumns({"__ix": column, "__iy": row})
    for by, mask in (s for s in _STEPS if s[0] < bits):
        df = df.withColumns({c: F.col(c).bitwiseOR(F.shiftleft(c, by)).bitwiseAND(F.lit(mask).cast("long")) for c in ("__ix", "__iy")})
    return df.withColumn(out, F.col("__ix").bitwiseOR(F.shiftleft("__iy", 1))).drop("__ix", "__iy")


def coded(df: DataFrame, x: str, y: str, out: str) -> DataFrame:
    """Adds ``out``, the code of the finest square that holds the point."""
    return interleaved(df, square(F.col(x)), square(F.col(y)), out)
