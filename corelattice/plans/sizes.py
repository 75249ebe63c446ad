"""Broadcast hints behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A broadcast hint on ``df`` if it has at most ``rows`` rows, else ``df`` as it is.

    The check stops at ``rows`` + 1 rows.  ``df`` should be a written table, as
    it is read for the check.  Beyond the bound Spark joins by shuffling.
    """
    if df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return df
