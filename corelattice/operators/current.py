"""Current rows of a table whose keys are loaded again and again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current_rows(df: DataFrame, columns: list[str], key: str = "cell_key", loaded: str = "loaded_at") -> DataFrame:
    """Of each ``key`` the row with the greatest ``loaded``, with ``key`` and ``columns``.

    Rows with a NULL key are left out; a NULL ``loaded`` counts as the oldest.
    Of rows equal in key and ``loaded`` the one with the least hash of the
    columns asked for is kept, so repeated rows are one row.  One shuffle, on
    the key; Spark keeps one row per key and partition before it.
    """
    rest = [c for c in columns if c not in (key, loaded)]
    order = [F.col(loaded).desc_nulls_last(), F.xxhash64(*rest) if rest else F.lit(0)]
    kept = df.where(F.col(key).isNotNull()).select(key, loaded, *rest)
    ranked = kept.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("__rank = 1").select(key, *[c for c in columns if c != key])


def is_missing_text(c: Column) -> Column:
    """True for NULL, blank and the text ``nan`` in any case."""
    return c.isNull() | F.lower(F.trim(c)).isin("", "nan")


def plain_text(c: Column) -> Column:
    """Lower case, runs of blanks as one, none at the ends; NULL where missing."""
    return F.when(~is_missing_text(c), F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))))
