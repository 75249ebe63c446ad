"""Cells by their current rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corelattice.operators.current import current_rows
from corelattice.sources.tables import table


def current_cells(spark: SparkSession, sf: str, columns: list[str]) -> DataFrame:
    """Current rows of ``adata_obs`` with ``cell_key`` and ``columns``."""
    return current_rows(table(spark, sf, "adata_obs"), columns)
