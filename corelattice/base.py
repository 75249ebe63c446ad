"""What the core's queries start from: cells by their current rows, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corelattice.operators.current import current_rows, plain_text
from corelattice.sources.tables import table

MARKERS = 16
VAR = ["NUX1", "EPQ2", "STV3", "LYK4", "LYB5", "MAF6", "GRZ7", "KIP8", "ENO9", "SMD10", "PLX11", "HYP12", "CHK13", "FOL14", "NEV15", "TRU16"]
PLAIN = ["image", "sample_id", "lyr", "coord_system", "area", "eccentricity", "n_genes", "s_score", "g2m_score", "phase", "neighborhood", "measured_at", "x", "x_pca"]


def cells(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Current rows with ``cell_key`` and ``columns``; phenotypes plain, blank core labels NULL."""
    got = current_rows(table(spark, sf, "adata_obs"), list(columns))
    if "phenotype" in columns:
        got = got.withColumn("phenotype", plain_text(F.col("phenotype")))
    if "tma_label" in columns:
        got = got.withColumn("tma_label", F.nullif(F.trim("tma_label"), F.lit("")))
    return got


def long(df: DataFrame, x: str) -> DataFrame:
    """``cell_key``, ``pos``, ``value`` (six decimals) of a marker column; NULL arrays give no row."""
    # the outer form: the plain one has Spark test the array's size below all the steps that made it
    return df.select("cell_key", F.posexplode_outer(x).alias("pos", "v")).where("pos is not null").select("cell_key", "pos", F.round("v", 6).alias("value"))


CELLS = """cells AS (
  SELECT * EXCLUDE (phenotype, tma_label, x), nullif(trim(tma_label), '') AS tma_label,
         CASE WHEN lower(trim(phenotype)) NOT IN ('', 'nan') THEN lower(trim(phenotype)) END AS phenotype,
         list_transform(x, lambda v: CASE WHEN NOT isnan(v) THEN v END) AS x
  FROM (SELECT * FROM adata_obs QUALIFY row_number() OVER (PARTITION BY cell_key ORDER BY loaded_at DESC) = 1))"""
LONG = """m AS (SELECT cell_key, unnest(x) AS v, generate_subscripts(x, 1)::INTEGER - 1 AS pos FROM cells WHERE x IS NOT NULL)"""
