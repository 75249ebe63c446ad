"""Queries of problem 5: most similar vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corelattice.llm.cells import current_cells
from corelattice.llm.neighbours import nearest_neighbours
from corelattice.llm.profiles import profiles

WIDTH, NEAREST, REACH = 16, 5, 0.06


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of cells at most 0.06 apart of which one is among the 5 nearest of the other."""
    base = profiles(current_cells(spark, sf, ["x"]), "cell_key", "x", WIDTH)
    near = nearest_neighbours(base, "cell_key", WIDTH, NEAREST, limit=REACH)
    return near.select(F.least("cell_key", "neighbour").alias("key_a"), F.greatest("cell_key", "neighbour").alias("key_b")).distinct()


def p5_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 nearest of every cell whose key is divisible by 100, among all cells."""
    base = profiles(current_cells(spark, sf, ["x"]), "cell_key", "x", WIDTH)
    near = nearest_neighbours(base, "cell_key", WIDTH, NEAREST, queries="cell_key % 100 = 0")
    return near.select("cell_key", "neighbour", F.round("distance", 6).alias("distance"))


QUERIES = {"p5_found": p5_found, "p5_nearest": p5_nearest}
