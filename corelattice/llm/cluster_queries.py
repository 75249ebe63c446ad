"""Queries of problem 2: similarity clusters of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corelattice.llm.cells import current_cells
from corelattice.llm.communities import similarity_clusters
from corelattice.llm.profiles import profiles
from corelattice.operators.current import plain_text
from corelattice.plans.lineage import written

WIDTH, TYPICAL = 16, 5


def _clusters(spark: SparkSession, sf: str, typical: bool) -> DataFrame:
    cells = current_cells(spark, sf, ["x", "phenotype"]).withColumn("plain", plain_text(F.col("phenotype")))
    base = profiles(cells, "cell_key", "x", WIDTH, ["plain"])
    return written(similarity_clusters(base, "cell_key", WIDTH, "plain", typical), "members")


def _usual(members: DataFrame) -> DataFrame:
    """``cluster``, ``usual`` (commonest phenotype, ties by name) and how many have it."""
    seen = members.where("cluster >= 0 and plain is not null").groupBy("cluster", "plain").agg(F.count(F.lit(1)).alias("n_usual"))
    best = seen.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n_usual"), "plain"))).where("r = 1")
    return best.select("cluster", F.col("plain").alias("usual"), "n_usual")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Cells whose phenotype goes against the commonest one of their cluster."""
    members = _clusters(spark, sf, False)
    return members.where("plain is not null").join(F.broadcast(_usual(members).select("cluster", "usual")), "cluster").where("plain <> usual").select("cell_key")


def p2_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Size, usual phenotype and most typical cells of each cluster."""
    members = _clusters(spark, sf, True).where("cluster >= 0")
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.count("plain").alias("n_named"))
    best = members.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("degree"), "cell_key"))).where(F.col("r") <= TYPICAL)
    best = best.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "cell_key"))), lambda p: p["cell_key"].cast("string")), ",").alias("typical"))
    return size.join(_usual(members), "cluster", "left").join(best, "cluster").select("cluster", "size", "n_named", "usual", "n_usual", "typical")


QUERIES = {"p2_found": p2_found, "p2_clusters": p2_clusters}
