"""Queries of problem 8: abusive, hateful or sexual content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corelattice.llm import abuse
from corelattice.operators.current import plain_text
from corelattice.plans.lineage import written
from corelattice.sources.tables import table


def p8_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Score of every page, its worst sentence, and whether that is to be reviewed."""
    docs = table(spark, sf, "documents")
    model = abuse.fitted(docs, table(spark, sf, "page_labels"), "doc_id", "text", "toxic")
    return abuse.scored(docs, model, "doc_id", "text", ["source"])


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that hold an offending passage."""
    return p8_scores(spark, sf).where("flagged").select("doc_id")


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Pages, flagged pages and their share per source (NULL: pages without a source)."""
    pages = written(p8_scores(spark, sf).select(plain_text(F.col("source")).alias("source"), "score", "flagged"), "scores")
    out = pages.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.col("flagged").cast("long")).alias("flagged"), F.round(F.avg("score"), 6).alias("mean_score"))
    return out.withColumn("rate", F.round(F.col("flagged") / F.col("pages"), 6))


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
