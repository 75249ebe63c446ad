"""The queries pN_... of problems 2 to 8 and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corelattice.llm import abuse_queries, cluster_queries, mixing, packing, percentiles, together, vector_queries
from corelattice.llm.cells import current_cells
from corelattice.operators.current import plain_text
from corelattice.plans.lineage import written
from corelattice.plans.ranks import numbered
from corelattice.plans.sizes import broadcast_if_small
from corelattice.sources.tables import table

MARKERS = 16
PERCENTS = [5.0, 25.0, 50.0, 75.0, 95.0]
CAPACITY = 1024


def _markers(spark: SparkSession, sf: str) -> DataFrame:
    return F.broadcast(table(spark, sf, "marker_var").select("pos", F.col("name").alias("marker"), "expected_median").dropDuplicates(["pos"]))


# problem 3 ------------------------------------------------------------------


def _sample_chunks(spark: SparkSession, sf: str) -> DataFrame:
    cells = current_cells(spark, sf, ["sample_id", "x"]).where("sample_id is not null")
    return written(percentiles.sorted_chunks(written(cells, "samples"), "sample_id", "x", MARKERS, "cell_key"), "chunks")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Samples and markers whose median is off the expected one by more than a factor of 2."""
    medians = percentiles.percentiles(_sample_chunks(spark, sf), [50.0]).join(_markers(spark, sf), "pos")
    off = (F.col("value") > 2 * F.col("expected_median")) | (F.col("value") < 0.5 * F.col("expected_median"))
    return medians.where(off).select(F.col("grp").alias("sample_id"), "marker")


def p3_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Five percentiles of every sample and marker, without error."""
    out = percentiles.percentiles(_sample_chunks(spark, sf), PERCENTS).join(_markers(spark, sf), "pos")
    return out.select(F.col("grp").alias("sample_id"), "marker", F.col("total").alias("n"), "percent", F.round("value", 6).alias("value"))


def p3_merged(spark: SparkSession, sf: str) -> DataFrame:
    """The same from thinned chunks of separate months put together; rank error at most 1 % of n."""
    cells = current_cells(spark, sf, ["sample_id", "x", "measured_at"]).where("sample_id is not null")
    cells = cells.withColumn("part", F.struct("sample_id", F.date_format("measured_at", "yyyy-MM").alias("month")))
    cells = written(cells.select("cell_key", "x", F.to_json("part").alias("part")), "months")
    chunks = percentiles.sorted_chunks(cells, "part", "x", MARKERS, "cell_key")
    thinned = percentiles.thin(chunks, 0.01).withColumn("grp", F.get_json_object("grp", "$.sample_id"))
    out = percentiles.thin_percentiles(thinned, PERCENTS).join(_markers(spark, sf), "pos")
    return out.select(F.col("grp").alias("sample_id"), "marker", F.col("total").alias("n"), "percent", "value")


def p3_merged_error(spark: SparkSession, sf: str) -> DataFrame:
    """How many of the merged percentiles are off by more than 1 % of the values in rank, by counting all values."""
    merged = written(p3_merged(spark, sf), "merged")
    cells = current_cells(spark, sf, ["sample_id", "x"]).where("sample_id is not null and x is not null")
    flat = cells.select("sample_id", F.posexplode("x").alias("pos", "v")).where("v is not null and not isnan(v)").join(_markers(spark, sf), "pos")
    met = flat.join(broadcast_if_small(merged.select("sample_id", "marker", "n", "percent", "value")), ["sample_id", "marker"])
    seen = met.groupBy("sample_id", "marker", "percent", "n").agg(F.sum((F.col("v") < F.col("value")).cast("long")).alias("below"), F.sum((F.col("v") <= F.col("value")).cast("long")).alias("upto"))
    rank = F.col("percent") / 100 * (F.col("n") - 1)
    off = F.greatest(F.col("below") - rank, rank - F.col("upto"), F.lit(0.0)) > 0.01 * F.col("n")
    return seen.agg(F.count(F.lit(1)).alias("percentiles"), F.sum(off.cast("long")).alias("off"))


# problem 4 ------------------------------------------------------------------


def _phenotypes(cells: DataFrame) -> DataFrame:
    """``plain``, ``phenotype`` (the commonest spelling, ties by name) and a number for each."""
    seen = cells.where("plain is not null").groupBy("plain", F.trim("phenotype").alias("phenotype")).count()
    best = seen.withColumn("r", F.row_number().over(Window.partitionBy("plain").orderBy(F.desc("count"), "phenotype"))).where("r = 1")
    # numbered in the order of the names
    return numbered(best.select("plain", "phenotype"), ["phenotype", "plain"], "number")


def _joined_phenotypes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Links as rows (sample, number, number), and the numbers' names."""
    cells = current_cells(spark, sf, ["sample_id", "phenotype"]).withColumn("plain", plain_text(F.col("phenotype")))
    cells = written(cells, "labels")
    names = written(_phenotypes(cells), "phenotypes")
    ends = cells.where("sample_id is not null").join(names.select("plain", "number"), "plain").select("cell_key", "sample_id", "number")
    links = table(spark, sf, "spatial_connectivities").where("src <> dst and (weight is null or weight <> 0)")
    links = links.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    met = links.join(ends.select(F.col("cell_key").alias("a"), F.col("sample_id").alias("sa"), F.col("number").alias("na")), "a")
    met = met.join(ends.select(F.col("cell_key").alias("b"), F.col("sample_id").alias("sb"), F.col("number").alias("nb")), "b")
    return met.where("sa = sb").select(F.col("sa").alias("sample_id"), "na", "nb"), names


def p4_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of phenotypes of every sample: links, those expected, odds ratio."""
    links, names = _joined_phenotypes(spark, sf)
    counts = written(together.pair_counts(links, "sample_id", "na", "nb"), "pairs")
    out = together.association(counts)
    for c in ("a", "b"):
        out = out.join(names.select(F.col("number").alias(c), F.col("phenotype").alias(f"phenotype_{c}")), c)
    return out.select(F.col("grp").alias("sample_id"), "phenotype_a", "phenotype_b", "n", "m", "d_a", "d_b", *[F.round(c, 6).alias(c) for c in ("lift", "odds_ratio", "log_odds")])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of different phenotypes joined far more often than by chance."""
    links, names = _joined_phenotypes(spark, sf)
    counts = written(together.pair_counts(links, "sample_id", "na", "nb"), "pairs")
    out = together.association(counts).where("a <> b and n >= 8 and lift > 2.47")
    for c in ("a", "b"):
        out = out.join(names.select(F.col("number").alias(c), F.col("phenotype").alias(f"phenotype_{c}")), c)
    return out.select(F.col("grp").alias("sample_id"), "phenotype_a", "phenotype_b")


# problem 6 ------------------------------------------------------------------


def _pages(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", *more, packing.token_count(F.col("text")).alias("size"))


def p6_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every page or piece of one, and the container it is in."""
    return packing.pack(_pages(spark, sf), "doc_id", "size", CAPACITY)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of pages larger than a container."""
    return p6_packing(spark, sf).where(F.col("size") > CAPACITY).select("doc_id", "piece_no")


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(p6_packing(spark, sf), CAPACITY)


def p6_fill_totals(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold whatever the containers: every token in one, a page in no more pieces than it needs, none overfull."""
    pieces = written(p6_packing(spark, sf), "pieces")
    over = pieces.groupBy("bin").agg(F.sum("piece_size").alias("t")).agg(F.sum((F.col("t") > CAPACITY).cast("long")).alias("overfull"))
    return pieces.agg(F.sum("piece_size").alias("tokens"), F.count(F.lit(1)).alias("pieces")).crossJoin(F.broadcast(over))  # one row


# problem 7 ------------------------------------------------------------------


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_pages(spark, sf, "source"), table(spark, sf, "mix_targets"), "doc_id", "source", "size")


def p7_draw(spark: SparkSession, sf: str) -> DataFrame:
    """The pages drawn and how often each is used."""
    return _mix(spark, sf)[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached share of each source."""
    return _mix(spark, sf)[1]


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources whose quota of the apportionment is all they have, and whose draw stays below their target share."""
    return _mix(spark, sf)[1].where("short and drawn < wanted").select("source")


def p7_quotas(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks apportioned to each source, and what they would be if repeats had no bound."""
    return _mix(spark, sf)[1].select("source", "pages", "available", "capacity", "blocks", "uncapped")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **cluster_queries.QUERIES,
    "p3_found": p3_found, "p3_percentiles": p3_percentiles, "p3_merged": p3_merged, "p3_merged_error": p3_merged_error,
    "p4_found": p4_found, "p4_pairs": p4_pairs,
    **vector_queries.QUERIES,
    "p6_found": p6_found, "p6_packing": p6_packing, "p6_fill": p6_fill, "p6_fill_totals": p6_fill_totals,
    "p7_found": p7_found, "p7_draw": p7_draw, "p7_shares": p7_shares, "p7_quotas": p7_quotas,
    **abuse_queries.QUERIES,
}
