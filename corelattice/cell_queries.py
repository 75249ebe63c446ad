"""Queries of filters, transforms, aggregates and metadata joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corelattice.base import CELLS, LONG, MARKERS, VAR, cells, long
from corelattice.operators import aggregate as A
from corelattice.operators import filters, markers, metadata
from corelattice.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return keep


# filters --------------------------------------------------------------------


@query(f"WITH {CELLS} SELECT cell_key, phenotype FROM cells WHERE phenotype IN (SELECT phenotype FROM cells GROUP BY 1 HAVING count(*) > 500)")
def filter_obs_count(spark: SparkSession, sf: str) -> DataFrame:
    return filters.by_count(cells(spark, sf, "phenotype"), "phenotype", 500).select("cell_key", "phenotype")


@query(f"WITH {CELLS} SELECT cell_key, n_genes FROM cells WHERE n_genes > 850 AND n_genes < 950")
def filter_obs_value(spark: SparkSession, sf: str) -> DataFrame:
    return filters.by_value(cells(spark, sf, "n_genes"), "n_genes", 850, 950)


@query(f"WITH {CELLS}, q AS (SELECT quantile_cont(area, 0.1) AS lo, quantile_cont(area, 0.95) AS hi FROM cells) SELECT cell_key, area FROM cells, q WHERE area > lo AND area < hi")
def filter_obs_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return filters.by_quantile(cells(spark, sf, "area"), "area", 0.1, 0.95)


@query(f"WITH {CELLS} SELECT cell_key, x[1] AS value FROM cells WHERE x[1] > 1 AND x[1] < 254")
def filter_var_value(spark: SparkSession, sf: str) -> DataFrame:
    return filters.by_marker_value(cells(spark, sf, "x"), "x", 0).select("cell_key", markers.marker("x", 0).alias("value"))


@query(
    f"""WITH {CELLS}, a AS (SELECT cell_key, x[2] AS value FROM cells WHERE x[2] > (SELECT quantile_cont(x[2], 0.05) FROM cells))
SELECT * FROM a WHERE value < (SELECT quantile_cont(value, 0.99) FROM a)"""
)
def filter_var_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return filters.by_marker_quantile(cells(spark, sf, "x"), "x", 1).select("cell_key", markers.marker("x", 1).alias("value"))


@query(f"WITH {CELLS} SELECT cell_key, unnest([0, 1, 2])::INTEGER AS pos, round(unnest([x[3], x[8], x[1]]), 6) AS value FROM cells WHERE x IS NOT NULL")
def subset_var(spark: SparkSession, sf: str) -> DataFrame:
    return long(markers.subset_markers(cells(spark, sf, "x"), "x", VAR, ["STV3", "KIP8", "NUX1"]), "x")


@query(f"WITH {CELLS} SELECT cell_key, phase FROM cells WHERE phase IN ('G1', 'S')")
def subset_obs(spark: SparkSession, sf: str) -> DataFrame:
    return filters.by_category(cells(spark, sf, "phase"), "phase", ["G1", "S"])


@query(f"WITH {CELLS} SELECT cell_key, neighborhood AS part FROM cells WHERE neighborhood IN ('N1', 'N2', 'N3')")
def split_by_obs(spark: SparkSession, sf: str) -> DataFrame:
    parts = filters.split(cells(spark, sf, "neighborhood"), "neighborhood", ["N1", "N2", "N3"])
    out = [d.select("cell_key", F.lit(v).alias("part")) for v, d in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"WITH {CELLS} SELECT cell_key, phenotype FROM cells WHERE phenotype IS NOT NULL")
def drop_null_phenotype(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf, "phenotype").where("phenotype is not null")


@query(f"WITH {CELLS} SELECT cell_key, CASE phenotype WHEN 'helper-l' THEN 'T' WHEN 'killer-l' THEN 'T' WHEN 'mantle-b' THEN 'B' ELSE 'nan' END AS lineage FROM cells")
def relabel(spark: SparkSession, sf: str) -> DataFrame:
    mapped = filters.relabel(cells(spark, sf, "phenotype"), "phenotype", {"helper-l": "T", "killer-l": "T", "mantle-b": "B"}, "lineage")
    return mapped.select("cell_key", "lineage")


@query(f"WITH {CELLS} SELECT cell_key, unnest(range(18))::INTEGER AS pos, round(unnest(list_concat(x, [area, n_genes::DOUBLE])), 6) AS value FROM cells WHERE x IS NOT NULL")
def add_obs_as_var(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = markers.add_obs_as_markers(cells(spark, sf, "x", "area", "n_genes"), "x", VAR, ["area", "n_genes"])
    return long(out, "augmented_x")


@query(f"WITH {CELLS}, c AS (SELECT phenotype, count(*) AS n FROM cells WHERE phenotype IS NOT NULL GROUP BY 1) SELECT phenotype, n, CASE WHEN n > 600 THEN (row_number() OVER (ORDER BY n DESC, phenotype) - 1)::INTEGER ELSE -1 END AS number FROM c")
def sort_by_size(spark: SparkSession, sf: str) -> DataFrame:
    out = filters.with_size_rank(cells(spark, sf, "phenotype").where("phenotype is not null"), "phenotype", 600, "number")
    return out.groupBy("phenotype", "number").agg(F.count(F.lit(1)).alias("n")).select("phenotype", "n", "number")


# transforms -----------------------------------------------------------------


@query(f"WITH {CELLS}, {LONG} SELECT cell_key, pos, round(coalesce(v, 0), 6) AS value FROM m")
def fill_na(spark: SparkSession, sf: str) -> DataFrame:
    return long(markers.fill_na(cells(spark, sf, "x"), "x", MARKERS), "x")


@query(f"WITH {CELLS}, {LONG} SELECT cell_key, pos, round(ln(1 + v), 6) AS value FROM m")
def log1p(spark: SparkSession, sf: str) -> DataFrame:
    return long(markers.log1p(cells(spark, sf, "x"), "x", MARKERS), "x")


@query(f"WITH {CELLS}, {LONG} SELECT cell_key, pos, round(asinh(v / 150), 6) AS value FROM m")
def arcsinh(spark: SparkSession, sf: str) -> DataFrame:
    return long(markers.arcsinh(cells(spark, sf, "x"), "x", MARKERS), "x")


@query(f"WITH {CELLS}, {LONG} SELECT cell_key, pos, round((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 6) AS value FROM m WINDOW w AS (PARTITION BY cell_key)")
def zscore_row(spark: SparkSession, sf: str) -> DataFrame:
    return long(markers.zscore_rows(cells(spark, sf, "x"), "x", MARKERS), "x")


@query(f"WITH {CELLS}, {LONG}, s AS (SELECT pos, avg(v) AS a, coalesce(nullif(stddev_samp(v), 0), 1) AS d FROM m GROUP BY 1) SELECT cell_key, pos, round((v - a) / d, 6) AS value FROM m JOIN s USING (pos)")
def scale_col(spark: SparkSession, sf: str) -> DataFrame:
    return long(markers.scale_columns(cells(spark, sf, "x"), "x", MARKERS), "x")


@query(
    f"""WITH {CELLS}, {LONG}, f AS (SELECT cell_key, pos, coalesce(v, 0) AS v FROM m), s AS (SELECT pos, min(v) AS lo, quantile_cont(v, 0.95) AS hi FROM f GROUP BY 1)
SELECT cell_key, pos, round((v - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS value FROM f JOIN s USING (pos)"""
)
def percentile_norm(spark: SparkSession, sf: str) -> DataFrame:
    return long(markers.percentile_normalise(cells(spark, sf, "x"), "x", MARKERS), "x")


@query(f"WITH {CELLS}, {LONG} SELECT cell_key, pos, round(log2(v / nullif(sum(v) OVER (PARTITION BY cell_key), 0) + 0.001), 6) AS value FROM m")
def normalise_log2p(spark: SparkSession, sf: str) -> DataFrame:
    return long(markers.normalise_log2p(cells(spark, sf, "x"), "x", MARKERS), "x")


@query(
    f"""WITH {CELLS}, {LONG}, a AS (SELECT cell_key, pos, asinh(coalesce(v, 0) / 150) AS v FROM m),
s AS (SELECT cell_key, pos, (v - avg(v) OVER (PARTITION BY pos)) / coalesce(nullif(stddev_samp(v) OVER (PARTITION BY pos), 0), 1) AS v FROM a)
SELECT cell_key, pos, round((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 6) AS value FROM s WINDOW w AS (PARTITION BY cell_key)"""
)
def transform_chain(spark: SparkSession, sf: str) -> DataFrame:
    return long(markers.chain(cells(spark, sf, "x"), "x", MARKERS, ["fill_na", "arcsinh", "scale", "zscore"], "layer"), "layer")


# aggregates -----------------------------------------------------------------


@query(f"WITH {CELLS} SELECT sample_id, count(*) AS n FROM cells WHERE sample_id IS NOT NULL GROUP BY 1")
def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.row_counts(cells(spark, sf, "sample_id"), "sample_id")


@query(f"WITH {CELLS} SELECT s.sample_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT sample_id FROM sample_meta WHERE sample_id IS NOT NULL) s LEFT JOIN (SELECT sample_id, count(*) AS n FROM cells GROUP BY 1) USING (sample_id)")
def row_counts_domain(spark: SparkSession, sf: str) -> DataFrame:
    return A.row_counts(cells(spark, sf, "sample_id"), "sample_id", table(spark, sf, "sample_meta").where("sample_id is not null"))


@query(f"WITH {CELLS} SELECT sample_id, phenotype, neighborhood, count(*) AS n FROM cells WHERE sample_id IS NOT NULL AND phenotype IS NOT NULL AND neighborhood IS NOT NULL GROUP BY ALL")
def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.category_counts(cells(spark, sf, "sample_id", "phenotype", "neighborhood"), "sample_id", ["phenotype", "neighborhood"])


@query(f"WITH {CELLS} SELECT sample_id, count(*) FILTER (phase = 'G1') AS g1, count(*) FILTER (phase = 'S') AS s, count(*) FILTER (phase = 'G2M') AS g2m FROM cells WHERE sample_id IS NOT NULL AND phase IS NOT NULL GROUP BY 1")
def category_counts_wide(spark: SparkSession, sf: str) -> DataFrame:
    counts = A.category_counts(cells(spark, sf, "sample_id", "phase"), "sample_id", ["phase"])
    wide = A.widen(counts, "sample_id", "phase", "n", ["G1", "S", "G2M"]).fillna(0)
    return wide.select("sample_id", F.col("G1").alias("g1"), F.col("S").alias("s"), F.col("G2M").alias("g2m"))


@query(f"WITH {CELLS} SELECT *, round(n / sum(n) OVER (PARTITION BY sample_id), 9) AS proportion FROM (SELECT sample_id, phenotype, count(*) AS n FROM cells WHERE sample_id IS NOT NULL AND phenotype IS NOT NULL GROUP BY ALL)")
def category_props(spark: SparkSession, sf: str) -> DataFrame:
    out = A.category_proportions(cells(spark, sf, "sample_id", "phenotype"), "sample_id", ["phenotype"])
    return out.withColumn("proportion", F.round("proportion", 9))


@query(f"WITH {CELLS} SELECT *, round(n / sum(n) OVER (PARTITION BY sample_id, neighborhood), 9) AS proportion FROM (SELECT sample_id, neighborhood, phenotype, count(*) AS n FROM cells WHERE sample_id IS NOT NULL AND phenotype IS NOT NULL AND neighborhood IS NOT NULL GROUP BY ALL)")
def category_props_norm(spark: SparkSession, sf: str) -> DataFrame:
    out = A.category_proportions(cells(spark, sf, "sample_id", "phenotype", "neighborhood"), "sample_id", ["neighborhood", "phenotype"], "neighborhood")
    return out.withColumn("proportion", F.round("proportion", 9))


@query(
    f"""WITH {CELLS} SELECT sample_id, round(sum(area), 4) AS sum_area, max(area) AS max_area, min(area) AS min_area, min_by(area, cell_key) AS first_area, max_by(area, cell_key) AS last_area,
round(avg(area), 9) AS mean_area, round(median(area), 9) AS median_area FROM cells WHERE sample_id IS NOT NULL GROUP BY 1"""
)
def num_summarised(spark: SparkSession, sf: str) -> DataFrame:
    out = A.summarised(cells(spark, sf, "sample_id", "area"), "sample_id", "area", list(A.SUMMARIES), "cell_key")
    return out.withColumns({"sum_area": F.round("sum_area", 4), "mean_area": F.round("mean_area", 9), "median_area": F.round("median_area", 9)})


@query(f"WITH {CELLS} SELECT sample_id, phenotype, round(avg(area), 9) AS mean_area FROM cells WHERE sample_id IS NOT NULL AND phenotype IS NOT NULL GROUP BY ALL")
def num_summarised_by_category(spark: SparkSession, sf: str) -> DataFrame:
    out = A.summarised(cells(spark, sf, "sample_id", "area", "phenotype"), "sample_id", "area", ["mean"], "cell_key", ["phenotype"])
    return out.withColumn("mean_area", F.round("mean_area", 9))


BREAKS = [0, 50, 80, 120, 200]
_BINS = "unnest(['(0, 50]', '(50, 80]', '(80, 120]', '(120, 200]']) AS bin"
_BIN_OF = "CASE WHEN area > 0 AND area <= 50 THEN '(0, 50]' WHEN area > 50 AND area <= 80 THEN '(50, 80]' WHEN area > 80 AND area <= 120 THEN '(80, 120]' WHEN area > 120 AND area <= 200 THEN '(120, 200]' END AS bin"
_BINNED = f"""{CELLS}, g AS (SELECT sample_id, {_BINS} FROM (SELECT DISTINCT sample_id FROM cells WHERE sample_id IS NOT NULL)),
b AS (SELECT sample_id, {_BIN_OF} FROM cells), c AS (SELECT sample_id, bin, count(*) AS n FROM b GROUP BY ALL),
r AS (SELECT g.sample_id, g.bin, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (sample_id, bin))"""


@query(f"WITH {_BINNED} SELECT * FROM r")
def num_binned(spark: SparkSession, sf: str) -> DataFrame:
    return A.binned(cells(spark, sf, "sample_id", "area"), "sample_id", "area", BREAKS)


@query(f"WITH {_BINNED} SELECT sample_id, bin, n, round(n / nullif(sum(n) OVER (PARTITION BY sample_id), 0), 9) AS proportion FROM r")
def num_binned_norm(spark: SparkSession, sf: str) -> DataFrame:
    return A.binned(cells(spark, sf, "sample_id", "area"), "sample_id", "area", BREAKS, True).withColumn("proportion", F.round("proportion", 9))


@query(f"WITH {CELLS}, b AS (SELECT *, {_BIN_OF} FROM cells) SELECT sample_id, bin AS binned_area, round(avg(n_genes), 9) AS mean_n_genes FROM b WHERE sample_id IS NOT NULL AND bin IS NOT NULL GROUP BY ALL")
def num_binned_agg(spark: SparkSession, sf: str) -> DataFrame:
    out = A.binned_summary(cells(spark, sf, "sample_id", "area", "n_genes"), "sample_id", "area", "n_genes", BREAKS, "mean", "cell_key")
    return out.withColumn("mean_n_genes", F.round("mean_n_genes", 9))


@query(f"WITH {CELLS} SELECT sample_id, (row_number() OVER (PARTITION BY sample_id ORDER BY cell_key) - 1)::INTEGER AS pos, area FROM cells WHERE sample_id IS NOT NULL")
def num_widened(spark: SparkSession, sf: str) -> DataFrame:
    return A.widened(cells(spark, sf, "sample_id", "area"), "sample_id", "area", "cell_key")


_KEYED = f"""{CELLS}, sm AS (SELECT DISTINCT * FROM sample_meta), j AS (SELECT c.*, sm.grouping, sm.label FROM cells c LEFT JOIN sm USING (sample_id) WHERE sample_id IS NOT NULL)"""
_ROLE_COLUMNS = ["grouping", "label", "phase", "phenotype", "neighborhood", "lyr"]


def _with_meta(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return metadata.attach(cells(spark, sf, "sample_id", *columns), table(spark, sf, "sample_meta"), "sample_id")


@query(f"WITH {_KEYED} " + " UNION ALL ".join(f"SELECT sample_id, '{c}' AS \"column\", count(DISTINCT {c}) AS n FROM j GROUP BY 1" for c in _ROLE_COLUMNS))
def key_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    return A.cardinality(_with_meta(spark, sf, "phase", "phenotype", "neighborhood", "lyr"), "sample_id", _ROLE_COLUMNS)


@query(
    f"WITH {_KEYED}, k AS ("
    + " UNION ALL ".join(f"SELECT sample_id, '{c}' AS c, count(DISTINCT {c}) AS n FROM j GROUP BY 1" for c in _ROLE_COLUMNS)
    + "), t AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS c, count(DISTINCT {c}) AS total FROM j" for c in _ROLE_COLUMNS)
    + """) SELECT c AS "column", max(n) AS most, count(*) AS groups, any_value(total) AS total, CASE WHEN max(n) > 1 THEN 'super' WHEN any_value(total) = count(*) THEN 'true_parallel' ELSE 'duplicated' END AS role FROM k JOIN t USING (c) GROUP BY 1"""
)
def key_roles(spark: SparkSession, sf: str) -> DataFrame:
    return A.key_roles(_with_meta(spark, sf, "phase", "phenotype", "neighborhood", "lyr"), "sample_id", _ROLE_COLUMNS).select("column", "most", "groups", "total", "role")


@query(f"WITH {_KEYED} SELECT sample_id, max(grouping) AS grouping FROM j GROUP BY 1")
def parallel_value(spark: SparkSession, sf: str) -> DataFrame:
    return A.metadata(_with_meta(spark, sf), "sample_id", "grouping")


@query(f"WITH {CELLS} SELECT sample_id, 'phenotype$' || phenotype || '@phase$' || phase AS feature, count(*) AS value FROM cells WHERE sample_id IS NOT NULL AND phenotype IS NOT NULL AND phase IS NOT NULL GROUP BY ALL")
def feature_frame(spark: SparkSession, sf: str) -> DataFrame:
    counts = A.category_counts(cells(spark, sf, "sample_id", "phenotype", "phase"), "sample_id", ["phenotype", "phase"])
    return A.feature_frame(counts, "sample_id", ["phenotype", "phase"], "n")


@query(f"WITH {_KEYED}, p AS (SELECT sample_id, phenotype, count(*) AS n FROM j WHERE phenotype IS NOT NULL GROUP BY ALL), g AS (SELECT sample_id, max(grouping) AS grouping, max(label) AS label FROM j GROUP BY 1) SELECT sample_id, phenotype, n, round(n / sum(n) OVER (PARTITION BY sample_id), 9) AS proportion, grouping, label FROM p JOIN g USING (sample_id)")
def sample_level(spark: SparkSession, sf: str) -> DataFrame:
    out = A.sample_level(_with_meta(spark, sf, "phenotype"), "sample_id", "phenotype", ["grouping", "label"])
    return out.withColumn("proportion", F.round("proportion", 9))


@query(f"WITH {CELLS} SELECT DISTINCT sample_id FROM cells WHERE sample_id IS NOT NULL")
def distinct_samples(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf, "sample_id").where("sample_id is not null").select("sample_id").distinct()


@query(f"WITH {CELLS}, {LONG}, s AS (SELECT phenotype, count(*) AS size FROM cells WHERE phenotype IS NOT NULL GROUP BY 1) SELECT phenotype, size, pos, round(avg(v), 6) AS mean FROM m JOIN cells USING (cell_key) JOIN s USING (phenotype) GROUP BY ALL")
def group_mean_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return A.group_means(cells(spark, sf, "phenotype", "x"), "phenotype", "x", MARKERS).withColumn("mean", F.round("mean", 6))


@query(f"WITH {CELLS} SELECT CASE WHEN area < 0 THEN 0 WHEN area >= 300 THEN 31 ELSE floor(area / 10) + 1 END::INTEGER AS bin, count(*) AS n FROM cells WHERE area IS NOT NULL GROUP BY 1")
def qc_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return A.histogram(cells(spark, sf, "area"), "area", 0, 300, 30)


# metadata and trees ---------------------------------------------------------


@query(f"""WITH {CELLS}, sm AS (SELECT DISTINCT * FROM sample_meta) SELECT cell_key, sample_id, label, "grouping", event, time FROM cells LEFT JOIN sm USING (sample_id)""")
def metadata_left_join(spark: SparkSession, sf: str) -> DataFrame:
    return _with_meta(spark, sf).select("cell_key", "sample_id", "label", "grouping", "event", "time")


@query(f"WITH {CELLS} SELECT cell_key, CASE WHEN phase = 'G1' AND phenotype IS NOT NULL THEN phenotype ELSE neighborhood END AS neighborhood FROM cells")
def backpropagate_obs(spark: SparkSession, sf: str) -> DataFrame:
    own = cells(spark, sf, "neighborhood", "phase", "phenotype")
    child = own.where("phase = 'G1'").select("cell_key", F.col("phenotype").alias("neighborhood"))
    return metadata.absorb(own, child, "cell_key", ["neighborhood"]).select("cell_key", "neighborhood")


@query(f"WITH {CELLS} SELECT cell_key, phase, CASE WHEN phase = 'S' THEN n_genes::DOUBLE END AS n_genes FROM cells")
def inherit_obs(spark: SparkSession, sf: str) -> DataFrame:
    own = cells(spark, sf, "phase", "n_genes")
    return metadata.inherit(own.select("cell_key", "phase"), own.where("phase = 'S'").select("cell_key", F.col("n_genes").cast("double").alias("n_genes")), "cell_key")


@query(f"WITH {CELLS} SELECT cell_key, area, n_genes FROM cells WHERE phase = 'S'")
def restore_features(spark: SparkSession, sf: str) -> DataFrame:
    own = cells(spark, sf, "phase", "area", "n_genes")
    return metadata.restore(own.select("cell_key", "area", "n_genes"), own.where("phase = 'S'"), "cell_key")


_TREE = "nodes AS (SELECT 'root' AS node, NULL AS parent UNION SELECT DISTINCT image, 'root' FROM cores_gdf UNION SELECT DISTINCT image || '/' || tma_label, image FROM cores_gdf WHERE tma_label <> '')"


@query(
    f"""WITH RECURSIVE {_TREE}, t AS (SELECT node, parent, 0 AS depth, node AS path FROM nodes WHERE node = 'root' UNION ALL SELECT n.node, n.parent, t.depth + 1, t.path || '/' || n.node FROM nodes n JOIN t ON n.parent = t.node)
SELECT node, parent, depth, path, node NOT IN (SELECT parent FROM nodes WHERE parent IS NOT NULL) AS terminal FROM t"""
)
def tree_walk(spark: SparkSession, sf: str) -> DataFrame:
    cores = table(spark, sf, "cores_gdf")
    root = spark.range(1).select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"))
    images = cores.select(F.col("image").alias("node"), F.lit("root").alias("parent")).distinct()
    labels = cores.where("tma_label <> ''").select(F.concat_ws("/", "image", "tma_label").alias("node"), F.col("image").alias("parent")).distinct()
    return metadata.walk(root.unionByName(images).unionByName(labels), "root")
