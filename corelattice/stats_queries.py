"""Queries of sample-level tests, regressions and survival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corelattice.base import CELLS, cells
from corelattice.operators import stats, survival
from corelattice.plans.lineage import written
from corelattice.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return keep


# mean area of each sample, with the sample's label
_SAMPLES = f"""{CELLS}, sm AS (SELECT sample_id, max(label) AS label FROM sample_meta GROUP BY 1),
f AS (SELECT sample_id, label, avg(area) AS v FROM cells JOIN sm USING (sample_id) WHERE area IS NOT NULL GROUP BY ALL HAVING label IS NOT NULL)"""
_MOMENTS = f"{_SAMPLES}, m AS (SELECT 'A' AS label1, 'B' AS label2, count(*) FILTER (label = 'A') AS n1, count(*) FILTER (label = 'B') AS n2, avg(v) FILTER (label = 'A') AS m1, avg(v) FILTER (label = 'B') AS m2, var_samp(v) FILTER (label = 'A') AS v1, var_samp(v) FILTER (label = 'B') AS v2 FROM f)"


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    meta = table(spark, sf, "sample_meta").where("sample_id is not null").groupBy("sample_id").agg(F.max("label").alias("label"))
    return cells(spark, sf, "sample_id", "area").join(meta, "sample_id").groupBy("sample_id", "label").agg(F.avg("area").alias("v"))


def _rounded(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"WITH {_MOMENTS} SELECT label1, label2, round(m1 - m2, 8) AS difference, round(sqrt((1.96 * sqrt(v1) / sqrt(n1)) ** 2 + (1.96 * sqrt(v2) / sqrt(n2)) ** 2), 8) AS ci FROM m")
def diff_of_means(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.difference_of_means(_samples(spark, sf), "v", "label"), "difference", "ci")


@query(f"WITH {_MOMENTS} SELECT label1, label2, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)), 8) AS t, (n1 + n2 - 2)::DOUBLE AS df FROM m")
def t_stat(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.t_test(_samples(spark, sf), "v", "label").drop("p"), "t")


@query(f"WITH {_MOMENTS} SELECT label1, label2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 8) AS t, round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 6) AS df FROM m")
def welch_t(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_rounded(stats.t_test(_samples(spark, sf), "v", "label", False).drop("p"), "t"), "df", digits=6)


@query()
def t_pvalues(spark: SparkSession, sf: str) -> DataFrame:
    """Student's test of the area's sample means for every phenotype, with p-values adjusted by Hommel's method."""
    meta = table(spark, sf, "sample_meta").where("sample_id is not null").groupBy("sample_id").agg(F.max("label").alias("label"))
    own = cells(spark, sf, "sample_id", "area", "phenotype").where("phenotype is not null").join(meta, "sample_id")
    own = own.groupBy("sample_id", "label", "phenotype").agg(F.avg("area").alias("v"))
    return stats.adjust(written(stats.t_test(own, "v", "label", by=["phenotype"]), "tests"), "p", "hommel")


@query(f"WITH {_SAMPLES}, r AS (SELECT label, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r FROM f) SELECT 'A' AS label1, 'B' AS label2, count(*) FILTER (label = 'A') AS n1, count(*) FILTER (label = 'B') AS n2, (sum(r) FILTER (label = 'A') - count(*) FILTER (label = 'A') * (count(*) FILTER (label = 'A') + 1) / 2)::DOUBLE AS u FROM r")
def mannwhitney_u(spark: SparkSession, sf: str) -> DataFrame:
    return stats.mann_whitney(_samples(spark, sf), "v", "label").drop("p")


_OLS = f"""{CELLS}, sm AS (SELECT sample_id, max(label) AS label FROM sample_meta GROUP BY 1),
t AS (SELECT sample_id AS s, neighborhood AS nb, phenotype AS ct, count(*) AS n FROM cells WHERE sample_id IS NOT NULL AND neighborhood IS NOT NULL AND phenotype IS NOT NULL GROUP BY ALL),
y AS (SELECT s, nb, ct, log2(n / sum(n) OVER (PARTITION BY s, nb) + 0.001::DOUBLE) AS y FROM t),
x AS (SELECT s, ct, log2(n / sum(n) OVER (PARTITION BY s) + 0.001::DOUBLE) AS x FROM (SELECT s, ct, sum(n) AS n FROM t GROUP BY ALL)),
z AS (SELECT ct, nb, y, x, CASE label WHEN 'A' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS g FROM y JOIN x USING (s, ct) JOIN sm ON sample_id = s WHERE label IS NOT NULL),
a AS (SELECT ct, nb, count(*) AS m, var_pop(x) * count(*) AS cxx, var_pop(g) * count(*) AS cgg, covar_pop(x, g) * count(*) AS cxg, covar_pop(x, y) * count(*) AS cxy, covar_pop(g, y) * count(*) AS cgy, var_pop(y) * count(*) AS cyy FROM z GROUP BY ALL),
b AS (SELECT *, CASE WHEN m > 3 AND cxx * cgg - cxg * cxg > 1e-9 THEN cxx * cgg - cxg * cxg END AS det FROM a),
c AS (SELECT *, (cxx * cgy - cxg * cxy) / det AS coef, (cgg * cxy - cxg * cgy) / det AS bx FROM b)"""


def _enrichment(spark: SparkSession, sf: str) -> DataFrame:
    meta = table(spark, sf, "sample_meta").where("sample_id is not null").groupBy("sample_id").agg(F.max("label").alias("label"))
    own = cells(spark, sf, "sample_id", "neighborhood", "phenotype").join(meta, "sample_id", "left")
    return written(stats.enrichment(own, "neighborhood", "phenotype", "label", "sample_id"), "enrichment")


@query(f"WITH {_OLS} SELECT ct AS phenotype, nb AS neighbourhood, m, round(coef, 6) AS coef, round(coef / sqrt(greatest(cyy - bx * cxy - coef * cgy, 0) / (m - 3) * cxx / det), 6) AS t FROM c")
def cn_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_enrichment(spark, sf).drop("p"), "coef", "t", digits=6)


@query()
def cn_enrichment_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    return stats.adjust(_enrichment(spark, sf), "p", "bonferroni")


# one p-value for each sample: the share of cells in phase S stands for it
_P = f"""{CELLS}, p AS (SELECT sample_id, CASE WHEN count(*) >= 5 THEN count(*) FILTER (phase = 'S') / count(*)::DOUBLE END AS p FROM cells WHERE sample_id IS NOT NULL GROUP BY 1),
r AS (SELECT *, count(p) OVER () AS m, row_number() OVER (PARTITION BY p IS NULL ORDER BY p, sample_id) AS k FROM p)"""


def _p(spark: SparkSession, sf: str) -> DataFrame:
    share = F.avg((F.coalesce(F.col("phase") == "S", F.lit(False))).cast("double"))
    return written(cells(spark, sf, "sample_id", "phase").where("sample_id is not null").groupBy("sample_id").agg(F.when(F.count(F.lit(1)) >= 5, share).alias("p")), "p")


def _adjusted(spark: SparkSession, sf: str, method: str) -> DataFrame:
    return _rounded(stats.adjust(_p(spark, sf), "p", method), "p", "p_adjusted").select("sample_id", "p", "p_adjusted")


@query(f"WITH {_P} SELECT sample_id, round(p, 8) AS p, round(least(p * m, 1), 8) AS p_adjusted FROM r")
def p_adjust_bonferroni(spark: SparkSession, sf: str) -> DataFrame:
    return _adjusted(spark, sf, "bonferroni")


@query(f"WITH {_P} SELECT sample_id, round(p, 8) AS p, CASE WHEN p IS NOT NULL THEN round(least(max(p * (m - k + 1)) OVER (PARTITION BY p IS NULL ORDER BY k ROWS UNBOUNDED PRECEDING), 1), 8) END AS p_adjusted FROM r")
def p_adjust_holm(spark: SparkSession, sf: str) -> DataFrame:
    return _adjusted(spark, sf, "holm")


@query(f"WITH {_P} SELECT sample_id, round(p, 8) AS p, CASE WHEN p IS NOT NULL THEN round(least(min(p * m / k) OVER (PARTITION BY p IS NULL ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1), 8) END AS p_adjusted FROM r")
def p_adjust_bh(spark: SparkSession, sf: str) -> DataFrame:
    return _adjusted(spark, sf, "fdr_bh")


# survival -------------------------------------------------------------------

_SUBJECTS = "s AS (SELECT DISTINCT * FROM sample_meta WHERE label IS NOT NULL AND event IS NOT NULL AND time IS NOT NULL AND NOT isnan(time))"


def _subjects(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sample_meta").distinct()


@query(
    f"""WITH {_SUBJECTS}, p AS (SELECT label, time, count(*) FILTER (event) AS d, count(*) AS c FROM s GROUP BY ALL),
n AS (SELECT *, sum(c) OVER (PARTITION BY label ORDER BY time DESC)::BIGINT AS n FROM p),
k AS (SELECT *, CASE WHEN max((d = n)::INTEGER) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER w) END AS surv,
  sum(CASE WHEN d < n THEN d / (n * (n - d)::DOUBLE) ELSE 0 END) OVER w AS g FROM n WINDOW w AS (PARTITION BY label ORDER BY time))
SELECT label AS stratum, time, d AS events, n AS at_risk, round(surv, 9) AS survival,
  CASE WHEN surv > 0 AND surv < 1 THEN round(exp(-exp(ln(-ln(surv)) + 1.959963984540054 * sqrt(g) / abs(ln(surv)))), 8) END AS low,
  CASE WHEN surv > 0 AND surv < 1 THEN round(exp(-exp(ln(-ln(surv)) - 1.959963984540054 * sqrt(g) / abs(ln(surv)))), 8) END AS high FROM k"""
)
def kaplan_meier(spark: SparkSession, sf: str) -> DataFrame:
    out = survival.kaplan_meier(_subjects(spark, sf), "event", "time", "label")
    return _rounded(_rounded(out, "survival", digits=9), "low", "high")


@query(
    f"""WITH {_SUBJECTS}, t AS (SELECT DISTINCT label FROM s), k AS (SELECT label, unnest(range(0, (SELECT ceil(max(time) / 5) FROM s)::BIGINT + 1)) * 5.0::DOUBLE AS tick FROM t)
SELECT k.label AS stratum, tick, count(s.time) AS at_risk FROM k LEFT JOIN s ON s.label = k.label AND (s.time > tick OR (s.time = tick AND NOT event)) GROUP BY ALL"""
)
def at_risk(spark: SparkSession, sf: str) -> DataFrame:
    return survival.at_risk(_subjects(spark, sf), "event", "time", "label")


def _covariates(spark: SparkSession, sf: str) -> DataFrame:
    own = cells(spark, sf, "sample_id", "area", "n_genes", "eccentricity").groupBy("sample_id").agg(*[F.avg(c).alias(c) for c in ("area", "n_genes", "eccentricity")])
    return written(own.join(_subjects(spark, sf), "sample_id").where("time is not null"), "subjects")


@query()
def cox_path(spark: SparkSession, sf: str) -> DataFrame:
    path = survival.cox(_covariates(spark, sf), "event", "time", ["area", "n_genes", "eccentricity"], [0.1, 0.01, 0.001])
    rows = [(s["penalty"], c, v, s["log_likelihood"]) for s in path for c, v in s["coef"].items()]
    return spark.createDataFrame(rows, "penalty double, covariate string, coef double, log_likelihood double")


@query()
def cox_top(spark: SparkSession, sf: str) -> DataFrame:
    """The two largest coefficients, and the concordance of the fitted risk."""
    own = _covariates(spark, sf)
    path = survival.cox(own, "event", "time", ["area", "n_genes", "eccentricity"], [0.001])
    risk = sum((F.col(c) * v for c, v in path[0]["coef"].items()), F.lit(0.0))
    score = survival.concordance(own.withColumn("risk", risk), "event", "time", "risk")
    return spark.createDataFrame([(c, v, score) for c, v in survival.top_coefficients(path, 2)], "covariate string, coef double, concordance double")
