"""Two-group tests, regression per cell type and neighbourhood, multiple testing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corelattice.functions.special import normal_two_sided, t_pvalue, u_exact_table
from corelattice.plans.ranks import summed_before


def moments(df: DataFrame, feature: str, label: str, by: list[str] | None = None) -> DataFrame:
    """``n``, ``mean``, ``var`` of both labels side by side: suffix 1 is the lesser label.

    NULL labels and NULL or NaN features are left out.  Other than two labels
    (in a group of ``by``) gives no row.
    """
    by = by or []
    v = F.col(feature).cast("double")
    d = df.where(F.col(label).isNotNull() & v.isNotNull() & ~F.isnan(v)).withColumn("__v", v).withColumn("__l", F.col(label).cast("string"))
    per = d.groupBy(*by, "__l").agg(F.count(F.lit(1)).alias("n"), F.avg("__v").alias("mean"), F.var_samp("__v").alias("var"))
    per = per.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__l", "n", "mean", "var"))).alias("s")).where(F.size("s") == 2)
    return per.select(*by, *[F.col("s")[i][c].alias(f"{o}{i + 1}") for i in (0, 1) for c, o in (("__l", "label"), ("n", "n"), ("mean", "mean"), ("var", "var"))])


def difference_of_means(df: DataFrame, feature: str, label: str) -> DataFrame:
    """``difference`` (first less second label) and ``ci``, the root of both squared 95 % half-widths."""
    half = [F.pow(F.lit(1.96) * F.sqrt(F.col(f"var{i}")) / F.sqrt(F.col(f"n{i}").cast("double")), 2) for i in (1, 2)]
    return moments(df, feature, label).select("label1", "label2", (F.col("mean1") - F.col("mean2")).alias("difference"), F.sqrt(half[0] + half[1]).alias("ci"))


def t_test(df: DataFrame, feature: str, label: str, equal_var: bool = True, by: list[str] | None = None) -> DataFrame:
    """``t``, ``df``, ``p``: Student's test with pooled variance, or Welch's.  NULL where a variance is missing or 0."""
    m = moments(df, feature, label, by)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    if equal_var:
        dof = n1 + n2 - 2
        se2 = ((n1 - 1) * F.col("var1") + (n2 - 1) * F.col("var2")) / F.nullif(dof, F.lit(0.0)) * (1 / n1 + 1 / n2)
    else:
        a, b = F.col("var1") / n1, F.col("var2") / n2
        se2 = a + b
        dof = se2 * se2 / F.nullif(a * a / (n1 - 1) + b * b / (n2 - 1), F.lit(0.0))
    t = (F.col("mean1") - F.col("mean2")) / F.nullif(F.sqrt(se2), F.lit(0.0))
    out = m.select(*(by or []), "label1", "label2", t.alias("t"), dof.alias("df"))
    return out.withColumn("p", t_pvalue("t", "df"))


def mann_whitney(df: DataFrame, feature: str, label: str) -> DataFrame:
    """``u`` of the lesser label by mid-ranks, and ``p``.

    Exact for samples of at most 8 each without ties, else normal with tie and
    continuity correction.  Equal values are counted first, so ranks are taken
    over different values.
    """
    v = F.col(feature).cast("double")
    d = df.where(F.col(label).isNotNull() & v.isNotNull() & ~F.isnan(v)).select(v.alias("v"), F.col(label).cast("string").alias("l"))
    two = d.agg(F.min("l").alias("l1"), F.max("l").alias("l2"), F.count_distinct("l").alias("n"))
    d = d.crossJoin(F.broadcast(two)).where("n = 2")  # one row
    per = d.groupBy("v").agg(F.sum((F.col("l") == F.col("l1")).cast("double")).alias("a"), F.count(F.lit(1)).cast("double").alias("t"), F.max("l1").alias("label1"), F.max("l2").alias("label2"))
    per = summed_before(per, ["v"], "t", "before").withColumn("rank", F.col("before") + (F.col("t") + 1) / 2)
    s = per.groupBy("label1", "label2").agg(F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum("a").alias("n1"), F.sum("t").alias("n"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    s = s.withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2).withColumn("n2", F.col("n") - F.col("n1"))

    @F.pandas_udf("double")
    def p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
        out = []
        for a, x, y, t in zip(u, n1, n2, ties):
            x, y = int(x), int(y)
            top = max(a, x * y - a)
            if x <= 8 and y <= 8 and t == 0:
                ways = u_exact_table(x, y)
                out.append(float(min(1.0, 2 * ways[int(top) :].sum() / ways.sum())))
                continue
            n = x + y
            sd = (x * y / 12 * (n + 1 - t / (n * (n - 1)))) ** 0.5 if n > 1 else 0.0
            out.append(min(1.0, normal_two_sided(max(top - x * y / 2 - 0.5, 0) / sd)) if sd else 1.0)
        return pd.Series(out, dtype="float64")

    return s.withColumn("p", p("u", "n1", "n2", "ties")).select("label1", "label2", F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"), "u", "p")


def design_matrix(y: DataFrame, x: DataFrame, g: DataFrame, key: str) -> DataFrame:
    """Rows of ``key`` with ``y``, ``x``, ``g`` and ``f`` = 1 where all are present."""
    return y.select(key, "y").join(x.select(key, "x"), key).join(g.select(key, "g"), key).dropna().withColumn("f", F.lit(1.0))


def enrichment(cells: DataFrame, neighbourhood: str, phenotype: str, label: str, sample: str, pseudocount: float = 1e-3, x_pseudocount: float = 1e-3, absent: str = "drop") -> DataFrame:
    """``phenotype``, ``neighbourhood``, ``m``, ``coef``, ``t``, ``p`` of the label in Y ~ X + G + 1 over samples.

    Y: log2 share of the phenotype among the sample's cells of the neighbourhood,
    X: log2 share in the sample, G: number of the label in alphabetical order (two
    labels).  ``absent``: combinations without cells are left out (``drop``) or
    count as share 0 (``zero``).  One grouped aggregate of the sums of the normal
    equations, solved in closed form.  Fewer than 4 samples or a singular system:
    NULL.  Cells with a NULL in any of the four columns are left out.
    """
    if absent not in ("drop", "zero"):
        raise ValueError(f"absent must be drop or zero, not {absent}")
    d = cells.select(F.col(neighbourhood).alias("nb"), F.col(phenotype).alias("ct"), F.col(label).cast("string").alias("l"), F.col(sample).alias("s"))
    typed = d.dropna(subset=["nb", "ct", "s"]).groupBy("s", "nb", "ct").agg(F.count(F.lit(1)).alias("n"), F.max("l").alias("l"))
    in_nb = typed.withColumn("y", F.col("n") / F.sum("n").over(Window.partitionBy("s", "nb")))
    in_s = typed.groupBy("s", "ct").agg(F.sum("n").alias("ns"))
    in_s = in_s.withColumn("x", F.col("ns") / F.sum("ns").over(Window.partitionBy("s"))).select("s", "ct", "x")
    if absent == "zero":
        parts = typed.select("s", "nb").distinct().join(in_s, "s")
        rows = parts.join(in_nb.select("s", "nb", "ct", "y"), ["s", "nb", "ct"], "left").fillna(0.0, ["y"])
    else:
        rows = in_nb.select("s", "nb", "ct", "y").join(in_s, ["s", "ct"])
    labels = d.dropna(subset=["s", "l"]).groupBy("s").agg(F.max("l").alias("l"))
    first = labels.agg(F.min("l").alias("l0"))
    g = labels.crossJoin(F.broadcast(first)).select("s", (F.col("l") != F.col("l0")).cast("double").alias("g"))
    z = rows.join(g, "s").select("ct", "nb", F.log2(F.col("y") + pseudocount).alias("y"), F.log2(F.col("x") + x_pseudocount).alias("x"), "g")
    sums = {"sx": "x", "sg": "g", "sy": "y", "sxx": "x*x", "sgg": "g*g", "sxg": "x*g", "sxy": "x*y", "sgy": "g*y", "syy": "y*y"}
    a = z.groupBy("ct", "nb").agg(F.count(F.lit(1)).alias("m"), *[F.sum(F.expr(e)).alias(c) for c, e in sums.items()])
    # centred sums: the intercept drops out
    for c, (p, q, s) in {"cxx": ("sx", "sx", "sxx"), "cgg": ("sg", "sg", "sgg"), "cxg": ("sx", "sg", "sxg"), "cxy": ("sx", "sy", "sxy"), "cgy": ("sg", "sy", "sgy"), "cyy": ("sy", "sy", "syy")}.items():
        a = a.withColumn(c, F.col(s) - F.col(p) * F.col(q) / F.col("m"))
    det = F.col("cxx") * F.col("cgg") - F.col("cxg") * F.col("cxg")
    a = a.withColumn("det", F.when((F.col("m") > 3) & (det > 1e-9), det))
    a = a.withColumn("coef", (F.col("cxx") * F.col("cgy") - F.col("cxg") * F.col("cxy")) / F.col("det"))
    bx = (F.col("cgg") * F.col("cxy") - F.col("cxg") * F.col("cgy")) / F.col("det")
    rss = F.col("cyy") - bx * F.col("cxy") - F.col("coef") * F.col("cgy")
    a = a.withColumn("se", F.sqrt(F.greatest(rss, F.lit(0.0)) / (F.col("m") - 3) * F.col("cxx") / F.col("det")))
    a = a.withColumn("t", F.col("coef") / F.when(F.col("se") > 1e-9, F.col("se"))).withColumn("df", (F.col("m") - 3).cast("double"))
    return a.withColumn("p", t_pvalue("t", "df")).select(F.col("ct").alias("phenotype"), F.col("nb").alias("neighbourhood"), "m", "coef", "t", "p")


def adjust(df: DataFrame, p: str, method: str, out: str = "p_adjusted") -> DataFrame:
    """Adjusted p-values: bonferroni, holm, fdr_bh or hommel.  NULL p-values stay NULL and don't count.

    The rows are the tests of one family, so the ranks are one window over them.
    """
    m = df.agg(F.count(p).cast("double").alias("__m"))
    d = df.crossJoin(F.broadcast(m))  # one row
    up = Window.partitionBy(F.col(p).isNull()).orderBy(F.col(p))
    v, rank = F.col(p), F.row_number().over(up)
    if method == "bonferroni":
        return d.withColumn(out, F.least(v * F.col("__m"), F.lit(1.0))).drop("__m")
    if method == "holm":
        d = d.withColumn("__h", v * (F.col("__m") - rank + 1))
        run = F.max("__h").over(up.rowsBetween(Window.unboundedPreceding, 0))
        return d.withColumn(out, F.when(v.isNotNull(), F.least(run, F.lit(1.0)))).drop("__m", "__h")
    if method == "fdr_bh":
        d = d.withColumn("__r", rank).withColumn("__h", v * F.col("__m") / F.col("__r"))
        run = F.min("__h").over(Window.partitionBy(F.col(p).isNull()).orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0))
        return d.withColumn(out, F.when(v.isNotNull(), F.least(run, F.lit(1.0)))).drop("__m", "__h", "__r")
    if method == "hommel":
        values = sorted(r[0] for r in df.where(F.col(p).isNotNull()).select(p).distinct().collect())  # different p-values of one family
        counts = {r[0]: r[1] for r in df.where(F.col(p).isNotNull()).groupBy(p).count().collect()}
        made = hommel([x for x in values for _ in range(counts[x])])
        pairs = dict(zip([x for x in values for _ in range(counts[x])], made))
        rows = df.sparkSession.createDataFrame(list(pairs.items()) or [(None, None)], f"{p} double, {out} double")
        return df.join(F.broadcast(rows), p, "left")
    raise ValueError(f"unknown method {method}")


def hommel(p: list[float]) -> list[float]:
    """Hommel's adjusted p-values of sorted p-values."""
    n = len(p)
    if not n:
        return []
    q = [min(n * p[i] / (i + 1) for i in range(n))] * n
    out = q[:]
    for m in range(n - 1, 1, -1):
        low = n - m + 1
        best = min(m * p[i] / (2 + i - low) for i in range(low, n))
        q = [min(m * p[i], best) for i in range(low)] + [0.0] * (n - low)
        q[low:] = [q[low - 1]] * (n - low)
        out = [max(a, b) for a, b in zip(out, q)]
    return [min(1.0, max(a, b)) for a, b in zip(out, p)]
