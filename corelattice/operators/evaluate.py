"""Agreement of clusterings.  Labels are long: cell, ``run``, ``label``."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_k(labels: DataFrame, k: int) -> DataFrame:
    """The runs of one ``k``."""
    return labels.where(F.col("k") == k)


def of_run(labels: DataFrame, k: int, r: float) -> DataFrame:
    """The run of one ``k`` and resolution."""
    return labels.where((F.col("k") == k) & (F.col("r") == r))


def contingency(labels: DataFrame, key: str) -> DataFrame:
    """``run_a``, ``run_b``, ``a``, ``b``, ``n`` for every ordered pair of runs.

    Cells without a label in a run don't count for its pairs.  One shuffle on the
    cell; a cell's runs are one short array.
    """
    per = labels.where("label is not null").groupBy(key).agg(F.collect_set(F.struct("run", "label")).alias("s"))
    pair = per.select(F.explode("s").alias("x"), "s").select("x", F.explode("s").alias("y"))
    return pair.groupBy(F.col("x.run").alias("run_a"), F.col("y.run").alias("run_b"), F.col("x.label").alias("a"), F.col("y.label").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _choose2(c):
    return F.sum(c * (c - 1) / F.lit(2.0))


def agreement(table: DataFrame) -> DataFrame:
    """``run_a``, ``run_b``, ``cells``, ``ari``, ``mi`` (nats), ``nmi`` (arithmetic mean) from ``contingency``.

    Two runs of one cluster each agree fully: ``ari`` and ``nmi`` are 1.
    """
    keys = ["run_a", "run_b"]
    d = table.withColumn("n", F.col("n").cast("double"))
    rows = d.groupBy(*keys, "a").agg(F.sum("n").alias("na"))
    cols = d.groupBy(*keys, "b").agg(F.sum("n").alias("nb"))
    total = d.groupBy(*keys).agg(F.sum("n").alias("cells"), _choose2(F.col("n")).alias("s"))
    sa = rows.groupBy(*keys).agg(_choose2(F.col("na")).alias("sa"), F.sum(F.col("na") * F.log("na")).alias("la"))
    sb = cols.groupBy(*keys).agg(_choose2(F.col("nb")).alias("sb"), F.sum(F.col("nb") * F.log("nb")).alias("lb"))
    mi = d.join(rows, [*keys, "a"]).join(cols, [*keys, "b"]).join(total.select(*keys, "cells"), keys)
    mi = mi.groupBy(*keys).agg(F.sum(F.col("n") / F.col("cells") * F.log(F.col("cells") * F.col("n") / (F.col("na") * F.col("nb")))).alias("mi"))
    out = total.join(sa, keys).join(sb, keys).join(mi, keys)
    all2 = F.col("cells") * (F.col("cells") - 1) / 2.0
    chance = F.col("sa") * F.col("sb") / F.nullif(all2, F.lit(0.0))
    top = (F.col("sa") + F.col("sb")) / 2.0
    ari = F.coalesce((F.col("s") - chance) / F.nullif(top - chance, F.lit(0.0)), F.lit(1.0))
    ha, hb = (F.log("cells") - F.col(c) / F.col("cells") for c in ("la", "lb"))
    mean = (ha + hb) / 2.0
    nmi = F.when(mean.between(-1e-12, 1e-12), 1.0).otherwise(F.col("mi") / mean)
    return out.select(*keys, F.col("cells").cast("long").alias("cells"), ari.alias("ari"), F.col("mi"), nmi.alias("nmi"))


def expected_mutual_information(a: list[int], b: list[int]) -> float:
    """Mean mutual information of two clusterings with these sizes under random dealing (hypergeometric)."""
    n = sum(a)
    lg = math.lgamma
    out = 0.0
    for x in a:
        for y in b:
            for k in range(max(1, x + y - n), min(x, y) + 1):
                chance = lg(x + 1) + lg(y + 1) + lg(n - x + 1) + lg(n - y + 1) - lg(n + 1) - lg(k + 1) - lg(x - k + 1) - lg(y - k + 1) - lg(n - x - y + k + 1)
                out += k / n * math.log(n * k / (x * y)) * math.exp(chance)
    return out


def adjusted_mutual_information(table: DataFrame) -> DataFrame:
    """``run_a``, ``run_b``, ``ami``: chance-adjusted, arithmetic mean of the entropies.

    The sizes of the clusters of two runs, not cells, meet in one task.
    """

    def ami(t: pd.DataFrame) -> pd.DataFrame:
        a, b, n = t.groupby("a")["n"].sum(), t.groupby("b")["n"].sum(), float(t["n"].sum())
        mi = sum(v / n * math.log(n * v / (a[x] * b[y])) for x, y, v in zip(t["a"], t["b"], t["n"]))
        ha, hb = (-sum(v / n * math.log(v / n) for v in s) for s in (a, b))
        emi = expected_mutual_information([int(v) for v in a], [int(v) for v in b])
        top, down = mi - emi, (ha + hb) / 2 - emi
        score = 1.0 if len(a) == len(b) == 1 or abs(down) < 1e-15 else top / down
        return pd.DataFrame({"run_a": [t["run_a"].iat[0]], "run_b": [t["run_b"].iat[0]], "ami": [score]})

    return table.groupBy("run_a", "run_b").applyInPandas(ami, "run_a string, run_b string, ami double")


def cluster_scores(labels: DataFrame, key: str, score: str) -> DataFrame:
    """``run_a``, ``run_b``, ``score`` for ARI, NMI, MI or AMI; another name raises."""
    name = score.lower()
    if name == "ami":
        return adjusted_mutual_information(contingency(labels, key)).withColumnRenamed("ami", "score")
    if name not in ("ari", "nmi", "mi"):
        raise ValueError(f"unknown score {score}")
    return agreement(contingency(labels, key)).select("run_a", "run_b", F.col(name).alias("score"))
