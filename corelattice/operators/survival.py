"""Survival: Kaplan-Meier, numbers at risk, Cox regression.  One row is one subject."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _clean(df: DataFrame, event: str, time: str, stratum: str | None) -> DataFrame:
    s = F.col(stratum).cast("string") if stratum else F.lit("all")
    d = df.select(s.alias("stratum"), F.col(event).cast("boolean").alias("e"), F.col(time).cast("double").alias("t"))
    return d.where("stratum is not null and e is not null and t is not null and not isnan(t)")


def kaplan_meier(df: DataFrame, event: str, time: str, stratum: str | None = None, z: float = 1.959963984540054) -> DataFrame:
    """``stratum``, ``time``, ``events``, ``at_risk``, ``survival``, ``low``, ``high`` at every distinct time.

    Log-log interval from Greenwood's variance; NULL where survival is 0 or 1.
    Rows with a NULL event, time or stratum are left out.  Subjects are counted by
    time first, so the windows run over distinct times.
    """
    per = _clean(df, event, time, stratum).groupBy("stratum", "t").agg(F.sum(F.col("e").cast("long")).alias("d"), F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("stratum").orderBy("t")
    after = w.rowsBetween(0, Window.unboundedFollowing)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("n", F.sum("c").over(after))
    one = F.when(F.col("d") < F.col("n"), F.log(1.0 - F.col("d") / F.col("n"))).otherwise(0.0)
    gone = F.max((F.col("d") == F.col("n")).cast("int")).over(upto)  # nobody left: 0 from here on
    s = F.when(gone == 1, 0.0).otherwise(F.exp(F.sum(one).over(upto)))
    var = F.sum(F.when(F.col("d") < F.col("n"), F.col("d") / (F.col("n") * (F.col("n") - F.col("d")).cast("double"))).otherwise(0.0)).over(upto)
    out = per.withColumn("survival", s).withColumn("__g", var)
    mid = F.log(-F.log("survival"))
    half = F.lit(z) * F.sqrt("__g") / F.abs(F.log("survival"))
    inside = (F.col("survival") > 0) & (F.col("survival") < 1)
    out = out.withColumn("low", F.when(inside, F.exp(-F.exp(mid + half)))).withColumn("high", F.when(inside, F.exp(-F.exp(mid - half))))
    return out.select("stratum", F.col("t").alias("time"), F.col("d").alias("events"), F.col("n").alias("at_risk"), "survival", "low", "high")


def at_risk(df: DataFrame, event: str, time: str, stratum: str | None = None, step: float = 5.0) -> DataFrame:
    """``stratum``, ``tick``, ``at_risk`` at 0, ``step``, ... up to the step at or after the last time.

    At risk at a tick: later times, or censored exactly then.
    """
    d = _clean(df, event, time, stratum)
    # each subject counts at all ticks up to its last one: one number per subject, then running sums
    last = F.floor(F.col("t") / step)
    last = F.when((F.col("t") == last * step) & F.col("e"), last - 1).otherwise(last)
    per = d.withColumn("k", last).groupBy("stratum", "k").agg(F.count(F.lit(1)).alias("c"))
    top = d.agg(F.ceil(F.max("t") / step).alias("top"))
    ticks = d.select("stratum").distinct().crossJoin(F.broadcast(top)).select("stratum", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("k"))
    all_ = ticks.join(per, ["stratum", "k"], "left").fillna(0, ["c"])
    run = F.sum("c").over(Window.partitionBy("stratum").orderBy("k").rowsBetween(0, Window.unboundedFollowing))
    return all_.select("stratum", (F.col("k") * F.lit(step)).alias("tick"), run.alias("at_risk"))


def cox(df: DataFrame, event: str, time: str, covariates: list[str], penalties: list[float], l1_ratio: float = 1.0, rounds: int = 30) -> list[dict]:
    """Elastic-net Cox coefficients for each penalty: ``penalty``, ``coef`` by covariate, ``log_likelihood``.

    Covariates are standardised inside and the coefficients given on their own
    scale.  In each round one aggregate by distinct time yields the sums over
    subjects that the gradient and the curvature need; what reaches the driver is
    one row for each distinct time, and coordinate descent runs on it.  Ties by
    Breslow's method.  Rows with a missing value are left out; a covariate of sd 0
    has coefficient 0.
    """
    p = len(covariates)
    v = [F.col(c).cast("double") for c in covariates]
    d = df.select(F.col(event).cast("boolean").alias("e"), F.col(time).cast("double").alias("t"), *[x.alias(f"x{i}") for i, x in enumerate(v)]).dropna()
    fit = d.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)], *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(p)]).head()
    if not fit["n"]:
        return [{"penalty": a, "coef": dict.fromkeys(covariates, 0.0), "log_likelihood": 0.0} for a in penalties]
    mean, sd = np.array([fit[f"m{i}"] for i in range(p)]), np.array([fit[f"s{i}"] or 0.0 for i in range(p)])
    live = sd > 0
    z = [(F.col(f"x{i}") - float(mean[i])) / float(sd[i]) if live[i] else F.lit(0.0) for i in range(p)]
    d = d.select("e", "t", *[c.alias(f"z{i}") for i, c in enumerate(z)]).persist()
    beta, out = np.zeros(p), []

    def sums(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        risk = F.exp(sum((F.col(f"z{i}") * float(b[i]) for i in range(p)), F.lit(0.0)))
        e = F.col("e").cast("double")
        per = d.withColumn("r", risk).groupBy("t").agg(
            F.sum(e).alias("d"), F.sum(e * F.log("r")).alias("l"), F.sum("r").alias("r"),
            *[F.sum(F.col("r") * F.col(f"z{i}")).alias(f"r{i}") for i in range(p)],
            *[F.sum(F.col("r") * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"q{i}_{j}") for i in range(p) for j in range(i, p)],
            *[F.sum(e * F.col(f"z{i}")).alias(f"e{i}") for i in range(p)],
        ).toPandas().sort_values("t")
        back = per.iloc[::-1].cumsum().iloc[::-1]  # sums over the subjects still at risk
        deaths, s0 = per["d"].to_numpy(), back["r"].to_numpy()
        s1 = np.stack([back[f"r{i}"].to_numpy() for i in range(p)], axis=1) / s0[:, None]
        s2 = np.empty((len(per), p, p))
        for i in range(p):
            for j in range(i, p):
                s2[:, i, j] = s2[:, j, i] = back[f"q{i}_{j}"].to_numpy() / s0
        like = per["l"].sum() - (deaths * np.log(s0)).sum()
        grad = np.array([per[f"e{i}"].sum() for i in range(p)]) - (deaths[:, None] * s1).sum(0)
        hess = (deaths[:, None, None] * (s2 - s1[:, :, None] * s1[:, None, :])).sum(0)
        return float(like), grad, hess

    n = float(fit["n"])
    for alpha in penalties:
        like, grad, hess = sums(beta)
        for _ in range(rounds):
            new = beta.copy()
            for _ in range(200):  # coordinate descent on the quadratic model
                before = new.copy()
                for i in np.flatnonzero(live):
                    g = grad[i] - hess[i] @ (new - beta) + hess[i, i] * new[i]
                    new[i] = math.copysign(max(abs(g) - n * alpha * l1_ratio, 0.0), g) / (hess[i, i] + n * alpha * (1 - l1_ratio) + 1e-12)
                if np.abs(new - before).max() < 1e-10:
                    break
            if np.abs(new - beta).max() < 1e-8:
                break
            beta = new
            like, grad, hess = sums(beta)
        out.append({"penalty": alpha, "coef": {c: float(b / s) if s > 0 else 0.0 for c, b, s in zip(covariates, beta, sd)}, "log_likelihood": like})
    d.unpersist()
    return out


def concordance(df: DataFrame, event: str, time: str, risk: str) -> float | None:
    """Share of comparable pairs in which the subject with the earlier event has the higher risk; ties count half.

    Three numbers per subject reach one task, which sorts and counts in n log n.
    None without comparable pairs.
    """
    got = df.select(F.col(event).cast("boolean").alias("e"), F.col(time).cast("double").alias("t"), F.col(risk).cast("double").alias("r")).dropna().toPandas()
    if got.empty:
        return None
    t, e, r = got["t"].to_numpy(), got["e"].to_numpy(), got["r"].to_numpy()
    ranks = np.unique(r, return_inverse=True)[1] + 1
    tree = np.zeros(ranks.max() + 1)

    def upto(i: int) -> float:
        s = 0.0
        while i > 0:
            s += tree[i]
            i -= i & -i
        return s

    good = ties = pairs = 0.0
    held = 0
    order = np.argsort(-t, kind="stable")
    at = 0
    while at < len(order):
        end = at
        while end < len(order) and t[order[end]] == t[order[at]]:
            end += 1
        same = order[at:end]
        for i in same[~e[same]]:  # censored at this time outlive an event at it
            j = ranks[i]
            held += 1
            while j < len(tree):
                tree[j] += 1
                j += j & -j
        for i in same[e[same]]:
            below, equal = upto(ranks[i] - 1), upto(ranks[i])
            good, ties, pairs = good + below, ties + equal - below, pairs + held
        for i in same[e[same]]:
            j = ranks[i]
            held += 1
            while j < len(tree):
                tree[j] += 1
                j += j & -j
        at = end
    return float((good + ties / 2) / pairs) if pairs else None


def top_coefficients(path: list[dict], n: int) -> list[tuple[str, float]]:
    """The ``n`` largest coefficients by size at the least penalty."""
    coef = min(path, key=lambda s: s["penalty"])["coef"]
    return sorted(coef.items(), key=lambda c: (-abs(c[1]), c[0]))[:n]
