"""Exact quantiles of whole columns, without bringing the values to one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelattice.plans.lineage import written

BINS = 4096  # of a round's histogram


def quantiles(df: DataFrame, columns: list[Column], qs: list[float]) -> list[list[float | None]]:
    """The quantiles ``qs`` (0 to 1, linear interpolation) of each numeric column; None for a column without values.

    NULL and NaN are left out.  Every round counts the values of each column by
    equal bins between the bounds that are still possible (partial counts, at
    most ``BINS`` a column and bound) and goes on within the bin that holds the
    rank, until one value is left there.
    Infinite values count at their ends.
    """
    if not qs or not columns:
        return [[] for _ in columns]
    names = [f"v{i}" for i in range(len(columns))]
    d = written(df.select(*[F.when(~F.isnan(c.cast("double")), c.cast("double")).alias(n) for c, n in zip(columns, names)]), "values")
    head = d.agg(*[f(n).alias(f"{n}{s}") for n in names for f, s in ((F.count, "n"), (F.min, "a"), (F.max, "b"))]).head()
    ranks = {}  # (column, rank): low, high, how many values lie below low
    for i, n in enumerate(names):
        total = head[f"{n}n"]
        for q in qs if total else []:
            at = q * (total - 1)
            for r in {math.floor(at + 1e-9), math.ceil(at - 1e-9)}:
                ranks[i, min(max(r, 0), total - 1)] = (head[f"{n}a"], head[f"{n}b"], 0)
    value: dict[tuple[int, int], float] = {}
    while ranks:
        for key in [k for k, (a, b, _) in ranks.items() if a == b]:
            value[key] = ranks.pop(key)[0]
        spans = sorted({(i, a, b) for (i, _), (a, b, _) in ranks.items()})
        if not spans:
            break
        number = {s: j for j, s in enumerate(spans)}
        marks = []
        for j, (i, a, b) in enumerate(spans):
            v = F.col(names[i])
            low, high = max(a, -1.7e308), min(b, 1.7e308)
            # halves, as the width itself may not be a number
            bin_ = (v / 2 - F.lit(low / 2)) / F.lit((high / 2 - low / 2) / BINS or 5e-324)
            bin_ = F.floor(F.least(F.greatest(bin_, F.lit(0.0)), F.lit(BINS - 1.0))).cast("int")
            marks.append(F.when((v >= F.lit(a)) & (v <= F.lit(b)), F.struct(F.lit(j).alias("j"), bin_.alias("bin"), v.alias("v"))))
        flat = d.select(F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("m")).select("m.*")
        got = flat.groupBy("j", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()  # BINS a span, at most
        bins: dict[int, list] = {}
        for r in sorted(got, key=lambda r: (r.j, r.bin)):
            bins.setdefault(r.j, []).append(r)
        for (i, rank), (a, b, below) in list(ranks.items()):
            for r in bins[number[i, a, b]]:
                if rank < below + r.n:
                    ranks[i, rank] = (r.a, r.b, below)
                    break
                below += r.n
    out: list[list[float | None]] = []
    for i, n in enumerate(names):
        total, line = head[f"{n}n"], []
        for q in qs:
            if not total:
                line.append(None)
                continue
            at = q * (total - 1)
            low = min(max(math.floor(at + 1e-9), 0), total - 1)
            high = min(max(math.ceil(at - 1e-9), 0), total - 1)
            part = at - low if high > low else 0.0
            line.append(value[i, low] if not part else value[i, low] * (1 - part) + value[i, high] * part)
        out.append(line)
    return out
