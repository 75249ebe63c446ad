"""Row numbers over a whole table without a single sorting task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelattice.plans.lineage import written

_BITS = 33  # of the row within its partition in Spark's increasing numbers


def numbered(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """Adds ``out``: 0, 1, ... in the given order, which should be total.

    The rows are sorted by range partitions and written; the partitions' sizes,
    one number each, give where each begins.
    """
    d = written(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", _BITS)
    inside = F.col("__at").bitwiseAND(F.lit((1 << _BITS) - 1))
    return d.withColumn(out, F.get(_starts(d, part, F.count(F.lit(1)), "long"), part.cast("int")) + inside).drop("__at")


def summed_before(df: DataFrame, order: list[Column | str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` (a double) over all rows before the row in the given, total order."""
    d = written(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", _BITS)
    run = F.sum(value).over(Window.partitionBy(part).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))  # within a range partition
    return d.withColumn(out, F.get(_starts(d, part, F.sum(value), "double"), part.cast("int")) + F.coalesce(run, F.lit(0.0))).drop("__at")


def _starts(d: DataFrame, part: Column, total: Column, kind: str) -> Column:
    """What the partitions before each partition hold, as an array."""
    sizes = {r.p: r.n for r in d.groupBy(part.alias("p")).agg(total.alias("n")).collect()}  # a row for each partition
    begin, at = [], 0
    for p in range(max(sizes, default=0) + 1):
        begin.append(at)
        at += sizes.get(p) or 0
    return F.array(*[F.lit(b).cast(kind) for b in begin])
