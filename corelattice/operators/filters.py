"""Row filters of cell tables.  All bounds are strict; NULL and NaN never pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelattice.operators.markers import marker
from corelattice.operators.quantiles import quantiles

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def is_numeric(df: DataFrame, column: str) -> bool:
    return dict(df.dtypes)[column].startswith(NUMERIC)


def _number(df: DataFrame, column: str) -> Column:
    if not is_numeric(df, column):
        raise ValueError(f"{column} is not numeric")
    v = F.col(column).cast("double")
    return F.when(~F.isnan(v), v)


def _between(v: Column, low: float | None, high: float | None) -> Column:
    keep = v.isNotNull()
    if low is not None:
        keep &= v > F.lit(low)
    if high is not None:
        keep &= v < F.lit(high)
    return keep


def by_count(df: DataFrame, column: str, low: int | None = 10, high: int | None = None) -> DataFrame:
    """Rows of the categories with more than ``low`` and fewer than ``high`` rows; NULL is no category.

    Counts are taken first (map-side) and joined back, so a hot category is never
    one sort group.  A numeric column raises.
    """
    if is_numeric(df, column):
        raise ValueError(f"{column} is numeric")
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    kept = counts.where(_between(F.col("__n"), low, high)).select(column)
    return df.join(kept, column, "left_semi")


def by_value(df: DataFrame, column: str, low: float | None = 10, high: float | None = 100_000) -> DataFrame:
    """Rows with ``low`` < column < ``high``."""
    return df.where(_between(_number(df, column), low, high))


def by_quantile(df: DataFrame, column: str, low: float | None = 0.1, high: float | None = 0.95) -> DataFrame:
    """Rows between two quantiles, both taken from all rows (linear interpolation)."""
    v = _number(df, column)
    wanted = [q for q in (low, high) if q is not None]
    at = dict(zip(wanted, quantiles(df, [v], wanted)[0]))
    keep = v.isNotNull()
    for q, passed in ((low, lambda t: v > F.lit(t)), (high, lambda t: v < F.lit(t))):
        if q is not None:  # without any value there is no bound, and no row either
            keep &= passed(at[q]) if at[q] is not None else F.lit(False)
    return df.where(keep)


def by_marker_value(df: DataFrame, x: str, i: int, low: float | None = 1, high: float | None = 254) -> DataFrame:
    """Rows whose marker at ``i`` lies between the bounds."""
    return df.where(_between(marker(x, i), low, high))


def by_marker_quantile(df: DataFrame, x: str, i: int, low: float | None = 0.05, high: float | None = 0.99) -> DataFrame:
    """As ``by_quantile`` for a marker, but the upper quantile is that of the rows left by the lower one."""
    d = df.withColumn("__v", marker(x, i))
    if low is not None:
        d = by_quantile(d, "__v", low, None)
    if high is not None:
        d = by_quantile(d, "__v", None, high)
    return d.drop("__v")


def by_category(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows with one of ``values``; a value that no row has raises."""
    there = {r[0] for r in df.where(F.col(column).isin(values)).select(column).distinct().collect()}  # at most len(values)
    lost = [v for v in values if v not in there]
    if lost:
        raise ValueError(f"no rows with {column} in {lost}")
    return df.where(F.col(column).isin(values))


def split(df: DataFrame, column: str, values: list[str]) -> dict[str, DataFrame]:
    """One table for each value."""
    return {v: df.where(F.col(column) == v) for v in values}


def relabel(df: DataFrame, column: str, mapping: dict[str, str], out: str) -> DataFrame:
    """``out`` by mapping the text of ``column``; what isn't mapped becomes the text ``nan``."""
    pairs = [F.lit(v) for p in mapping.items() for v in p]
    mapped = F.element_at(F.create_map(*pairs), F.col(column).cast("string")) if pairs else F.lit(None).cast("string")
    return df.withColumn(out, F.coalesce(mapped, F.lit("nan")))


def columns_of_kind(df: DataFrame) -> dict[str, list[str]]:
    """Names of numeric, categorical (text, boolean) and other columns."""
    out: dict[str, list[str]] = {"numeric": [], "categorical": [], "other": []}
    for c, kind in df.dtypes:
        out["numeric" if kind.startswith(NUMERIC) else "categorical" if kind in ("string", "boolean") else "other"].append(c)
    return out


def with_size_rank(df: DataFrame, label: str, least: int, out: str) -> DataFrame:
    """``out``: 0, 1, ... by falling number of rows with the label, ties to the lesser label; -1 for ``least`` rows or fewer.

    NULL labels get NULL.
    """
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    rank = F.row_number().over(Window.orderBy(F.desc("__n"), label)) - 1  # one row for each label
    sizes = sizes.withColumn(out, F.when(F.col("__n") > least, rank).otherwise(-1).cast("int")).drop("__n")
    return df.join(sizes, label, "left")
