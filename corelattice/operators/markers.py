"""Transforms of the marker matrix, an ``ARRAY<DOUBLE>`` column in a fixed order.

Row-wise and element-wise transforms are one generated expression per marker,
inside whole-stage code; column-wise ones take all statistics in one aggregate
of one row, which is joined back by broadcast.  ``n`` is the number of markers.
NULL and NaN are missing and stay NULL unless a transform says otherwise; arrays
shorter than ``n`` count as missing at the end; NULL arrays stay NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelattice.operators.quantiles import quantiles


def marker(x: str, i: int) -> Column:
    """The value at position ``i``, NULL where missing."""
    v = F.get(F.col(x), F.lit(i))
    return F.when(~F.isnan(v), v)


def _rebuilt(df: DataFrame, x: str, n: int, fn: Callable[[Column, int], Column], out: str | None) -> DataFrame:
    made = F.array(*[fn(marker(x, i), i) for i in range(n)])
    return df.withColumn(out or x, F.when(F.col(x).isNotNull(), made))


def fill_na(df: DataFrame, x: str, n: int, value: float = 0.0, out: str | None = None) -> DataFrame:
    """Missing values replaced by ``value``."""
    return _rebuilt(df, x, n, lambda v, _: F.coalesce(v, F.lit(float(value))), out)


def log1p(df: DataFrame, x: str, n: int, out: str | None = None) -> DataFrame:
    """ln(1 + v)."""
    return _rebuilt(df, x, n, lambda v, _: F.log1p(v), out)


def arcsinh(df: DataFrame, x: str, n: int, cofactor: float = 150.0, out: str | None = None) -> DataFrame:
    """asinh(v / cofactor)."""
    return _rebuilt(df, x, n, lambda v, _: F.asinh(v / F.lit(float(cofactor))), out)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` worked out once per row.

    Columns made step by step would do as well, but a filter above them is pushed
    below with every step written out inside the next.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _clean(x: str) -> Column:
    return F.transform(x, lambda v: F.when(~F.isnan(v), v))


def _total(v: Column, term: Callable[[Column], Column] = lambda e: e) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, e: a + F.coalesce(term(e), F.lit(0.0)))


def zscore_rows(df: DataFrame, x: str, n: int, out: str | None = None) -> DataFrame:
    """Per row: (v - mean) / population sd over the row's values; NULL where the sd is 0."""

    def scored(v: Column) -> Column:
        count = F.nullif(F.size(F.filter(v, lambda e: e.isNotNull())), F.lit(0))
        sd = lambda m: F.nullif(F.sqrt(_total(v, lambda e: (e - m) * (e - m)) / count), F.lit(0.0))
        return _let(_total(v) / count, lambda m: _let(sd(m), lambda s: F.transform(v, lambda e: (e - m) / s)))

    return df.withColumn(out or x, _let(_clean(x), scored))


def _with_stats(df: DataFrame, stats: list[Column]) -> DataFrame:
    # one row, whatever the size of the table
    return df.crossJoin(F.broadcast(df.agg(*stats)))


def scale_columns(df: DataFrame, x: str, n: int, out: str | None = None) -> DataFrame:
    """Per marker: (v - mean) / sample sd; a marker of sd 0 (or one value) is only centred."""
    stats = [F.array(*[F.avg(marker(x, i)) for i in range(n)]).alias("__m"), F.array(*[F.stddev_samp(marker(x, i)) for i in range(n)]).alias("__s")]
    d = _with_stats(df, stats)
    return _rebuilt(d, x, n, lambda v, i: (v - F.col("__m")[i]) / F.coalesce(F.nullif(F.col("__s")[i], F.lit(0.0)), F.lit(1.0)), out).drop("__m", "__s")


def percentile_normalise(df: DataFrame, x: str, n: int, percentile: float = 95.0, out: str | None = None) -> DataFrame:
    """Per marker: (v - min) / (P - min), missing as 0; a denominator of 0 is 1.  No upper bound."""
    filled = [F.coalesce(marker(x, i), F.lit(0.0)) for i in range(n)]
    d = df.where(F.col(x).isNotNull())
    bounds = quantiles(d, filled, [0.0, percentile / 100])

    def fn(v: Column, i: int) -> Column:
        low, high = bounds[i]
        if low is None:
            return F.lit(None).cast("double")
        return (F.coalesce(v, F.lit(0.0)) - F.lit(low)) / F.lit(1.0 if high == low else high - low)

    return _rebuilt(d, x, n, fn, out)


def normalise_log2p(df: DataFrame, x: str, n: int, pseudocount: float = 1e-3, out: str | None = None) -> DataFrame:
    """Per row: log2(v / sum of the row + pseudocount); NULL where the sum is 0."""
    made = _let(_clean(x), lambda v: _let(F.nullif(_total(v), F.lit(0.0)), lambda t: F.transform(v, lambda e: F.log2(e / t + F.lit(pseudocount)))))
    return df.withColumn(out or x, made)


TRANSFORMS: dict[str, Callable] = {
    "fill_na": fill_na, "log1p": log1p, "arcsinh": arcsinh, "zscore": zscore_rows,
    "scale": scale_columns, "percentile": percentile_normalise, "normalise_log2p": normalise_log2p,
}


def chain(df: DataFrame, x: str, n: int, names: list[str], out: str | None = None) -> DataFrame:
    """The transforms ``names`` one after the other, into a column named ``a_b_<x>`` by default."""
    unknown = [t for t in names if t not in TRANSFORMS]
    if unknown:
        raise ValueError(f"unknown transforms: {unknown}")
    made = out or "_".join([*names, x])
    d = df.withColumn(made, F.col(x))
    for t in names:
        d = TRANSFORMS[t](d, made, n)
    return d


def subset_markers(df: DataFrame, x: str, var: list[str], wanted: list[str]) -> DataFrame:
    """Only the markers ``wanted``, in that order; a name not in ``var`` raises."""
    lost = [w for w in wanted if w not in var]
    if lost:
        raise ValueError(f"no such markers: {lost}")
    return df.withColumn(x, F.when(F.col(x).isNotNull(), F.array(*[marker(x, var.index(w)) for w in wanted])))


def add_obs_as_markers(df: DataFrame, x: str, var: list[str], columns: list[str], out: str = "augmented_x") -> tuple[DataFrame, list[str]]:
    """The matrix with numeric columns appended as markers ``<column>_var``, and the new names.

    A column whose marker is there already is left out; a column that isn't
    numeric raises.
    """
    kinds = dict(df.dtypes)
    bad = [c for c in columns if kinds.get(c) not in ("int", "bigint", "double", "float", "smallint", "tinyint")]
    if bad:
        raise ValueError(f"not numeric: {bad}")
    new = [c for c in columns if f"{c}_var" not in var]
    values = [marker(x, i) for i in range(len(var))] + [F.col(c).cast("double") for c in new]
    return df.withColumn(out, F.when(F.col(x).isNotNull(), F.array(*values))), [*var, *(f"{c}_var" for c in new)]
