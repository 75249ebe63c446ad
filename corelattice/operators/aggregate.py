"""Sample-level aggregates: counts, proportions, bins, summaries, key roles.

Results are long tables (group, categories, value), which stay distributed at
any number of categories; ``widen`` turns one into columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelattice.operators.filters import is_numeric


def _named(df: DataFrame, columns: list[str]) -> DataFrame:
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"no such columns: {lost}")
    return df


def row_counts(df: DataFrame, base: str, domain: DataFrame | None = None) -> DataFrame:
    """``base``, ``n``; groups of ``domain`` without rows have 0.  NULL is no group."""
    out = df.where(F.col(base).isNotNull()).groupBy(base).agg(F.count(F.lit(1)).alias("n"))
    if domain is not None:
        out = domain.select(base).distinct().join(out, base, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out


def category_counts(df: DataFrame, base: str, categories: list[str]) -> DataFrame:
    """``base``, ``categories``, ``n``; combinations without rows are absent, NULLs left out."""
    _named(df, [base, *categories])
    return df.dropna(subset=[base, *categories]).groupBy(base, *categories).agg(F.count(F.lit(1)).alias("n"))


def category_proportions(df: DataFrame, base: str, categories: list[str], within: str | None = None) -> DataFrame:
    """Counts as shares of all rows of the group, or of the rows of the group's level of ``within``."""
    if within is not None and within not in categories:
        raise ValueError(f"{within} is not one of {categories}")
    counts = category_counts(df, base, categories)
    by = Window.partitionBy(base, *([within] if within else []))
    return counts.withColumn("proportion", F.col("n") / F.sum("n").over(by))


def widen(long: DataFrame, base: str, category: str, value: str, values: list[str]) -> DataFrame:
    """One row for each ``base`` with a column for each of ``values``; given values, no extra pass."""
    return long.groupBy(base).pivot(category, values).agg(F.first(value))


SUMMARIES = ("sum", "max", "min", "first", "last", "mean", "median")


def _summary(fn: str, number: str, order: str) -> Column:
    v = F.when(~F.isnan(F.col(number).cast("double")), F.col(number))
    made = {
        "sum": lambda: F.sum(v), "max": lambda: F.max(v), "min": lambda: F.min(v), "mean": lambda: F.avg(v), "median": lambda: F.median(v),
        # the first and last row that has a value, in the order of a key
        "first": lambda: F.min_by(v, F.when(v.isNotNull(), F.col(order))), "last": lambda: F.max_by(v, F.when(v.isNotNull(), F.col(order))),
    }
    if fn not in made:
        raise ValueError(f"unknown summary {fn}")
    return made[fn]()


def summarised(df: DataFrame, base: str, number: str, fns: list[str], order: str, categories: list[str] | None = None) -> DataFrame:
    """``<fn>_<number>`` of each group (and category).  NULL and NaN values are left out."""
    if not is_numeric(df, number):
        raise ValueError(f"{number} is not numeric")
    keys = [base, *(categories or [])]
    return df.dropna(subset=keys).groupBy(*keys).agg(*[_summary(f, number, order).alias(f"{f}_{number}") for f in fns])


def bin_label(v: Column, breaks: list[float]) -> Column:
    """The bin ``(a, b]`` that holds ``v`` as text; NULL outside all bins."""
    out = F.lit(None).cast("string")
    for a, b in reversed(list(zip(breaks, breaks[1:]))):
        out = F.when((v > F.lit(float(a))) & (v <= F.lit(float(b))), f"({a}, {b}]").otherwise(out)
    return F.when(v.isNotNull() & ~F.isnan(v.cast("double")), out)


def binned(df: DataFrame, base: str, number: str, breaks: list[float], normalise: bool = False, category: str | None = None, within: str | None = None) -> DataFrame:
    """``base``, [``category``,] ``bin``, ``n`` (and ``proportion``): every bin of every group, empty ones with 0.

    Values at or below the first break, above the last one and NULLs are in no
    bin.  ``within`` = ``category`` takes shares inside its levels, else shares
    are of the group's binned rows; a group without binned rows has NULL shares.
    """
    keys = [base, *([category] if category else [])]
    d = df.dropna(subset=keys).withColumn("bin", bin_label(F.col(number), breaks))
    per = [F.sum((F.coalesce(F.col("bin") == f"({a}, {b}]", F.lit(False))).cast("long")).alias(f"__{i}") for i, (a, b) in enumerate(zip(breaks, breaks[1:]))]
    wide = d.groupBy(*keys).agg(*per)  # a column for each bin: empty bins need no second table
    pairs = F.array(*[F.struct(F.lit(f"({a}, {b}]").alias("bin"), F.col(f"__{i}").alias("n")) for i, (a, b) in enumerate(zip(breaks, breaks[1:]))])
    out = wide.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.bin", "p.n")
    if normalise:
        by = Window.partitionBy(base, *([within] if within else []))
        out = out.withColumn("proportion", F.col("n") / F.nullif(F.sum("n").over(by), F.lit(0)))
    return out


def binned_summary(df: DataFrame, base: str, bin_column: str, number: str, breaks: list[float], fn: str, order: str, category: str | None = None) -> DataFrame:
    """A summary of ``number`` within the bins of another column."""
    d = df.withColumn(f"binned_{bin_column}", bin_label(F.col(bin_column), breaks))
    return summarised(d, base, number, [fn], order, [f"binned_{bin_column}", *([category] if category else [])])


def widened(df: DataFrame, base: str, number: str, order: str) -> DataFrame:
    """``base``, ``pos`` (from 0 in the order of a key), value: a group's values as numbered rows.

    NULL values keep their place.  The position is a window over the group; a
    group with a third of all rows is sorted by spilling, never held in memory.
    """
    pos = F.row_number().over(Window.partitionBy(base).orderBy(order)) - 1
    return df.dropna(subset=[base]).select(base, pos.cast("int").alias("pos"), number)


def cardinality(df: DataFrame, base: str, columns: list[str]) -> DataFrame:
    """``base`` and the number of different values of each column (NULL is none), long: ``column``, ``n``.

    Two levels of grouping per column keep hot groups small; one expand pass does all columns.
    """
    flat = df.dropna(subset=[base]).select(base, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p"))
    flat = flat.select(base, "p.column", "p.value").distinct()
    return flat.groupBy(base, "column").agg(F.count("value").alias("n"))


def key_roles(df: DataFrame, base: str, columns: list[str]) -> DataFrame:
    """``column``, ``most`` (values within a group), ``total`` (values in all), ``groups``, ``role``.

    ``parallel``: at most one value in every group; of these ``true_parallel`` if
    there are as many values as groups, else ``duplicated``; ``super``: more than
    one value in some group.
    """
    per = cardinality(df, base, columns).groupBy("column").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("groups"))
    total = df.dropna(subset=[base]).agg(*[F.count_distinct(c).alias(c) for c in columns])
    total = total.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("total")) for c in columns])).alias("p")).select("p.*")
    role = F.when(F.col("most") > 1, "super").when(F.col("total") == F.col("groups"), "true_parallel").otherwise("duplicated")
    return per.join(F.broadcast(total), "column").withColumn("role", role)


def parallel_value(df: DataFrame, base: str, column: str, check: bool = True) -> DataFrame:
    """``base`` and the one value of ``column`` in each group (NULL if there is none); more than one raises."""
    out = df.dropna(subset=[base]).groupBy(base).agg(F.max(column).alias(column), F.min(column).alias("__min"))
    if check:
        bad = F.raise_error(F.concat(F.lit(f"several values of {column} in "), F.col(base).cast("string"))).cast(dict(df.dtypes)[column])
        out = out.withColumn(column, F.when(F.coalesce(F.col("__min") != F.col(column), F.lit(False)), bad).otherwise(F.col(column)))
    return out.drop("__min")


def metadata(df: DataFrame, base: str, column: str, handle: str = "proportions", order: str = "cell_key", breaks: list[float] | None = None, fn: str = "mean") -> DataFrame:
    """One column at the level of ``base``, by its role.

    One value in each group: that value.  A categorical column with several:
    ``counts`` or ``proportions``.  A numeric one: ``summarised``, ``binned`` or
    ``widened``.  Any other ``handle`` raises.
    """
    numeric = is_numeric(df, column)
    role = key_roles(df, base, [column]).select("role").head()
    if role is not None and role[0] != "super":
        return parallel_value(df, base, column)
    if not numeric and handle in ("counts", "proportions"):
        return category_counts(df, base, [column]) if handle == "counts" else category_proportions(df, base, [column])
    if numeric and handle == "summarised":
        return summarised(df, base, column, [fn], order)
    if numeric and handle == "binned" and breaks:
        return binned(df, base, column, breaks)
    if numeric and handle == "widened":
        return widened(df, base, column, order)
    raise ValueError(f"cannot handle {column} by {handle}")


def feature_name(levels: list[tuple[str, Column]]) -> Column:
    """``level$value@level$value`` with ``NA`` for NULL."""
    return F.concat_ws("@", *[F.concat(F.lit(f"{n}$"), F.coalesce(v.cast("string"), F.lit("NA"))) for n, v in levels])


def feature_frame(long: DataFrame, base: str, levels: list[str], value: str) -> DataFrame:
    """``base``, ``feature`` (flat name of the levels), ``value``."""
    return long.select(base, feature_name([(c, F.col(c)) for c in levels]).alias("feature"), F.col(value).alias("value"))


def sample_level(df: DataFrame, base: str, feature: str, keys: list[str]) -> DataFrame:
    """Proportions of ``feature`` in each sample (long) with the sample's own ``keys``."""
    shares = category_proportions(df, base, [feature])
    meta = df.dropna(subset=[base]).groupBy(base).agg(*[F.max(k).alias(k) for k in keys])
    return shares.join(meta, base)


def group_means(df: DataFrame, group: str, x: str, n: int) -> DataFrame:
    """``group``, ``pos``, ``mean`` of every marker, and the group's ``size``; NULL is no group."""
    from corelattice.operators.markers import marker

    wide = df.dropna(subset=[group]).groupBy(group).agg(F.count(F.lit(1)).alias("size"), *[F.avg(marker(x, i)).alias(f"__{i}") for i in range(n)])
    return wide.select(group, "size", F.posexplode(F.array(*[F.col(f"__{i}") for i in range(n)])).alias("pos", "mean"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """``bin`` (from 1; 0 below, ``bins`` + 1 at or above the range), ``n``.  NULLs left out."""
    b = F.floor((F.col(column) - F.lit(low)) / F.lit((high - low) / bins)) + 1
    b = F.when(F.col(column) < low, 0).when(F.col(column) >= high, bins + 1).otherwise(b)
    return df.where(F.col(column).isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
