"""A store of named elements, one Parquet folder each."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("image", "labels", "shapes", "table", "graph")


class Store:
    """Named elements under a folder: ``put``, ``get``, ``names``, ``replace``, ``drop``.

    An element is written beside its place and moved in, so that a table can be
    replaced by one computed from it and readers never see half of it.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str) -> str:
        if not re.fullmatch(r"[\w.\-]+", name):
            raise ValueError(f"not a name: {name!r}")
        return f"{self.folder}/{name}"

    def names(self) -> dict[str, str]:
        """Names and kinds."""
        if not self._fs.exists(self._path(self.folder)):
            return {}
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return dict(sorted(f.rsplit("@", 1) for f in found if "@" in f and not f.startswith(("_", "."))))

    def put(self, name: str, df: DataFrame, kind: str = "table", overwrite: bool = False, partition_by: list[str] | None = None) -> str:
        """Write an element; an existing name raises unless ``overwrite``.

        The old element is set aside until the new one is in place.
        """
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")
        at = self._at(name)
        old = self.names().get(name)
        if old is not None and not overwrite:
            raise ValueError(f"{name} exists")
        made = f"{self.folder}/_{name}-{uuid.uuid4().hex}"
        writer = df.write.mode("error")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(made)
        aside = self._path(f"{self.folder}/_old-{name}-{uuid.uuid4().hex}")
        if old is not None and not self._fs.rename(self._path(f"{at}@{old}"), aside):
            raise OSError(f"cannot move {at} aside")
        if not self._fs.rename(self._path(made), self._path(f"{at}@{kind}")):
            if old is not None:  # as it was
                self._fs.rename(aside, self._path(f"{at}@{old}"))
            raise OSError(f"cannot move {made} to {at}")
        if old is not None:
            self._fs.delete(aside, True)
        return name

    def get(self, name: str) -> DataFrame:
        """Read an element; partition folders are pruned by Spark."""
        kind = self.names().get(name)
        if kind is None:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self._at(name)}@{kind}")

    def drop(self, name: str) -> None:
        kind = self.names().get(name)
        if kind is None:
            raise KeyError(name)
        self._fs.delete(self._path(f"{self._at(name)}@{kind}"), True)

    def free_name(self, name: str) -> str:
        """The name, or the name with the first counter that is free."""
        there, out, i = self.names(), name, 0
        while out in there:
            i += 1
            out = f"{name}_{i}"
        return out

    def save_missing(self, elements: dict[str, tuple[DataFrame, str]]) -> list[str]:
        """Writes the elements that are not stored yet; their names."""
        new = [n for n in elements if n not in self.names()]
        for n in new:
            self.put(n, *elements[n])
        return new


def plain_name(path: str) -> str:
    """A file's name without any suffix, blanks and dashes as underscores."""
    return re.sub(r"[ \-]", "_", path.rsplit("/", 1)[-1].split(".", 1)[0])


def read_metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; each column numeric if all its values are, else text; blanks are NULL.

    Types are decided by one aggregate over the text, not by a sample.
    """
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("nullValue", "").csv(path)
    if not raw.columns:
        return raw
    numeric = raw.agg(*[F.min(F.when(F.col(f"`{c}`").isNotNull(), F.expr(f"try_cast(`{c}` as double)").isNotNull())).alias(str(i)) for i, c in enumerate(raw.columns)]).head()
    return raw.select(*[F.col(f"`{c}`").cast("double").alias(c) if numeric[i] else F.col(f"`{c}`") for i, c in enumerate(raw.columns)])


def set_mpp(levels: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``mpp``: the one value, or the mean of both axes where they differ; several values on an axis raise."""
    d = levels.agg(F.count_distinct(x).alias("nx"), F.count_distinct(y).alias("ny"), F.avg(x).alias("x"), F.avg(y).alias("y"))
    bad = F.raise_error(F.lit("several micrometres per pixel on one axis")).cast("double")
    return d.select(F.when((F.col("nx") > 1) | (F.col("ny") > 1), bad).otherwise((F.col("x") + F.col("y")) / 2).alias("mpp"))


def scale_factors(levels: DataFrame, group: str, level: str, size: str) -> DataFrame:
    """``group``, ``level``, ``factor``: rounded ratios of consecutive sizes; ratios of 1 left out."""
    from pyspark.sql import Window

    ratio = F.round(F.lag(size).over(Window.partitionBy(group).orderBy(level)) / F.col(size)).cast("int")
    return levels.select(group, level, ratio.alias("factor")).where("factor > 1")


def channel_names(names: list[str]) -> list[str]:
    """Names made unique: those that occur more than once get _0, _1, ..."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        if names.count(n) > 1:
            out.append(f"{n}_{seen.get(n, 0)}")
            seen[n] = seen.get(n, 0) + 1
        else:
            out.append(n)
    return out
