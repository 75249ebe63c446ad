"""Items that appear together: pair counts by an external sort of packed codes.

An unordered pair of items is one 64-bit code, the lesser item's number in the
upper and the greater one's in the lower 32 bits.  Each task sorts runs of a
bounded number of codes and writes every distinct code once with its count;
Spark's shuffle sort spills and merges these sorted runs; the merged stream is
counted by run length.  A pair that holds a third of all rows is thus one row
for each run, and no group is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 1 << 20  # codes of one sorted run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: dict[str, int] = {}
    grp: list[np.ndarray] = []
    code: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        g, c = np.concatenate(grp), np.concatenate(code)
        labels = np.array(list(names), dtype=object)
        # numbers of groups in the order of their names, so that the run is sorted as the merge wants it
        order = np.argsort(labels)
        place = np.empty(len(labels), np.int64)
        place[order] = np.arange(len(labels))
        at = np.lexsort((c, place[g]))
        g, c = place[g][at], c[at]
        new = np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])]
        first = np.flatnonzero(new)
        n = np.diff(np.r_[first, len(c)])
        return pa.RecordBatch.from_arrays([pa.array(labels[order][g[first]], pa.string()), pa.array(c[first]), pa.array(n.astype(np.int64))], ["grp", "code", "n"])

    for t in batches:
        d = t["grp"].dictionary_encode()
        own = np.array([names.setdefault(x, len(names)) for x in d.dictionary.to_pylist()], dtype=np.int64)
        if not len(own):
            continue
        a, b = t["a"].to_numpy().astype(np.int64), t["b"].to_numpy().astype(np.int64)
        grp.append(own[d.indices.to_numpy()])
        code.append(np.minimum(a, b) << 32 | np.maximum(a, b))
        held += len(a)
        if held >= RUN:
            yield flush()
            names, grp, code, held = {}, [], [], 0
    if held:
        yield flush()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length counts of a stream sorted by group and code; a run may cross batches."""
    last: tuple | None = None
    for t in batches:
        if not t.num_rows:
            continue
        g, c, n = t["grp"], t["code"].to_numpy(), t["n"].to_numpy()
        d = g.dictionary_encode().indices.to_numpy()
        first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (c[1:] != c[:-1])])
        sums = np.add.reduceat(n, first)
        gs, cs = g.take(pa.array(first)).to_pylist(), c[first]
        if last is not None and last[0] == gs[0] and last[1] == cs[0]:
            sums[0] += last[2]
        elif last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.string()), pa.array([last[1]], pa.int64()), pa.array([last[2]], pa.int64())], ["grp", "code", "n"])
        if len(cs) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(gs[:-1], pa.string()), pa.array(cs[:-1]), pa.array(sums[:-1].astype(np.int64))], ["grp", "code", "n"])
        last = (gs[-1], int(cs[-1]), int(sums[-1]))
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.string()), pa.array([last[1]], pa.int64()), pa.array([last[2]], pa.int64())], ["grp", "code", "n"])


def pair_counts(pairs: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """``grp``, ``a`` <= ``b``, ``n``: how often each unordered pair occurs in each group.

    ``a`` and ``b`` are item numbers from 0 to 2^31 - 1.  Rows with a NULL group
    or item are left out; an empty table gives an empty result.
    """
    clean = pairs.select(F.col(group).cast("string").alias("grp"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).dropna()
    runs = clean.mapInArrow(_runs, "grp string, code long, n long")
    # codes are dealt by hash and sorted within: an external merge sort of the runs
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = runs.repartition(parts, "grp", "code").sortWithinPartitions("grp", "code").mapInArrow(_merge, "grp string, code long, n long")
    return merged.select("grp", F.shiftright("code", 32).alias("a"), F.col("code").bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).alias("b"), "n")


def association(counts: DataFrame) -> DataFrame:
    """Adds to ``pair_counts`` what is expected by chance.

    ``m`` all pairs of the group, ``d_a`` and ``d_b`` the ends at either item (a
    pair of like items has two), ``lift`` = 2 m n / (d_a d_b) (for like items
    4 m n / d_a^2), ``odds_ratio`` of the 2 x 2 table of pairs that touch a, b,
    both or neither, with 0.5 added to every field, and ``log_odds``.
    """
    ends = counts.select("grp", F.col("a").alias("item"), F.when(F.col("a") == F.col("b"), 2 * F.col("n")).otherwise(F.col("n")).alias("d"))
    ends = ends.unionByName(counts.where("a <> b").select("grp", F.col("b").alias("item"), F.col("n").alias("d")))
    ends = ends.groupBy("grp", "item").agg(F.sum("d").alias("d"))
    out = counts.join(counts.groupBy("grp").agg(F.sum("n").alias("m")), "grp")
    out = out.join(ends.select("grp", F.col("item").alias("a"), F.col("d").alias("d_a")), ["grp", "a"])
    out = out.join(ends.select("grp", F.col("item").alias("b"), F.col("d").alias("d_b")), ["grp", "b"])
    n, m, da, db = (F.col(c).cast("double") for c in ("n", "m", "d_a", "d_b"))
    twice = F.when(F.col("a") == F.col("b"), 4.0).otherwise(2.0)
    ra, rb = da - n, db - n  # ends at a (b) that do not meet the other
    none = F.greatest(2 * m - da - db + n, F.lit(0.0))
    out = out.withColumn("lift", twice * m * n / (da * db)).withColumn("odds_ratio", (n + 0.5) * (none + 0.5) / ((F.greatest(ra, F.lit(0.0)) + 0.5) * (F.greatest(rb, F.lit(0.0)) + 0.5)))
    return out.withColumn("log_odds", F.log("odds_ratio")).select("grp", "a", "b", "n", "m", "d_a", "d_b", "lift", "odds_ratio", "log_odds")
