"""Percentiles per group and column by distributed multi-select.

The rows of a group are dealt to chunks of bounded size; each chunk keeps its
values sorted.  In every round each chunk that still holds candidates proposes
the median of its candidates, the median of the proposals weighted by the
candidates behind them becomes the pivot of the group and rank, all chunks
count the values below, at and above it, and the range that cannot hold the
rank is discarded, at least a quarter of the candidates each time.  Once few
enough are left (a bounded number) they are gathered and the rank is read off.

Ranks are exact: the rank error is 0.  The chunk table itself is what separate
days or files hand on: the union of chunk tables of disjoint rows gives the
percentiles of all their rows, again exactly.  ``thin`` replaces the chunks by
evenly spaced values with weights, which takes a bounded share of the space and
gives a rank error of at most ``eps`` times the number of values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corelattice.functions.vectors import matrix
from corelattice.plans.lineage import written
from corelattice.plans.sizes import broadcast_if_small

CHUNK_ROWS = 8192  # rows of one chunk, about
GATHER = 16384  # candidates of one group and rank that one task may gather
CHUNKS = "grp string, chunk long, pos int, n long, vals array<double>"


def sorted_chunks(df: DataFrame, group: str, values: str, width: int, key: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Chunks (``CHUNKS``): of each group, chunk and position the sorted values.

    ``values`` is an array of ``width`` numbers.  NULL and NaN are left out, as
    are rows with a NULL group and arrays of another length.  A group with more
    rows than ``chunk_rows`` is dealt by the hash of ``key`` over as many chunks
    as it needs, so no task sees a group of unbounded size.  Chunk tables of
    disjoint rows may be put together by union.
    """
    rows = df.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("grp"), F.col(key).alias("__key"), F.col(values).alias("__v"))
    big = rows.groupBy("grp").count().where(F.col("count") > chunk_rows)
    big = big.select("grp", F.ceil(F.col("count") / F.lit(chunk_rows)).cast("long").alias("__chunks"))
    dealt = rows.join(big, "grp", "left").withColumn("chunk", F.pmod(F.xxhash64("__key"), F.coalesce("__chunks", F.lit(1))))

    def sort(t: pa.Table) -> pa.Table:
        m = np.sort(matrix(t["__v"], width), axis=0)  # NaN last
        n = (~np.isnan(m)).sum(axis=0)
        flat = np.concatenate([m[: n[j], j] for j in range(width)]) if width else np.empty(0)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat))
        # a number from the rows' own keys: chunks of separate days or files keep apart when put together
        own = hashlib.blake2b(repr(sorted(t["__key"].to_pylist())).encode(), digest_size=8).digest()
        head = [pa.array([t["grp"][0].as_py()] * width, pa.string()), pa.array([int.from_bytes(own, "big", signed=True)] * width, pa.int64())]
        out = pa.Table.from_arrays([*head, pa.array(np.arange(width, dtype=np.int32)), pa.array(n.astype(np.int64)), lists], ["grp", "chunk", "pos", "n", "vals"])
        return out.filter(pa.array(n > 0))

    return dealt.drop("__chunks").groupBy("grp", "chunk").applyInArrow(sort, CHUNKS)


def _ranks(sizes: DataFrame, percents: list[float]) -> DataFrame:
    """Of each group, position and percentile the two 0-based ranks between which it lies."""
    at = F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("percent")
    out = sizes.select("grp", "pos", "total", at)
    exact = F.col("percent") / 100.0 * (F.col("total") - 1)
    low = F.floor(exact + 1e-9).cast("long")
    out = out.withColumn("low", F.least(low, F.col("total") - 1))
    out = out.withColumn("part", F.greatest(exact - F.col("low"), F.lit(0.0)))
    out = out.withColumn("part", F.when(F.col("part") < 1e-9, 0.0).otherwise(F.col("part")))
    return out


# one element for each wanted rank of a chunk: first and past-the-end candidate
_SPANS = "grp string, pos int, rank long, chunk long, a long, b long"
_KEPT = ["grp", "pos", "rank", "chunk", "a", "b", "left_over", "pivot"]


def _proposals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the chunk's local median of its candidates, and how many there are."""
    for t in batches:
        a, b = t["a"].to_numpy(), t["b"].to_numpy()
        v = t["vals"]
        offsets, flat = np.asarray(v.offsets)[:-1], v.values.to_numpy(zero_copy_only=False)
        mid = flat[np.minimum(offsets + (a + b) // 2, len(flat) - 1)] if len(flat) else np.empty(0)
        yield pa.RecordBatch.from_arrays([t["grp"], t["pos"], t["rank"], pa.array(mid), pa.array(b - a)], ["grp", "pos", "rank", "pivot", "w"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts three ways: where the pivot's run begins and ends in the chunk's span."""
    for t in batches:
        a, b, p = t["a"].to_numpy(), t["b"].to_numpy(), t["pivot"].to_numpy()
        v = t["vals"]
        offsets, flat = np.asarray(v.offsets), v.values.to_numpy(zero_copy_only=False)
        left, right = np.empty(len(p), np.int64), np.empty(len(p), np.int64)
        for i in range(len(p)):
            own = flat[offsets[i] + a[i] : offsets[i] + b[i]]
            left[i], right[i] = a[i] + np.searchsorted(own, p[i], "left"), a[i] + np.searchsorted(own, p[i], "right")
        yield pa.RecordBatch.from_arrays([*(t[c] for c in _KEPT), pa.array(left), pa.array(right)], [*_KEPT, "left", "right"])


def _pivots(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """Of each group, position and rank the weighted median of the chunks' proposals."""
    local = chunks.select("grp", "pos", "chunk", "vals").join(spans.where("b > a"), ["grp", "pos", "chunk"])
    local = local.select("grp", "pos", "rank", "a", "b", "vals").mapInArrow(_proposals, "grp string, pos int, rank long, pivot double, w long")
    by = Window.partitionBy("grp", "pos", "rank")
    run = F.sum("w").over(by.orderBy("pivot").rowsBetween(Window.unboundedPreceding, 0))
    met = local.withColumn("run", run).withColumn("all", F.sum("w").over(by)).where("2 * run >= all")
    return met.groupBy("grp", "pos", "rank").agg(F.min("pivot").alias("pivot"))


def _select(chunks: DataFrame, wanted: DataFrame, gather: int) -> DataFrame:
    """The value at each wanted rank (``grp``, ``pos``, ``rank``) of groups of several chunks."""
    spans = wanted.join(chunks.select("grp", "pos", "chunk", "n"), ["grp", "pos"])
    spans = spans.select("grp", "pos", "rank", F.col("rank").alias("left_over"), "chunk", F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))
    found = None
    spans = broadcast_if_small(written(spans, "spans"))
    by = Window.partitionBy("grp", "pos", "rank")
    while True:  # a quarter of the candidates at least goes in each round
        counted = spans.withColumn("live", F.sum(F.col("b") - F.col("a")).over(by))
        wide = counted.where(F.col("live") > gather).drop("live")
        if not wide.take(1):
            break
        wide = broadcast_if_small(written(wide, "wide"))
        pivots = broadcast_if_small(written(_pivots(wide, chunks), "pivots"))
        cut = chunks.select("grp", "pos", "chunk", "vals").join(wide.join(pivots, ["grp", "pos", "rank"]), ["grp", "pos", "chunk"])
        cut = cut.select("grp", "pos", "rank", "chunk", "left_over", "a", "b", "pivot", "vals").mapInArrow(_counts, _SPANS + ", left_over long, pivot double, left long, right long")
        cut = cut.withColumn("below", F.sum(F.col("left") - F.col("a")).over(by)).withColumn("upto", F.sum(F.col("right") - F.col("a")).over(by))
        small, large = F.col("left_over") < F.col("below"), F.col("left_over") >= F.col("upto")
        cut = cut.select(
            "grp", "pos", "rank", "chunk", "pivot", (~small & ~large).alias("hit"),
            F.when(large, F.col("left_over") - F.col("upto")).otherwise(F.col("left_over")).alias("left_over"),
            F.when(large, F.col("right")).otherwise(F.col("a")).alias("a"), F.when(small, F.col("left")).otherwise(F.col("b")).alias("b"),
        )
        idle = counted.where(F.col("live") <= gather).select("grp", "pos", "rank", "chunk", F.lit(None).cast("double").alias("pivot"), F.lit(False).alias("hit"), "left_over", "a", "b")
        state = written(cut.unionByName(idle), "spans")
        done = state.where("hit").groupBy("grp", "pos", "rank").agg(F.max("pivot").alias("value"))
        found = done if found is None else found.unionByName(done)
        spans = broadcast_if_small(state.where("not hit").select("grp", "pos", "rank", "left_over", "chunk", "a", "b"))
    rest = chunks.select("grp", "pos", "chunk", "vals").join(spans.where("b > a"), ["grp", "pos", "chunk"])
    rest = rest.select("grp", "pos", "rank", "left_over", F.expr("slice(vals, int(a) + 1, int(b - a))").alias("own"))
    rest = rest.groupBy("grp", "pos", "rank", "left_over").agg(F.sort_array(F.flatten(F.collect_list("own"))).alias("own"))  # at most ``gather`` values
    rest = rest.select("grp", "pos", "rank", F.expr("own[int(left_over)]").alias("value"))
    return rest if found is None else rest.unionByName(found)


def percentiles(chunks: DataFrame, percents: list[float], gather: int = GATHER) -> DataFrame:
    """``grp``, ``pos``, ``total``, ``percent``, ``value`` from a table of chunks.

    ``chunks`` is read in every round: hand in a written table.  Interpolates
    between neighbouring ranks like ``percentile`` (an even count's median is the
    mean of the two middle values).  A group without values gives no row.
    """
    sizes = chunks.groupBy("grp", "pos").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("chunks"))
    ranks = _ranks(sizes, percents)
    # a group of one chunk: the local proposal already is the answer
    one = chunks.join(ranks.join(sizes.where("chunks = 1").select("grp", "pos"), ["grp", "pos"]), ["grp", "pos"])
    low, high = F.expr("vals[int(low)]"), F.expr("vals[int(low) + 1]")
    out = one.select("grp", "pos", "total", "percent", (low + F.when(F.col("part") > 0, (high - low) * F.col("part")).otherwise(0.0)).alias("value"))
    several = ranks.join(sizes.where("chunks > 1").select("grp", "pos"), ["grp", "pos"])
    wanted = several.select("grp", "pos", F.explode(F.expr("case when part > 0 then array(low, low + 1) else array(low) end")).alias("rank")).distinct()
    dealt = written(chunks.join(sizes.where("chunks > 1").select("grp", "pos"), ["grp", "pos"]), "dealt")
    values = _select(dealt, written(wanted, "wanted"), gather)
    at = several.select("grp", "pos", "total", "percent", "part", F.explode(F.expr("case when part > 0 then array(low, low + 1) else array(low) end")).alias("rank"), "low")
    at = at.join(values, ["grp", "pos", "rank"])
    share = F.when(F.col("rank") == F.col("low"), 1 - F.col("part")).otherwise(F.col("part"))
    at = at.groupBy("grp", "pos", "total", "percent").agg(F.sum(F.col("value") * share).alias("value"))
    return out.unionByName(at)


def thin(chunks: DataFrame, eps: float) -> DataFrame:
    """Chunks as evenly spaced values: ``grp``, ``chunk``, ``pos``, ``n``, ``vals``, ``weight``.

    Each kept value stands for at most ``weight`` = max(1, floor(2 eps n)) values
    of its chunk and is the middle of them, so that a rank read from any union
    of thinned chunks is off by at most ``eps`` times the number of values.
    """
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(2.0 * eps) * F.col("n")).cast("long"))
    out = chunks.withColumn("weight", step)
    kept = "transform(sequence(0L, ceil(n / weight) - 1L), i -> vals[int(least(n - 1, i * weight + shiftright(least(weight, n - i * weight), 1)))])"
    return out.withColumn("vals", F.expr(kept))


def thin_percentiles(thinned: DataFrame, percents: list[float]) -> DataFrame:
    """Percentiles of a union of thinned chunks: ``grp``, ``pos``, ``total``, ``percent``, ``value``.

    The value whose run of weights reaches the rank; rank error as in ``thin``.
    """
    flat = thinned.select("grp", "pos", F.posexplode("vals").alias("i", "v"), "weight", "n")
    flat = flat.withColumn("w", F.least("weight", F.col("n") - F.col("i") * F.col("weight")))
    flat = flat.groupBy("grp", "pos", "v").agg(F.sum("w").alias("w"))
    by = Window.partitionBy("grp", "pos")
    flat = flat.withColumn("run", F.sum("w").over(by.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("w").over(by))
    at = flat.withColumn("percent", F.explode(F.array(*[F.lit(float(p)) for p in percents])))
    at = at.where(F.col("run") > F.col("percent") / 100.0 * (F.col("total") - 1))
    return at.groupBy("grp", "pos", "total", "percent").agg(F.min("v").alias("value"))
