"""Filling containers of fixed capacity: bounded-space online best-fit.

A packer keeps a fixed number of open bins.  A bitset has one bit for each
amount of free space that some open bin has; the bin that fits an item best is
the lowest set bit at or above the item's size.  If none fits, a new bin is
opened, and if too many are open the fullest closes.  Tasks pack their own rows
side by side, so at most a fixed number of bins a task is closed by its end
rather than by being full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN_BINS = 64

# The public word/punctuation rule \w+|[^\w\s]+ with Unicode classes as letters,
# numbers and the underscore; white space as Unicode has it, with the separators
# 0x1c to 0x1f.  Fixed values.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
TOKEN = rf"{WORD}+|[^\p{{L}}\p{{N}}_{SPACE}]+"


def token_count(text: Column) -> Column:
    """Number of tokens of the word/punctuation rule; 0 for an empty and NULL for a NULL text."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


class Packer:
    """Online best-fit with at most ``open_bins`` open bins."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS) -> None:
        self.capacity, self.most = capacity, open_bins
        self.free = 0  # bit f is set if an open bin has f free
        self.bins: dict[int, list[int]] = {}  # free space: the bins that have it
        self.count = 0  # open bins
        self.made = 0

    def put(self, size: int) -> tuple[int, int | None]:
        """The bin's number, and the number of the bin closed for it, if any."""
        closed = None
        fits = self.free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            own = self._take(space)
        else:
            if self.count >= self.most and size < self.capacity:  # the fullest closes first
                closed = self._take((self.free & -self.free).bit_length() - 1)
            own, space = self.made, self.capacity
            self.made += 1
        left = space - size
        if left:
            self.bins.setdefault(left, []).append(own)
            self.free |= 1 << left
            self.count += 1
        return own, closed

    def _take(self, space: int) -> int:
        held = self.bins[space]
        own = held.pop()
        if not held:
            del self.bins[space]
            self.free &= ~(1 << space)
        self.count -= 1
        return own

    def left_open(self) -> dict[int, int]:
        """Open bins and their free space."""
        return {b: f for f, held in self.bins.items() for b in held}


def pieces(df: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """One row for each piece of an item: key, ``piece_no`` from 1, ``start``, ``piece_size``.

    Only items larger than ``capacity`` have more than one piece, all full but
    the last.  An item of size 0 is one piece of size 0; NULL keys or sizes and
    negative sizes give no row.
    """
    out = df.where(F.col(key).isNotNull() & (F.col(size) >= 0))
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / F.lit(capacity))).cast("long")
    out = out.withColumn("piece_no", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    start = (F.col("piece_no") - 1) * capacity
    return out.withColumn("start", start).withColumn("piece_size", F.least(F.lit(capacity).cast("long"), F.col(size) - start).cast("long"))


def _pack(capacity: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer = Packer(capacity, open_bins)
        for t in batches:
            own = np.array([packer.put(s)[0] for s in t["piece_size"].to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(own + (part << 40))], [*t.schema.names, "bin"])

    return run


def pack(df: DataFrame, key: str, size: str, capacity: int, open_bins: int = OPEN_BINS) -> DataFrame:
    """Key, ``size``, ``piece_no``, ``start``, ``piece_size``, ``bin``: every piece in one container.

    No container holds more than ``capacity``; no item is split unless it is
    larger than that.  Pieces are dealt to tasks, and taken in the order of, a
    hash of key and piece, so the result is the same whenever the rows and the
    number of shuffle partitions are, and one huge item is spread over all tasks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(df.dtypes)[key]
    own = pieces(df.select(F.col(key).alias("k"), F.col(size).cast("long").alias("size")), "k", "size", capacity)
    own = own.select("k", "size", "piece_no", "start", "piece_size", F.xxhash64("k", "piece_no").alias("h"))
    dealt = own.repartition(parts, "h").sortWithinPartitions("h", "k", "piece_no").drop("h")
    packed = dealt.mapInArrow(_pack(capacity, open_bins), f"k {kind}, size long, piece_no long, start long, piece_size long, bin long")
    return packed.withColumnRenamed("k", key)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, the least number of containers, and the share of room filled."""
    bins = packed.groupBy("bin").agg(F.sum("piece_size").alias("used"))
    out = bins.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.coalesce(F.max("used"), F.lit(0)).alias("fullest"))
    out = out.withColumn("least_containers", F.ceil(F.col("tokens") / F.lit(capacity)).cast("long"))
    return out.withColumn("filled", F.round(F.col("tokens") / F.nullif(F.col("containers") * capacity, F.lit(0)), 6))
