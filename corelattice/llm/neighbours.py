"""Most similar vectors for every vector, by additive quantisation.

A tree of two levels of centres, fitted on a bounded sample, deals the vectors
to leaves; the number of leaves follows the number of vectors, and a region with
many vectors gets many leaves.  What is left after the leaf's centre is encoded
with ``BOOKS`` full-dimensional codebooks by beam search, and the norm of the
sum of the chosen words and its distance from the vector are kept.  A query's products with all words are its
lookup table: a vector's score is its norm less twice the sum of the table's
entries at its codes.  The best ``RERANK`` vectors of each leaf visited are then
measured exactly, over the values present in both, and so is every other vector
that by its score and error could be among the nearest: nothing in a leaf
visited is missed, however dense it is.

Leaves visited: with a greatest distance, all that the ball around the query
can reach (bisector tests at both levels, so no leaf that holds a vector within
reach is left out); without one, the ``probes`` nearest.  Queries with missing
values visit the ``probes`` leaves nearest in the values present.

Exact copies are one vector in the search, so a group of copies of any size
costs no more than one vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelattice.functions.vectors import kmeans, nearest
from corelattice.llm.profiles import filled, sample, unpacked
from corelattice.plans.lineage import written

SAMPLE = 131_072  # vectors that the index is fitted on, at most
TOPS = 64  # centres of the first level
LEAF = 384  # vectors of a leaf, about
BOOKS, WORDS, BEAM = 4, 64, 4
RERANK = 32
PROBES = 24
HELD = 32_768  # vectors of a leaf compared at a time
PAIRS, MEASURED = 4_194_304, 262_144  # pairs scored, and measured, at a time


class Index:
    """Centres of both levels and the codebooks."""

    def __init__(self, x: np.ndarray, n: int, seed: int = 0, leaf: int = LEAF) -> None:
        rng = np.random.default_rng(seed)
        self.width = x.shape[1]
        whole = x[~np.isnan(x).any(axis=1)]
        if not len(whole):
            whole = np.nan_to_num(x) if len(x) else np.zeros((1, self.width), np.float32)
        self.tops = kmeans(whole, TOPS if n > 4 * TOPS else 1, 12, rng)
        x = filled(x, self.tops) if len(x) else whole
        own = nearest(x, self.tops)
        self.subs: list[np.ndarray] = []
        left = x.copy()
        for i in range(len(self.tops)):
            rows = np.flatnonzero(own == i)
            k = max(1, round(len(rows) / max(len(x), 1) * n / leaf))
            self.subs.append(kmeans(x[rows], k, 4, rng) if len(rows) else self.tops[i : i + 1])
            left[rows] -= self.subs[i][nearest(x[rows], self.subs[i])] if len(rows) else 0
        self.first = np.r_[0, np.cumsum([len(s) for s in self.subs])].astype(np.int64)
        self.books: list[np.ndarray] = []
        for _ in range(BOOKS):  # each on what the books before leave
            self.books.append(kmeans(left[:32_768], WORDS, 8, rng))
            left = left - self.books[-1][nearest(left, self.books[-1])]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row without missing values."""
        top = nearest(x, self.tops)
        out = np.empty(len(x), np.int64)
        for i in np.unique(top):
            rows = np.flatnonzero(top == i)
            out[rows] = self.first[i] + nearest(x[rows], self.subs[i])
        return out

    def within(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaves that the balls of radius ``reach`` around the rows can touch."""
        rows, leaves = [], []
        row, top = _reached(x, self.tops, reach)
        order = np.argsort(top, kind="stable")
        row, top = row[order], top[order]
        for i, a, b in zip(*_spans(top)):
            r, sub = _reached(x[row[a:b]], self.subs[i], reach)
            rows.append(row[a:b][r])
            leaves.append(self.first[i] + sub)
        return np.concatenate(rows), np.concatenate(leaves)

    def probed(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and their nearest leaves by the values present."""
        there = (~np.isnan(x)).astype(np.float32)
        own = np.nan_to_num(x)
        d = there @ (self.tops * self.tops).T - 2 * own @ self.tops.T
        near = np.argsort(d, axis=1)[:, :8]
        rows, leaves = [], []
        for i in range(len(x)):
            c = np.concatenate([self.subs[t] for t in near[i]])
            ids = np.concatenate([np.arange(self.first[t], self.first[t + 1]) for t in near[i]])
            d = (c * c) @ there[i] - 2 * c @ own[i]
            best = ids[np.argpartition(d, probes)[:probes]] if len(d) > probes else ids
            rows.append(np.full(len(best), i))
            leaves.append(best)
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))

    def centre(self, leaf: int) -> np.ndarray:
        i = int(np.searchsorted(self.first, leaf, "right")) - 1
        return self.subs[i][leaf - self.first[i]]

    def encode(self, left: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes (rows, books) by beam search, the squared norms of the words' sums, and their distances from the rows."""
        n = len(left)
        rest = left[:, None, :]  # rows, beam, width
        codes = np.zeros((n, 1, 0), np.uint8)
        for book in self.books:
            half = (book * book).sum(1) / 2
            cost = (rest * rest).sum(-1)[:, :, None] / 2 + half - rest @ book.T
            b, k = cost.shape[1], len(book)
            keep = min(beam, b * k)
            flat = cost.reshape(n, -1)
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            came, word = best // k, best % k
            at = np.arange(n)[:, None]
            rest = rest[at, came] - book[word]
            codes = np.concatenate([codes[at, came], word[:, :, None].astype(np.uint8)], axis=2)
        best = np.argmin((rest * rest).sum(-1), axis=1)
        at = np.arange(n)
        rest = rest[at, best]
        made = left - rest
        return codes[at, best], (made * made).sum(1), np.sqrt((rest * rest).sum(1))


def _reached(x: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and centres whose Voronoi cell is at most ``reach`` behind the bisector with the nearest centre's."""
    d = (c * c).sum(1) - 2 * x @ c.T
    own = np.argmin(d, axis=1)
    d -= d[np.arange(len(x)), own][:, None]
    widest = 2 * np.sqrt(((c - c.mean(0)) ** 2).sum(1).max())  # no two centres are farther apart
    row, to = np.nonzero(d <= np.float32(2.0002 * reach * widest + 1e-4))
    apart = np.sqrt(((c[own[row]] - c[to]) ** 2).sum(1))
    near = d[row, to] <= 2.0002 * reach * apart + 1e-4
    return row[near], to[near]


def _spans(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a sorted array with the begin and end of their runs."""
    at = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.empty(0, np.int64)
    return v[at], at, np.r_[at[1:], len(v)] if len(v) else at


def _best(index: Index, leaf: int, keys: np.ndarray, own: np.ndarray, asked: np.ndarray, asked_keys: np.ndarray, k: int, limit: float | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query keys, neighbour keys and distances: the ``k`` nearest in one leaf.

    The ``RERANK`` best by score are measured first.  Of the rest, all that by
    their error could be within ``limit`` and as near as the k-th of these.
    """
    c = index.centre(leaf)
    gap, ask_gap = np.isnan(own).any(axis=1), np.isnan(asked).any(axis=1)
    gaps = bool(gap.any() or ask_gap.any())
    full = np.where(np.isnan(own), c, own) if gaps else own
    codes, norms, errors = index.encode(full - c)
    words = sum(np.sqrt((book * book).sum(1).max()) for book in index.books)  # no sum of words is longer
    errors = np.where(gap, np.inf, errors * 1.00001 + 2e-6 * (np.abs(full).max() + np.abs(c).max() + words))  # no bound over the values present
    out = []
    step = max(1, min(1024, PAIRS // len(own)))
    for i in range(0, len(asked), step):
        q, qk = asked[i : i + step], asked_keys[i : i + step]
        mid = np.where(np.isnan(q), c, q) - c
        score = np.tile(norms, (len(q), 1))
        for m, book in enumerate(index.books):
            score -= np.take(2 * mid @ book.T, codes[:, m], axis=1)

        def measured(r: np.ndarray, j: np.ndarray) -> np.ndarray:
            diff = own[j] - q[r]
            if gaps:
                diff = np.nan_to_num(diff)
            d = np.einsum("ij,ij->i", diff, diff, dtype=np.float64)
            d[keys[j] == qk[r]] = np.inf
            if limit is not None:
                d[d > limit * limit] = np.inf
            return d

        take = min(RERANK, len(own))
        near = np.argpartition(score, take - 1, axis=1)[:, :take] if take < len(own) else np.tile(np.arange(take), (len(q), 1))
        r, j = np.repeat(np.arange(len(q)), take), near.ravel()
        d = measured(r, j)
        hits = [(r, j, d)]
        if take < len(own):
            bound = np.full(len(q), np.inf if limit is None else limit)
            if k <= take:
                bound = np.minimum(bound, np.sqrt(np.partition(d.reshape(len(q), take), k - 1, axis=1)[:, k - 1]))
            bound[ask_gap[i : i + step]] = np.inf
            length = np.sqrt((mid * mid).sum(1))
            score += (length * length - 4e-6 * (length + words) ** 2)[:, None]  # squared distances from the sums of words, less what rounding adds
            could = score <= (bound.astype(np.float32)[:, None] * np.float32(1.00001) + errors.astype(np.float32)) ** 2
            could[np.arange(len(q))[:, None], near] = False
            r, j = np.nonzero(could)
            for e in range(0, len(r), MEASURED):
                r2, j2 = r[e : e + MEASURED], j[e : e + MEASURED]
                d = measured(r2, j2)
                some = d <= bound[r2] ** 2 * 1.00001
                hits.append((r2[some], j2[some], d[some]))
        r, j, d = (np.concatenate(h) for h in zip(*hits))
        some = np.isfinite(d)
        r, j, d = r[some], j[some], d[some]
        order = np.lexsort((keys[j], d, r))
        r, j, d = r[order], j[order], d[order]
        first = np.arange(len(r)) - np.searchsorted(r, r, "left") < k
        if first.any():
            out.append((qk[r[first]], keys[j[first]], np.sqrt(d[first])))
    return out


def nearest_neighbours(df: DataFrame, key: str, width: int, k: int, limit: float | None = None, queries: str | None = None, probes: int = PROBES, seed: int = 0) -> DataFrame:
    """``key``, ``neighbour``, ``distance``: the ``k`` nearest of each vector.

    ``df`` has ``key`` (BIGINT) and ``v`` (packed float32, NaN missing), as
    ``profiles`` writes it.  ``limit``: the greatest distance.  ``queries``: a
    condition on ``key`` that says which vectors are asked for (all by default);
    all vectors are searched.  Distance: Euclidean over the values present in
    both vectors; two without common values are at distance 0.  Ties go to the
    lesser key.  Of an empty table the result is empty.
    """
    spark = df.sparkSession
    asked = F.coalesce(F.expr(queries), F.lit(False)) if queries else F.lit(True)
    # a vector is searched if any of its rows is asked for
    one = df.groupBy("v").agg(F.min(key).alias("k"), F.count(F.lit(1)).alias("copies"), F.max(asked).alias("ask"))
    one = written(one, "vectors")
    n = one.count()
    index = Index(sample(one, "k", width, SAMPLE, n), n, seed)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index
        for t in batches:
            if not t.num_rows:
                continue
            x, ask = unpacked(t["v"], width), t["ask"].to_numpy(zero_copy_only=False)
            full = filled(x, ix.tops)
            home = ix.leaf(full)
            gap = np.isnan(x).any(axis=1)
            go = np.flatnonzero(ask & ~gap)
            if limit is None:
                r, leaf = ix.probed(x[go], probes)
            else:
                r, leaf = ix.within(x[go], limit) if len(go) else (go, go)
            r = go[r]
            g = np.flatnonzero(ask & gap)
            r2, leaf2 = ix.probed(x[g], probes)
            r, leaf = np.r_[r, g[r2]].astype(np.int64), np.r_[leaf, leaf2].astype(np.int64)
            away = leaf != home[r]
            r, leaf = r[away], leaf[away]
            rows = pa.array(np.r_[np.arange(len(x)), r])
            kind = np.r_[np.where(ask, 1, 0), np.full(len(r), 2)].astype(np.int8)  # stored, stored and asked, asked
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[home, leaf]), pa.array(kind), t["k"].take(rows), t["v"].take(rows)], ["leaf", "kind", "k", "v"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index

        def found(leaf: int, kind: np.ndarray, keys: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            own, ask = np.flatnonzero(kind < 2), np.flatnonzero(kind > 0)
            if not len(own) or not len(ask):
                return
            for a in range(0, len(own), HELD):  # a leaf of any size, in blocks
                o = own[a : a + HELD]
                got = _best(ix, leaf, keys[o], x[o], x[ask], keys[ask], k, limit)
                if got:
                    q, nb, d = (np.concatenate(c) for c in zip(*got))
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(nb), pa.array(d)], ["k", "neighbour", "distance"])

        held: list[pa.RecordBatch] = []
        for t in batches:
            if not t.num_rows:
                continue
            leaf = t["leaf"].to_numpy()
            cut = int(np.searchsorted(leaf, leaf[-1], "left"))  # rows before the last leaf are whole
            if cut or (held and held[-1]["leaf"][-1].as_py() != leaf[0]):
                held.append(t.slice(0, cut))
                yield from _runs(held, width, found)
                held = []
            held.append(t.slice(cut))
        yield from _runs(held, width, found)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = one.select("k", "v", "ask").mapInArrow(deal, "leaf long, kind byte, k long, v binary")
    met = dealt.repartition(parts, "leaf").sortWithinPartitions("leaf").mapInArrow(search, "k long, neighbour long, distance double")
    top = F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))), 1, k)  # at most k of each leaf visited
    near = met.groupBy("k").agg(top.alias("n"))
    return _with_copies(df, one, near, key, k, asked)


def _runs(held: list[pa.RecordBatch], width: int, found) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    if not t.num_rows:
        return
    leaf, kind, keys = (t[c].to_numpy() for c in ("leaf", "kind", "k"))
    x = unpacked(t["v"], width)
    for v, a, b in zip(*_spans(leaf)):
        yield from found(int(v), kind[a:b], keys[a:b], x[a:b])


def _with_copies(df: DataFrame, one: DataFrame, near: DataFrame, key: str, k: int, asked: Column) -> DataFrame:
    """From vectors back to rows: a row's nearest are its copies, then the rows of the near vectors."""
    flat = near.select("k", F.explode("n").alias("n")).select("k", F.col("n.neighbour").alias("neighbour"), F.col("n.distance").alias("distance"))
    several = one.where("copies > 1")
    if not several.take(1):
        return flat.select(F.col("k").alias(key), "neighbour", "distance")
    rows = df.join(several.select("v", "k"), "v").select(F.col(key).alias("row"), "k", asked.alias("ask"))
    rows = written(rows, "copies")
    salt = F.pmod(F.xxhash64("row"), F.lit(64))
    heads = rows.withColumn("r", F.row_number().over(Window.partitionBy("k", salt).orderBy("row"))).where(F.col("r") <= k + 1)
    heads = heads.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("row"))).where(F.col("r") <= k + 1)
    heads = written(heads.groupBy("k").agg(F.sort_array(F.collect_list("row")).alias("heads")), "heads")  # k + 1 at most
    # near vectors as rows, then the vector's own rows, at most k + 1 of either
    spread = flat.join(heads.withColumnRenamed("k", "neighbour"), "neighbour", "left")
    spread = spread.select("k", "distance", F.explode(F.coalesce("heads", F.array("neighbour"))).alias("neighbour"))
    spread = spread.unionByName(heads.select("k", F.lit(0.0).alias("distance"), F.explode("heads").alias("neighbour")))
    lists = spread.groupBy("k").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))), 1, k + 1).alias("n"))
    alone = lists.join(several.select("k"), "k", "left_anti").withColumn("row", F.col("k"))
    many = lists.join(rows, "k").where("ask").drop("ask")
    out = alone.unionByName(many, allowMissingColumns=True).select("row", F.expr(f"slice(filter(n, p -> p.neighbour <> row), 1, {k})").alias("n"))
    return out.select(F.col("row").alias(key), F.explode("n").alias("n")).select(key, F.col("n.neighbour").alias("neighbour"), F.col("n.distance").alias("distance"))
