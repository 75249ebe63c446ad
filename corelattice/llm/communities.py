"""Similarity clusters: neighbour descent, then modularity communities.

Centres fitted on a bounded sample part the rows into cells; every row is in the
cell of its nearest centre and visits each further cell whose border it is as
near to as near neighbours are to each other, so that a row finds its neighbours
across the borders.  The width of that strip is read off the neighbours that a
few rows of the sample have in the whole table.  In each cell neighbour descent
gives the lists of the cell's own rows.  The visitors then come by, one cell
after another, and are compared with the own rows near the same border, so that a task holds one cell and the visitors from one other, however
many visit.  A first level of modularity moves turns the own rows into small
communities.  Links to visitors are added up between the communities after a
join on the visitor.
What is left is the contracted graph of the whole table.  It is contracted
further by joins until a machine can hold it, and brought to communities there.

Modularity cuts a dense cloud into patches that it likes better than the whole.
Two communities are put together again if at least ``SHARE`` of the links of the
smaller one lead to the other and these links are at most ``STRETCH`` times as
long as the links inside: so it is across a cut through a cloud, whereas between
clouds that lie apart hardly any links run, and long ones.

Exact copies are one row of the graph; a vector whose copies are a sizeable
share of the table is dealt by hash, beyond those that stand for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corelattice.functions.modularity import communities, modularity
from corelattice.functions.vectors import kmeans, nearest
from corelattice.llm import descent
from corelattice.llm.profiles import filled, packed, sample, unpacked
from corelattice.operators.cluster import contracted
from corelattice.plans.lineage import written
from corelattice.plans.ranks import numbered
from corelattice.plans.sizes import broadcast_if_small

SAMPLE = 65_536  # rows that the centres are fitted on, at most
CELL = 65_536  # rows of a cell, about
FEW, LITTLE = 32, 4096  # cells of fewer rows, for side by side work, down to LITTLE rows, while they are no more than FEW
PER_CENTRE = 16  # rows of the sample for a centre, at least
REACHED = 0.95  # share of the near neighbours that the strip along the borders is to hold
OWN = 1.5  # own rows so many times the strip's width from a border are compared with those who visit across it
ASKED = 256  # rows of the sample whose neighbours in the whole table are looked up for that
_PAIRS = 1 << 21  # pairs of own rows and visitors compared at a time
_HITS = 1 << 20  # candidates held at a time
HOT = 32  # a vector that is so often in the sample is dealt by hash besides
RESOLUTION = 1.0
SHARE, STRETCH = 0.005, 1.4
LINKS_ON_DRIVER = 1_000_000  # links between contracted communities on one machine, at most
LEAST = 10  # a cluster has more members than this
_COPY = 1 << 62  # numbers of the communities of hot vectors


class Cells:
    """Centres, the width of the strip along the cells' borders, and the hot vectors."""

    def __init__(self, x: np.ndarray, n: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        x = x if len(x) else np.zeros((1, x.shape[1]), np.float32)
        wanted = max(-(-n // CELL), min(FEW, n // LITTLE), 1)
        self.centres = kmeans(x, min(wanted, max(1, len(x) // PER_CENTRE)), 10, rng)
        most = 2 * max(len(x) / len(self.centres), PER_CENTRE)
        for _ in range(16):  # cells with much more than their share are cut
            own = nearest(x, self.centres)
            size = np.bincount(own, minlength=len(self.centres))
            large = [i for i in np.flatnonzero(size > most) if (x[own == i] != x[np.argmax(own == i)]).any()]
            if wanted == 1 or not large:
                break
            self.centres = np.concatenate([np.delete(self.centres, large, axis=0), *(kmeans(x[own == i], 2, 10, rng) for i in large)])
        c = self.centres
        self.half = (c * c).sum(1) / 2
        self.apart = np.sqrt(np.maximum(2 * (self.half[:, None] + self.half - c @ c.T), 1e-12))
        whole, seen = np.unique(x, axis=0, return_counts=True)
        self.asked = whole[rng.permutation(len(whole))[:ASKED]] if len(c) > 1 else whole[:0]
        self.strip = 0.0
        if len(c) > 1 and len(whole) > 1:
            few = rng.permutation(len(whole))[:2048]
            rank = min(max(1, round(descent.LINKS * len(x) / max(n, 1))), len(whole) - 1)  # as far as the lists reach, in a sample so much thinner
            near = []
            for i in range(0, len(few), 64):
                d = _distances(whole[few[i : i + 64]], whole)
                d[np.arange(len(d)), few[i : i + 64]] = np.inf
                near.append(np.argpartition(d, rank - 1, axis=1)[:, :rank].flatten())  # a copy, which does not hold the rest
            self.reach(np.repeat(whole[few], rank, axis=0), whole[np.concatenate(near)])
        self.hot = {v.tobytes(): (i, max(1, int(m / len(x) * n / CELL))) for i, (v, m) in enumerate(zip(whole[seen >= HOT], seen[seen >= HOT]))}

    def reach(self, a: np.ndarray, b: np.ndarray) -> None:
        """Sets the strip by near neighbours ``b`` of rows ``a``."""
        if len(a):
            own = nearest(a, self.centres)
            behind = [self._behind(b[i : i + 4096])[np.arange(len(b[i : i + 4096])), own[i : i + 4096]] for i in range(0, len(a), 4096)]
            self.strip = float(np.quantile(np.concatenate(behind), REACHED)) + 1e-6

    def _behind(self, x: np.ndarray) -> np.ndarray:
        """How far each row lies behind each cell's border; 0 in its own cell."""
        d = self.half - x @ self.centres.T
        own = np.argmin(d, axis=1)
        at = np.arange(len(x))
        out = np.maximum(d - d[at, own][:, None], 0) / self.apart[own]
        out[at, own] = 0
        return out

    def dealt(self, x: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, cells, whether the row is at home there, and the hot vector it is (-1: none).

        Copies of a hot vector beyond those that stand for it are in cells of
        their own, numbered after the others.
        """
        rows, cells, homes = [], [], []
        for a in range(0, len(x), 4096):
            s = self._behind(x[a : a + 4096])
            r, c = np.nonzero(s <= self.strip)
            rows.append(a + r)
            cells.append(c)
            homes.append(np.argmin(s, axis=1)[r] == c)
        row, cell, home = (np.concatenate(p) if p else np.empty(0, np.int64) for p in (rows, cells, homes))
        hot = np.full(len(x), -1)
        if self.hot:
            got = [self.hot.get(v.tobytes()) for v in np.ascontiguousarray(x)]
            at = np.array([i for i, g in enumerate(got) if g is not None], np.int64)
            if len(at):
                hot[at] = [got[i][0] for i in at]
                salts = np.array([got[i][1] for i in at])
                salt = (keys[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % salts
                away = np.zeros(len(x), np.int64)
                away[at] = np.where(salt > 0, len(self.centres) + hot[at] + len(self.hot) * (salt - 1), 0)
                kept = (away[row] == 0) | home.astype(bool)
                row, cell, home = row[kept], cell[kept], home[kept]
                cell = np.where(away[row] > 0, away[row], cell)
        return row, cell, home.astype(bool), hot[row]

    def count(self) -> int:
        """How many cells there are, with those of copies."""
        return len(self.centres) + len(self.hot) * max((s for _, s in self.hot.values()), default=0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each ``place`` of a stream sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for t in batches:
        v = t["place"].to_numpy()
        cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1), len(v)] if len(v) else [0]
        for a, b in zip(cuts, cuts[1:]):
            if held and v[a] != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(t.slice(a, b - a))
            last = v[a]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _best(of: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` least ``d`` of each ``of``: where they are, by ``of`` and ``d``, and their ranks."""
    by = np.lexsort((d, of))
    first = np.flatnonzero(np.r_[True, of[by][1:] != of[by][:-1]]) if len(by) else np.empty(0, np.int64)
    rank = np.arange(len(by)) - np.repeat(first, np.diff(np.r_[first, len(by)]))
    return by[rank < k], rank[rank < k]


def _neighbours(df: DataFrame, asked: np.ndarray, centres: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``asked`` rows and their nearest of all rows that are no copies of theirs."""
    sq = (asked * asked).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, d, v = np.empty(0, np.int64), np.empty(0, np.float32), np.empty((0, width), np.float32)
        far = np.full(len(asked), np.inf, np.float32)
        for t in batches:
            every = filled(unpacked(t["v"], width), centres)
            for a in range(0, len(every), 4096):
                x = every[a : a + 4096]
                i, j = np.nonzero((x * x).sum(1) - 2 * asked @ x.T < (far * 1.0001 + 1e-3 - sq)[:, None])
                if not len(i):
                    continue
                exact = ((asked[i] - x[j]) ** 2).sum(1)
                good = (exact > 0) & (exact < far[i])
                q, d, v = np.r_[q, i[good]], np.r_[d, exact[good]], np.concatenate([v, x[j[good]]])
                by = np.lexsort((d, q))
                by = by[np.r_[True, (q[by][1:] != q[by][:-1]) | (d[by][1:] != d[by][:-1])]] if len(by) else by  # copies count once
                at, rank = _best(q[by], d[by], descent.LINKS)
                q, d, v = q[by][at], d[by][at], v[by][at]
                far[q[rank == descent.LINKS - 1]] = d[rank == descent.LINKS - 1]
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(d), packed(v)], ["q", "d", "v"])

    near = df.select("v").mapInArrow(run, "q long, d float, v binary").dropDuplicates(["q", "d"])
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d"))).where(F.col("r") <= descent.LINKS)
    got = near.orderBy("q", "d").select("q", "v").toArrow()  # LINKS for each row asked, at most
    return asked[got["q"].to_numpy()], unpacked(got["v"], width)


def _sums(a: np.ndarray, b: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Values added up by pair."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, np.int64)
    return a[at], b[at], *(np.add.reduceat(v[order], at) if len(at) else v for v in values)


def _degrees(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, com: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Of each row the weight to its own community, and to which others how much."""
    same = com[a] == com[b]
    inner = np.bincount(a[same], w[same], n) + np.bincount(b[same], w[same], n)
    a, b, w = a[~same], b[~same], w[~same]
    src, to, wt = np.r_[a, b], np.r_[com[b], com[a]], np.r_[w, w]
    by = np.argsort(src, kind="stable")
    offsets = pa.array(np.searchsorted(src[by], np.arange(n + 1)).astype(np.int32))
    return inner, pa.ListArray.from_arrays(offsets, pa.array(to[by])), pa.ListArray.from_arrays(offsets, pa.array(wt[by]))


class _Graph:
    """The graph of one cell: the neighbours of its own rows, there and among the visitors.

    A link weighs 1 / (1 + distance) for each of its ends that has the other in its
    list; ``c`` is the number of these ends.  Each of several copies is linked with the next ones in the order of keys.
    """

    def __init__(self, x: np.ndarray) -> None:
        first, which = _distinct(x)
        self.first, self.which = first, which
        idx, dist = descent.descend(x[first])
        self.x = np.ascontiguousarray(x[first], np.float32)
        self.sq = np.einsum("ij,ij->i", self.x, self.x)
        n, m = idx.shape
        self.ids, self.dist = np.full((n, descent.LINKS), -1, np.int64), np.full((n, descent.LINKS), np.inf, np.float32)  # numbers of own rows, keys of visitors
        self.ids[:, :m], self.dist[:, :m] = idx, np.where(idx >= 0, dist, np.inf)
        self.visits = np.zeros(self.ids.shape, bool)

    def meet(self, x: np.ndarray, keys: np.ndarray, mine: np.ndarray, theirs: np.ndarray, strip: float) -> None:
        """Visitors, sorted by key, from the cell of the centre ``theirs`` are compared with the own rows near that border."""
        first, _ = _distinct(x)
        x, keys = np.ascontiguousarray(x[first], np.float32), keys[first]
        turn = theirs - mine
        behind = ((theirs @ theirs - mine @ mine) / 2 - self.x @ turn) / np.sqrt(max(float(turn @ turn), 1e-12))
        live = np.flatnonzero(behind <= np.minimum(OWN * strip, np.sqrt(self.dist[:, -1])))  # who is beyond the border is no nearer than the border
        right = np.ascontiguousarray(np.concatenate([x, np.einsum("ij,ij->i", x, x)[:, None]], axis=1).T)
        step = max(1, _PAIRS // len(x))
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a in range(0, len(live), step):
            rows = live[a : a + step]
            d = np.concatenate([-2 * self.x[rows], np.ones((len(rows), 1), np.float32)], axis=1) @ right
            hit = np.flatnonzero(d < (self.dist[rows, -1] - self.sq[rows])[:, None])
            u = rows[hit // len(x)]
            d = np.maximum(d.reshape(-1)[hit] + self.sq[u], 0)
            at, _ = _best(u, d, descent.LINKS)
            hits.append((u[at], keys[hit[at] % len(x)], d[at]))
            if sum(len(h[0]) for h in hits) > _HITS or a + step >= len(live):
                self._take_in(*(np.concatenate(c) for c in zip(*hits)))
                hits = []

    def _take_in(self, u: np.ndarray, keys: np.ndarray, d: np.ndarray) -> None:
        at, rank = _best(u, d, descent.LINKS)
        rows, line = np.unique(u[at], return_inverse=True)
        ids, dist = np.full((len(rows), descent.LINKS), -1, np.int64), np.full((len(rows), descent.LINKS), np.inf, np.float32)
        ids[line, rank], dist[line, rank] = keys[at], d[at]
        ids, dist = np.concatenate([self.ids[rows], ids], axis=1), np.concatenate([self.dist[rows], dist], axis=1)
        visits = np.concatenate([self.visits[rows], np.ones((len(rows), descent.LINKS), bool)], axis=1)
        order = np.argsort(dist, axis=1, kind="stable")[:, : descent.LINKS]
        self.ids[rows], self.dist[rows], self.visits[rows] = (np.take_along_axis(m, order, 1) for m in (ids, dist, visits))

    def link(self, resolution: float, seed: int) -> None:
        """The links ``a``, ``b`` of own rows, those to visitors (``far``: row, key, weight), and the first communities."""
        n, m = len(self.first), len(self.which)
        src, dst = np.repeat(np.arange(n), descent.LINKS), self.ids.reshape(-1)
        w = 1 / (1 + np.sqrt(self.dist.reshape(-1), dtype=np.float64))
        there, out = np.isfinite(self.dist.reshape(-1)), self.visits.reshape(-1)
        self.far = self.first[src[there & out]], dst[there & out], w[there & out]
        src, dst, w = src[there & ~out], dst[there & ~out], w[there & ~out]
        self.x = self.ids = self.dist = self.visits = None
        a, b, w, c = _sums(np.minimum(src, dst), np.maximum(src, dst), w, np.ones(len(w)))
        self.com = communities(n, a, b, w, resolution, seed=seed)[self.which]
        by = np.lexsort((np.arange(m), self.which))
        rings = [(by[:-s], by[s:]) for s in range(1, min(descent.LINKS // 2, m - 1) + 1)] if n < m else []
        same = [(u[self.which[u] == self.which[v]], v[self.which[u] == self.which[v]]) for u, v in rings]
        self.a, self.b = np.concatenate([self.first[a], *(u for u, _ in same)]), np.concatenate([self.first[b], *(v for _, v in same)])
        more = np.full(len(self.a) - len(w), 2.0)
        self.w, self.c = np.r_[w, more], np.r_[c, more]


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each vector, in the order of rows, and which of these each row has."""
    plain = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 4))).reshape(-1)
    _, first, which = np.unique(plain, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return first[order], place[which.reshape(-1)]


_OUT = "kind byte, k long, com long, b long, w double, c double"


def similarity_clusters(df: DataFrame, key: str, width: int, also: str, typical: bool = False, resolution: float = RESOLUTION, seed: int = 0) -> DataFrame:
    """``key``, ``also``, ``cluster`` of each row (and ``degree`` if ``typical``).

    ``df`` has ``key`` (BIGINT, unique), ``v`` (packed float32, NaN missing) and
    a column ``also``.  Clusters are numbered from 0 by falling size, ties by the
    least number of a member community; rows of clusters of ``LEAST`` members or
    fewer have -1.  ``degree`` is the row's internal weighted degree: the weights
    of its links to rows of its own cluster.  Missing values are filled from the
    nearest centre.  Exact copies are always of one cluster.  An empty table
    gives an empty result.
    """
    kind = dict(df.dtypes)[also]
    n = df.count()
    x = sample(df, key, width, SAMPLE, n)
    whole = x[~np.isnan(x).any(axis=1)]
    centres = kmeans(whole if len(whole) else np.zeros((1, width), np.float32), 64, 8, np.random.default_rng(seed))
    cells = Cells(filled(x, centres), n, seed + 1)
    if len(x) < n and len(cells.asked):
        cells.reach(*_neighbours(df, cells.asked, centres, width))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            v = filled(unpacked(t["v"], width), centres)
            row, cell, home, hot = cells.dealt(v, t[key].to_numpy())
            at = pa.array(row)
            name = t[also].take(pa.array(row, mask=~home))  # goes with the row's own cell only
            own = np.empty(len(v), np.int64)
            own[row[home]] = cell[home]
            place = (cell.astype(np.int64) << 32) + np.where(home, 0, own[row] + 1)  # visitors by the cell they come from
            yield pa.RecordBatch.from_arrays([pa.array(place), t[key].take(at), packed(v[row]), name, pa.array(hot)], ["place", "k", "v", "also", "hot"])

    names = ["kind", "k", "com", "b", "w", "c", "also", *(["inner", "oc", "ow"] if typical else [])]
    more = ", inner double, oc array<long>, ow array<double>" if typical else ""
    copies, middles, strip = len(cells.centres), cells.centres, cells.strip

    def in_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())

        def batch(mark: int, text: pa.DataType, k, com, b, w, c, name=None, extra=()) -> pa.RecordBatch:
            m = len(com)
            columns = [pa.array(np.full(m, mark, np.int8)), pa.nulls(m, pa.int64()) if k is None else pa.array(k), pa.array(com), pa.nulls(m, pa.int64()) if b is None else pa.array(b), pa.nulls(m, pa.float64()) if w is None else pa.array(w), pa.nulls(m, pa.float64()) if c is None else pa.array(c)]
            columns.append(pa.nulls(m, text) if name is None else name)
            if typical:
                columns += list(extra) or [pa.nulls(m, pa.float64()), pa.nulls(m, longs), pa.nulls(m, doubles)]
            return pa.RecordBatch.from_arrays(columns, names)

        def done(g: _Graph, cell: int, keys: np.ndarray, hot: np.ndarray, name: pa.Array) -> Iterator[pa.RecordBatch]:
            g.link(resolution, seed)
            com = (cell << 32) + g.com
            yield batch(0, name.type, keys, com, None, None, None, name, _degrees(len(com), g.a, g.b, g.w, com) if typical else ())
            lo, hi = com[g.a], com[g.b]
            a, b, w, c = _sums(np.minimum(lo, hi), np.maximum(lo, hi), g.w, g.c)
            yield batch(1, name.type, None, a, b, w, c)
            src, dst, w = g.far
            if typical:
                yield batch(2, name.type, dst, com[src], keys[src], w, np.ones(len(w)))
            else:
                a, v, w, c = _sums(com[src], dst, w, np.ones(len(w)))
                yield batch(2, name.type, v, a, None, w, c)
            stand = np.flatnonzero(hot >= 0)
            _, at = np.unique(hot[stand], return_index=True)
            yield batch(3, name.type, None, com[stand[at]], _COPY + hot[stand[at]], None, None)

        open_: tuple | None = None  # the graph of the cell at hand, and what its rows are
        for t in _groups(batches):
            place = t["place"][0].as_py()
            cell, other = place >> 32, (place & 0xFFFFFFFF) - 1
            keys, x = t["k"].to_numpy(), unpacked(t["v"], width)
            if other >= 0:
                if open_ and open_[1] == cell:
                    open_[0].meet(x, keys, middles[cell], middles[other], strip)
                continue
            if open_:
                yield from done(*open_)
                open_ = None
            hot, name = t["hot"].to_numpy(), t["also"].combine_chunks()
            if cell >= copies:  # copies of a hot vector: linked with one another, like those that stand for it
                none = pa.array([[]] * len(keys), longs), pa.array([[]] * len(keys), doubles)
                yield batch(0, name.type, keys, _COPY + hot, None, None, None, name, (pa.array(np.full(len(keys), 2.0 * descent.LINKS)), *none))
            else:
                open_ = _Graph(x), cell, keys, hot, name
        if open_:
            yield from done(*open_)

    dealt = df.select(key, "v", also).mapInArrow(deal, f"place long, k long, v binary, also {kind}, hot long")
    dealt = dealt.repartitionById(cells.count(), F.shiftright("place", 32).cast("int")).sortWithinPartitions("place", "k")  # the same graphs whatever the order of arrival
    local = written(dealt.mapInArrow(in_cell, f"{_OUT}, also {kind}{more}"), "local")

    rows = local.where("kind = 0")
    if any(s > 1 for _, s in cells.hot.values()):
        stands = local.where("kind = 3").groupBy(F.col("b").alias("com")).agg(F.min("com").alias("__real"))  # at most SAMPLE / HOT rows
        rows = rows.join(F.broadcast(stands), "com", "left").withColumn("com", F.coalesce("__real", "com")).drop("__real")
    far = local.where("kind = 2").select("k", F.col("com").alias("a"), F.col("b").alias("src"), "w", "c")
    links = far.join(rows.select("k", F.col("com").alias("b")), "k").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w", "c")
    links = links.unionByName(local.where("kind = 1").select(F.col("com").alias("a"), "b", "w", "c"))
    links = written(links.groupBy("a", "b").agg(F.sum("w").alias("w"), F.sum("c").alias("c")), "links")
    final = _last_levels(rows, links, resolution, seed)  # com, cluster
    out = rows.join(final, "com", "left").select(F.col("k").alias(key), F.col("also").alias(also), F.coalesce("cluster", F.lit(-1)).alias("cluster"), *(["inner", "oc", "ow"] if typical else []))
    if not typical:
        return out
    mine = out.select(F.col(key).alias("k"), "cluster", "inner", "oc", "ow")
    near = mine.select("k", "cluster", F.explode(F.arrays_zip("oc", "ow")).alias("z")).select("k", "cluster", F.col("z.oc").alias("com"), F.col("z.ow").alias("w"))
    near = near.join(final.withColumnRenamed("cluster", "c2"), "com").where("cluster = c2").select("k", "w")
    met = far.withColumnRenamed("a", "com").join(final.withColumnRenamed("cluster", "c2"), "com").join(mine.select("k", "cluster"), "k").where("cluster = c2")
    met = met.select(F.explode(F.array("k", "src")).alias("k"), "w")
    degree = mine.select("k", F.col("inner").alias("w")).unionByName(near).unionByName(met).groupBy("k").agg(F.sum("w").alias("degree"))
    return out.select(key, also, "cluster").join(degree.withColumnRenamed("k", key), key)


def joined(a: np.ndarray, b: np.ndarray, w: np.ndarray, c: np.ndarray, com: np.ndarray, share: float = SHARE, stretch: float = STRETCH) -> np.ndarray:
    """``com`` with communities put together while enough of the links of one of them lead to another, and short ones.

    ``a``, ``b``, ``w``, ``c``: the links of the graph, their weights 1 / (1 + length)
    and numbers.  The closest pairs first, those that are each other's closest in
    one step.
    """
    names, com = np.unique(com, return_inverse=True)
    n = len(names)
    top = np.arange(n)
    while True:
        s, t = top[com[a]], top[com[b]]
        lo, hi, sums, count = _sums(np.minimum(s, t), np.maximum(s, t), w, c)
        length = np.maximum(count / np.maximum(sums, 1e-300) - 1, 0)
        volume = np.bincount(lo, count, n) + np.bincount(hi, count, n)
        out = lo != hi
        inner = np.zeros(n)
        inner[lo[~out]] = length[~out]
        lo, hi, count, length = lo[out], hi[out], count[out], length[out]
        part = count / np.maximum(np.minimum(volume[lo], volume[hi]), 1e-300)
        near = (part >= share) & (length <= stretch * np.maximum(inner[lo], inner[hi]))
        lo, hi, part = lo[near], hi[near], part[near]
        if not len(lo):
            return top[com]
        order = np.lexsort((hi, lo, -part))
        best = np.full(n, len(order))
        for ends in (lo, hi):
            np.minimum.at(best, ends[order], np.arange(len(order)))
        i = order[np.unique(best[best < len(order)])]
        rank = np.empty(len(lo), np.int64)
        rank[order] = np.arange(len(order))
        i = i[(best[lo[i]] == rank[i]) & (best[hi[i]] == rank[i])]  # each other's closest
        move = np.arange(n)
        move[hi[i]] = lo[i]
        top = move[top]


def _last_levels(rows: DataFrame, links: DataFrame, resolution: float, seed: int) -> DataFrame:
    """``com``, ``cluster``: the contracted graph brought to clusters, numbered by size."""
    spark = rows.sparkSession
    names = written(rows.groupBy("com").agg(F.count(F.lit(1)).alias("n")).withColumn("top", F.col("com")), "names")  # com -> node of the contracted graph
    graph, merged = links, True
    while merged and graph.count() > LINKS_ON_DRIVER:
        graph, step, merged = contracted(graph.select("a", "b", "w"), resolution)
        names = written(names.join(step.select(F.col("old").alias("top"), "new"), "top", "left").select("com", "n", F.coalesce("new", "top").alias("top")), "names")
    if graph is not links:  # with the numbers of links
        links = _renamed(links, names.select(F.col("com").alias("old"), F.col("top").alias("new")))
    if graph.count() > LINKS_ON_DRIVER:  # nothing is left to move, so that only the joining remains
        names = _joined_by_joins(links, names)
    else:
        got = links.orderBy("a", "b").toPandas()
        ids, at = np.unique(np.r_[got["a"].to_numpy(np.int64), got["b"].to_numpy(np.int64)], return_inverse=True)
        a, b, w, c = at[: len(got)], at[len(got) :], got["w"].to_numpy(float), got["c"].to_numpy(float)
        best = max((communities(len(ids), a, b, w, resolution, 12, seed + s) for s in range(3)), key=lambda com: modularity(a, b, w, com, resolution))
        best = joined(a, b, w, c, best)
        first = np.full(best.max(initial=-1) + 1, len(ids))
        np.minimum.at(first, best, np.arange(len(ids)))
        if len(ids):
            moved = spark.createDataFrame(pd.DataFrame({"top": ids, "new": ids[first[best]]}), "top long, new long")  # at most two for each link
            names = names.join(moved, "top", "left").select("com", "n", F.coalesce("new", "top").alias("top"))
    names = written(names, "names")
    large = names.groupBy("top").agg(F.sum("n").alias("size")).where(F.col("size") > LEAST)
    large = numbered(large, [F.desc("size"), "top"], "cluster").select("top", F.col("cluster").cast("int").alias("cluster"))
    return broadcast_if_small(written(names.join(large, "top").select("com", "cluster"), "clusters"))


def _renamed(links: DataFrame, names: DataFrame) -> DataFrame:
    """Links between ``new`` nodes: ``names`` has ``old``, ``new`` for every node."""
    for end in ("a", "b"):
        links = links.join(names.select(F.col("old").alias(end), "new"), end).withColumn(end, F.col("new")).drop("new")
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w", "c")
    return written(links.groupBy("a", "b").agg(F.sum("w").alias("w"), F.sum("c").alias("c")), "links")


def _joined_by_joins(links: DataFrame, names: DataFrame) -> DataFrame:
    """``joined`` on a graph of any size, whose nodes are the communities: ``names`` with new ``top``."""
    while True:
        ends = links.select(F.col("a").alias("node"), "c").unionByName(links.select(F.col("b").alias("node"), "c"))
        length = F.greatest(F.col("c") / F.greatest("w", F.lit(1e-300)) - 1, F.lit(0.0))
        inner = links.where("a = b").select(F.col("a").alias("node"), length.alias("inner"))
        nodes = ends.groupBy("node").agg(F.sum("c").alias("volume")).join(inner, "node", "left").fillna(0.0, ["inner"])
        near = links.where("a <> b").withColumn("length", length)
        for end in ("a", "b"):
            near = near.join(nodes.select(F.col("node").alias(end), F.col("volume").alias(f"v{end}"), F.col("inner").alias(f"i{end}")), end)
        near = near.withColumn("part", F.col("c") / F.least("va", "vb")).where((F.col("part") >= SHARE) & (F.col("length") <= STRETCH * F.greatest("ia", "ib"))).select("a", "b", "part")
        near = written(near, "near")
        order = F.struct(-F.col("part"), "a", "b")
        best = near.select(F.col("a").alias("node"), "a", "b", "part").unionByName(near.select(F.col("b").alias("node"), "a", "b", "part")).groupBy("node").agg(F.min_by(F.struct("a", "b"), order).alias("e"))
        both = best.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n = 2")  # each other's closest
        moved = written(both.select(F.col("e.b").alias("old"), F.col("e.a").alias("new")), "moved")
        if not moved.take(1):
            return names
        nodes = nodes.select(F.col("node").alias("old")).join(moved, "old", "left").select("old", F.coalesce("new", "old").alias("new"))
        links = _renamed(links, nodes)
        names = written(names.join(moved.select(F.col("old").alias("top"), "new"), "top", "left").select("com", "n", F.coalesce("new", "top").alias("top")), "names")
