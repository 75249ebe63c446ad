"""Neighbour descent on one cell of vectors, in plain arrays.

Random-projection trees give the first lists: within a leaf all rows are
compared.  Then, round by round, the neighbours of a row and the rows that have
it as a neighbour are compared with one another, if one of the two came in
since the last round; whatever is nearer than the farthest kept neighbour comes
in.  Memory grows with the rows of the cell only.
"""

from __future__ import annotations

import numpy as np

LINKS = 8  # neighbours given for a row
KEPT = 12  # neighbours kept while descending
ROUNDS = 3
TREES = 7
LEAF = 1024
FIRST = 512  # rows of a leaf of the first tree
STOP = 0.02  # the descent ends when a smaller share of the lists changes
_PAIRS = 1 << 18  # pairs compared at a time
_HITS = 1 << 22  # candidates held at a time


class _Lists:
    """The neighbours of each row, nearest first, with their squared distances and whether they are new."""

    def __init__(self, n: int, k: int) -> None:
        self.idx = np.full((n, k), -1, np.int32)
        self.dist = np.full((n, k), np.inf, np.float32)
        self.new = np.ones((n, k), bool)

    def take_in(self, u: np.ndarray, v: np.ndarray, d: np.ndarray) -> int:
        """Candidates ``v`` of rows ``u`` at distances ``d``; how many came in."""
        n, k = self.idx.shape
        fresh = ~(self.idx[u] == v[:, None]).any(axis=1)
        code, at = np.unique(u[fresh].astype(np.int64) * n + v[fresh], return_index=True)
        if not len(code):
            return 0
        u, v, d = code // n, (code % n).astype(np.int32), d[fresh][at]
        by = np.lexsort((v, d, u))
        u, v, d = u[by], v[by], d[by]
        first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        run = np.diff(np.r_[first, len(u)])
        rank = np.arange(len(u)) - np.repeat(first, run)
        kept = rank < k
        line = np.repeat(np.arange(len(first)), run)[kept]
        ids, ds = np.full((len(first), k), -1, np.int32), np.full((len(first), k), np.inf, np.float32)
        ids[line, rank[kept]], ds[line, rank[kept]] = v[kept], d[kept]
        rows = u[first]
        ids, ds = np.concatenate([self.idx[rows], ids], axis=1), np.concatenate([self.dist[rows], ds], axis=1)
        new = np.concatenate([self.new[rows], np.ones((len(rows), k), bool)], axis=1)
        order = np.argsort(ds, axis=1, kind="stable")[:, :k]
        self.idx[rows], self.dist[rows], self.new[rows] = (np.take_along_axis(m, order, 1) for m in (ids, ds, new))
        return int((order >= k).sum() - (~np.isfinite(self.dist[rows])).sum())


def descend(x: np.ndarray, links: int = LINKS, rounds: int = ROUNDS, trees: int = TREES, leaf: int = LEAF, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Approximate neighbours of each row, nearest first: numbers (-1: none) and squared distances.

    Fewer rows than ``links`` + 1 give fewer columns.  Up to ``leaf`` rows all
    are compared, so that the lists are exact.
    """
    n = len(x)
    if n < 2:
        return np.empty((n, 0), np.int32), np.empty((n, 0), np.float32)
    k = min(max(links, KEPT), n - 1)
    x = np.ascontiguousarray(x, np.float32)
    sq = np.einsum("ij,ij->i", x, x)
    # one product gives a squared distance less the first row's own square
    ends = np.concatenate([-2 * x, np.ones((n, 1), np.float32)], axis=1), np.concatenate([x, sq[:, None]], axis=1), sq
    rng = np.random.default_rng(seed)
    lists = _Lists(n, k)
    for tree in range(trees if n > leaf else 1):
        # a first tree of small leaves, so that little passes in the larger ones
        _within_leaves(lists, ends, _leaves(x, min(leaf, FIRST) if n > leaf else leaf, rng) if tree == 0 else _leaves(x, leaf, rng), tree == 0)
    for _ in range(rounds if n > leaf else 0):
        if _local_joins(lists, ends) < STOP * n * k:
            break
    return lists.idx[:, :links], np.maximum(lists.dist[:, :links], 0)


def _leaves(x: np.ndarray, leaf: int, rng: np.random.Generator) -> np.ndarray:
    """Numbers of the rows of each leaf of a random-projection tree; the leaves are of one length and may overlap by a row."""
    n = len(x)
    parts = 1 << int(np.ceil(np.log2(max(n / leaf, 1))))
    order, place, seg = np.arange(n), np.empty(n, np.int64), 1
    while seg < parts:  # each segment is cut at its median along the line through two of its rows
        at = np.arange(n) * seg // n
        place[order] = at
        first = np.searchsorted(at, np.arange(seg))
        size = np.diff(np.r_[first, n])
        a, b = (order[first + (rng.random(seg) * size).astype(np.int64)] for _ in range(2))
        turn = x[a] - x[b]
        flat = ~turn.any(axis=1)
        turn[flat] = rng.standard_normal((int(flat.sum()), x.shape[1])).astype(np.float32)
        order = np.lexsort((np.einsum("ij,ij->i", x, turn[place]), place))
        seg *= 2
    wide = -(-n // parts)
    begin = np.minimum(np.arange(parts) * n // parts, n - wide)
    return order[begin[:, None] + np.arange(wide)]


_Ends = tuple[np.ndarray, np.ndarray, np.ndarray]


def _within_leaves(lists: _Lists, ends: _Ends, leaves: np.ndarray, first: bool) -> None:
    left, right, sq = ends
    wide = leaves.shape[1]
    m = min(lists.idx.shape[1], wide - 1)
    step = max(1, _PAIRS // wide)
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, leaf in enumerate(leaves):
        other = np.ascontiguousarray(right[leaf].T)
        for a in range(0, wide, step):
            rows = leaf[a : a + step]
            d = left[rows] @ other
            d[np.arange(len(rows)), a + np.arange(len(rows))] = np.inf
            if first:
                at = np.argpartition(d, m - 1, axis=1)[:, :m]
                ds = np.take_along_axis(d, at, 1) + sq[rows][:, None]
                order = np.argsort(ds, axis=1, kind="stable")
                lists.idx[rows, :m], lists.dist[rows, :m] = leaf[np.take_along_axis(at, order, 1)], np.take_along_axis(ds, order, 1)
                continue
            hit = np.flatnonzero(d < (lists.dist[rows, -1] - sq[rows])[:, None])
            u = rows[hit // wide]
            hits.append((u, leaf[hit % wide].astype(np.int32), np.maximum(d.reshape(-1)[hit] + sq[u], 0)))
        if hits and (sum(len(h[0]) for h in hits) > _HITS or i + 1 == len(leaves)):
            lists.take_in(*(np.concatenate(c) for c in zip(*hits)))
            hits = []


def _local_joins(lists: _Lists, ends: _Ends) -> int:
    """One round: the neighbours of each row, in both directions, are compared with one another."""
    left, right, sq = ends
    n, k = lists.idx.shape
    here = np.arange(n, dtype=np.int32)
    there = lists.idx.reshape(-1) >= 0
    to, source, d, fresh = lists.idx.reshape(-1)[there], np.repeat(here, k)[there], lists.dist.reshape(-1)[there], lists.new.reshape(-1)[there]
    by = np.lexsort((source, d, to))
    to, source, fresh = to[by], source[by], fresh[by]
    at = np.searchsorted(to, here)[:, None] + np.arange(k)  # the nearest of those that have the row
    back = at < np.searchsorted(to, here, "right")[:, None]
    at = np.minimum(at, max(len(to) - 1, 0))
    members = np.concatenate([lists.idx, np.where(back, source[at], -1)], axis=1)
    new = np.concatenate([lists.new, fresh[at]], axis=1) & (members >= 0)
    lists.new[:] = False
    m, came = members.shape[1], 0
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    live = np.flatnonzero(new.any(axis=1))
    step = max(1, _PAIRS // (m * m))
    for a in range(0, len(live), step):
        rows, recent = members[live[a : a + step]], new[live[a : a + step]]
        d = left[rows] @ right[rows].transpose(0, 2, 1)
        far = np.where(rows < 0, -np.inf, lists.dist[rows, -1] - sq[rows])
        hit = np.flatnonzero((d < far[:, :, None]) & (recent[:, :, None] | recent[:, None, :]))
        of = hit // (m * m)
        u, w = rows[of, hit // m % m], rows[of, hit % m]
        good = (u != w) & (w >= 0)
        hits.append((u[good], w[good], np.maximum(d.reshape(-1)[hit[good]] + sq[u[good]], 0)))
        if sum(len(h[0]) for h in hits) > _HITS or a + step >= len(live):
            came += lists.take_in(*(np.concatenate(c) for c in zip(*hits)))
            hits = []
    return came
