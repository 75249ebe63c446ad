"""Modularity communities of a graph held in plain arrays."""

from __future__ import annotations

import numpy as np


def communities(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float = 1.0, sweeps: int = 8, seed: int = 0) -> np.ndarray:
    """Communities of a weighted undirected graph (a link of a node to itself counts twice in its degree).

    Levels of moves and contraction until nothing improves.  In a sweep, half of
    the nodes at random move to the community of a neighbour with the greatest
    gain; moves that would not raise modularity are left out.  Numbers from 0.
    """
    rng = np.random.default_rng(seed)
    label = np.arange(n)
    while True:
        com = _moves(n, a, b, w, resolution, sweeps, rng)
        names, com = np.unique(com, return_inverse=True)
        label = com[label]
        if len(names) == n:
            return label
        n = len(names)
        a, b = com[a], com[b]
        code, inv = np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_inverse=True)
        w = np.bincount(inv, w)
        a, b = code // n, code % n


def _moves(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float, sweeps: int, rng: np.random.Generator) -> np.ndarray:
    com = np.arange(n)
    degree = np.bincount(a, w, n) + np.bincount(b, w, n)
    all2 = degree.sum()
    if not all2:
        return com
    out = a != b
    src, dst, wt = np.r_[a[out], b[out]], np.r_[b[out], a[out]], np.r_[w[out], w[out]]
    if not len(src):
        return com
    order = np.argsort(src, kind="stable")
    src, dst, wt = src[order], dst[order], wt[order]
    for sweep in range(sweeps):
        weight = np.bincount(com, degree, n)
        moving = rng.random(n) < 0.5
        e = np.flatnonzero(moving[src])
        if not len(e):
            continue
        key = src[e] * n + com[dst[e]]
        by = np.argsort(key)
        key = key[by]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        into = np.add.reduceat(wt[e][by], at)
        node, to = key[at] // n, key[at] % n
        same = to == com[node]
        stay = np.zeros(n)
        stay[node[same]] = into[same]
        gain = into - resolution * degree[node] * (weight[to] - np.where(same, degree[node], 0)) / all2
        here = stay - resolution * degree * (weight[com] - degree) / all2
        # best target of each node: the greatest gain, ties to the lesser community
        best = np.full(n, -np.inf)
        np.maximum.at(best, node, gain)
        top = gain >= best[node]
        target = np.full(n, n)
        np.minimum.at(target, node[top], to[top])
        go = moving & (best > here + 1e-12) & (target < n)
        go &= target != com
        if not go.any() and sweep > 1:
            break
        com[go] = target[go]
    return com


def modularity(a: np.ndarray, b: np.ndarray, w: np.ndarray, com: np.ndarray, resolution: float = 1.0) -> float:
    """Modularity of the communities ``com``; 0 for a graph without links."""
    degree = np.bincount(a, w, len(com)) + np.bincount(b, w, len(com))
    all2 = degree.sum()
    if not all2:
        return 0.0
    inside = 2 * w[com[a] == com[b]].sum() / all2
    return float(inside - resolution * (np.bincount(com, degree) ** 2).sum() / all2**2)


def connected(n: int, a: np.ndarray, b: np.ndarray, com: np.ndarray) -> np.ndarray:
    """``com`` with every community that isn't connected split into its parts."""
    part = np.arange(n)
    inside = com[a] == com[b]
    a, b = a[inside], b[inside]
    while True:
        low = np.minimum(part[a], part[b])
        new = part.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == part).all():
            return np.unique(part, return_inverse=True)[1]
        part = new


def relabel_by_size(com: np.ndarray, n: np.ndarray | None, least: int) -> np.ndarray:
    """Numbers 0, 1, ... by falling size, ties to the lesser old number; -1 for ``least`` members or fewer."""
    if not len(com):
        return np.empty(0, np.int64)
    size = np.bincount(com, n)
    order = np.lexsort((np.arange(len(size)), -size))
    place = np.empty(len(size), np.int64)
    place[order] = np.arange(len(size))
    return np.where(size[com] > least, place[com], -1)
