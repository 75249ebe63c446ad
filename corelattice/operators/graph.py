"""Graphs as edge tables ``src``, ``dst``, ``weight``: building, neighbours, proximity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corelattice.operators.proximity import inside_discs, near_pairs
from corelattice.plans.lineage import written


QUERY_BLOCK = 100_000  # query vectors held by a task at a time, about


def links(edges: DataFrame) -> DataFrame:
    """Clean directed edges: no NULL ends, no stored zeros, one row for each (src, dst).

    A NULL or NaN weight is a link of weight 1; of repeated rows the greatest
    weight counts.
    """
    w = F.coalesce(F.nanvl(F.col("weight"), F.lit(None).cast("double")), F.lit(1.0))
    return edges.where("src is not null and dst is not null").withColumn("weight", w).where("weight <> 0").groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def symmetrise(edges: DataFrame) -> DataFrame:
    """Both directions of every edge once, with weight 1; loops stay."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.distinct().withColumn("weight", F.lit(1.0))


def between(edges: DataFrame, nodes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Edges with the ``columns`` of both ends as ``<c>_src``, ``<c>_dst``; ends that aren't nodes drop the edge."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(nodes.select(F.col(key).alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end)
    return out


def radius_graph(points: DataFrame, group: str, key: str, x: str, y: str, radius: float) -> DataFrame:
    """``src``, ``dst``, ``distance`` in both directions for points of a group within ``radius``."""
    pairs = near_pairs(points, group, key, x, y, radius)
    there = pairs.select(F.col("key_a").alias("src"), F.col("key_b").alias("dst"), "distance")
    return there.unionByName(pairs.select(F.col("key_b").alias("src"), F.col("key_a").alias("dst"), "distance"))


def nearest_in_group(points: DataFrame, group: str, key: str, x: str, y: str, k: int) -> DataFrame:
    """``src``, ``dst``, ``distance``, ``rank``: the ``k`` nearest points of the same group, exactly, ties by key.

    Rounds of range joins: all neighbours within a radius are found, points with
    ``k`` of them are done, and the others look twice as far.  Groups with fewer
    points give what they have.  NULL coordinates give no row.
    """
    pts = points.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"))
    pts = written(pts.where("g is not null and k is not null and x is not null and y is not null and not isnan(x) and not isnan(y)"), "points")
    boxes = pts.groupBy("g").agg(F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    boxes = written(boxes.withColumn("diameter", F.sqrt(F.col("w") * F.col("w") + F.col("h") * F.col("h"))), "boxes")
    fit = boxes.agg(F.sum(F.greatest(F.col("w") * F.col("h"), F.lit(1e-9))), F.sum("n")).head()
    r = max(1e-6, ((fit[0] or 1.0) * 2 * k / (3.14159 * max(fit[1] or 1, 1))) ** 0.5)
    open_, done = pts, None
    while True:
        # the disc's own radius and the bound of all points of its group
        met = inside_discs(pts, open_.withColumn("r", F.lit(float(r))), "g", "k", "x", "y", "k", "x", "y", "r")
        # the k best are kept task by task before they meet, so no list is longer
        met = met.where("key_a <> key_b").withColumn("__r", F.row_number().over(Window.partitionBy("key_b").orderBy("distance", "key_a"))).where(F.col("__r") <= k)
        met = met.groupBy("key_b").agg(F.array_sort(F.collect_list(F.struct("distance", "key_a"))).alias("near"))
        state = open_.join(met.withColumnRenamed("key_b", "k"), "k", "left").join(boxes.select("g", "diameter"), "g")
        state = written(state.withColumn("ready", (F.coalesce(F.size("near"), F.lit(0)) >= k) | (F.col("diameter") <= r)), "near")
        ready = state.where("ready and near is not null").select("k", "near")
        done = ready if done is None else done.unionByName(ready)
        open_ = state.where("not ready").select("g", "k", "x", "y")
        if not open_.take(1):
            break
        r *= 2
    flat = done.select(F.col("k").alias("src"), F.posexplode("near").alias("rank", "n"))
    return flat.select("src", F.col("n.key_a").alias("dst"), F.col("n.distance").alias("distance"), (F.col("rank") + 1).alias("rank"))


def degree_ratio(edges: DataFrame, nodes: DataFrame, key: str, phenotype: str, a: str, b: str, directed: bool = False) -> DataFrame:
    """``key``, ``ratio`` of each ``a`` cell: weight of its edges to ``b`` cells over that of all; NULL without edges."""
    e = edges if directed else symmetrise(edges)
    met = e.join(nodes.select(F.col(key).alias("dst"), F.col(phenotype).alias("p")), "dst", "left")
    per = met.groupBy("src").agg(F.sum(F.when(F.col("p") == b, F.col("weight")).otherwise(0.0)).alias("to_b"), F.sum("weight").alias("all"))
    out = nodes.where(F.col(phenotype) == a).select(F.col(key).alias("src")).join(per, "src", "left")
    return out.select(F.col("src").alias(key), (F.col("to_b") / F.nullif(F.col("all"), F.lit(0.0))).alias("ratio"))


def proximity_density(edges: DataFrame, nodes: DataFrame, key: str, group: str, phenotype: str, pairs: list[tuple[str, str]], method: str = "nodes") -> DataFrame:
    """``group``, ``phenotype_a``, ``phenotype_b``, ``n_a``, ``n_b``, ``interactions``, ``total``, ``density``, ``masked``.

    Every pair of ``pairs`` for every group that has a cell with a phenotype.
    Edges are taken in both directions and only within a group.  ``nodes``: cells
    of either kind with a neighbour of the other; ``edges``: edges between them,
    both directions counted.  ``total`` = n_a + n_b; for a pair of like kinds
    both are halved.  ``density`` is 0 if ``total`` is 0; ``masked`` if ``total``
    is less than 2 or a kind has no cell.
    """
    if method not in ("nodes", "edges"):
        raise ValueError(f"unknown method {method}")
    own = nodes.where(F.col(group).isNotNull() & F.col(phenotype).isNotNull()).select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(phenotype).alias("p"))
    e = between(symmetrise(edges), own, "k", ["g", "p"]).where("g_src = g_dst")
    if method == "nodes":
        e = e.select("src", "g_src", "p_src", "p_dst").distinct()
    met = e.groupBy(F.col("g_src").alias("g"), F.col("p_src").alias("a"), F.col("p_dst").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("i"))
    sizes = own.groupBy("g", "p").agg(F.count(F.lit(1)).alias("n"))
    rows = sizes.select("g").distinct().select("g", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])).alias("q")).select("g", "q.a", "q.b")
    for c in ("a", "b"):
        rows = rows.join(sizes.select("g", F.col("p").alias(c), F.col("n").alias(f"n_{c}")), ["g", c], "left")
    rows = rows.join(met, ["g", "a", "b"], "left").join(met.select("g", F.col("a").alias("b"), F.col("b").alias("a"), F.col("i").alias("j")), ["g", "a", "b"], "left")
    half = F.when(F.col("a") == F.col("b"), 0.5).otherwise(1.0)
    out = rows.fillna(0, ["n_a", "n_b", "i", "j"]).withColumn("interactions", (F.col("i") + F.col("j")) * half).withColumn("total", (F.col("n_a") + F.col("n_b")) * half)
    out = out.withColumn("density", F.when(F.col("total") == 0, 0.0).otherwise(F.col("interactions") / F.nullif(F.col("total"), F.lit(0.0))))
    masked = (F.col("total") < 2) | (F.col("n_a") == 0) | (F.col("n_b") == 0)
    return out.select(F.col("g").alias(group), F.col("a").alias("phenotype_a"), F.col("b").alias("phenotype_b"), "n_a", "n_b", "interactions", "total", "density", masked.alias("masked"))


def all_pairs(values: list[str]) -> list[tuple[str, str]]:
    """Pairs with repetition, in the order given."""
    return [(a, b) for i, a in enumerate(values) for b in values[i:]]


def pairs_of(left: list[str], right: list[str], every: list[str]) -> list[tuple[str, str]]:
    """All pairs of a left and a right value; an empty side stands for all."""
    return [(a, b) for a in (left or every) for b in (right or every)]


def neighbour_counts(edges: DataFrame, nodes: DataFrame, key: str, phenotype: str, values: list[str]) -> DataFrame:
    """``key`` and ``counts`` (array in the order of ``values``): stored edges to cells of each phenotype.

    Edges are taken as stored, not in both directions.  Cells without edges have
    zeros; a NULL phenotype counts in no position.
    """
    met = edges.select("src", "dst").join(nodes.select(F.col(key).alias("dst"), F.col(phenotype).alias("p")), "dst")
    per = met.groupBy("src").agg(*[F.sum((F.col("p") == v).cast("long")).alias(f"__{i}") for i, v in enumerate(values)])
    out = nodes.select(F.col(key).alias("src")).join(per, "src", "left")
    return out.select(F.col("src").alias(key), F.array(*[F.coalesce(F.col(f"__{i}"), F.lit(0).cast("long")) for i in range(len(values))]).alias("counts"))


def neighbourhoods(counts: DataFrame, key: str, k: int, seed: int = 0) -> tuple[DataFrame, list[list[float]], float]:
    """Cells by cluster of their neighbour counts (``key``, ``cluster``), the centres, and the inertia."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = counts.select(key, array_to_vector(F.transform("counts", lambda v: v.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=seed, initMode="k-means||", maxIter=50).fit(data)
    rows = model.transform(data).select(key, F.col("prediction").alias("cluster"))
    return rows, [c.tolist() for c in model.clusterCenters()], float(model.summary.trainingCost)


def enrichment(centres: list[list[float]], shares: list[float]) -> list[list[float | None]]:
    """log2 of the centre's smoothed composition over the global shares; None where a share is 0."""
    import math

    out = []
    for c in centres:
        total = sum(v + f for v, f in zip(c, shares))
        out.append([math.log2((v + f) / total / f) if f > 0 and total > 0 else None for v, f in zip(c, shares)])
    return out


def knee(ks: list[float], values: list[float]) -> float | None:
    """The point of a falling convex curve farthest below the line between its ends; None for fewer than 3 points."""
    if len(ks) < 3 or max(values) == min(values):
        return None
    x = [(k - ks[0]) / (ks[-1] - ks[0]) for k in ks]
    y = [(v - min(values)) / (max(values) - min(values)) for v in values]
    gap = [1 - a - b for a, b in zip(x, y)]
    return ks[max(range(len(ks)), key=lambda i: (gap[i], -i))]


def jaccard(near: DataFrame, k: int) -> DataFrame:
    """``first`` > ``second``, ``weight``: mean of both directions' neighbour-set Jaccard of nearest-neighbour edges.

    ``near`` has ``src``, ``dst`` (each node's ``k`` nearest).  An edge in one
    direction only has half its weight; edges of weight 0 are dropped.  Sets have
    at most ``k`` members, so each is one short array.
    """
    sets = near.groupBy("src").agg(F.collect_set("dst").alias("s"))
    e = near.select("src", "dst").distinct().join(sets, "src").join(sets.select(F.col("src").alias("dst"), F.col("s").alias("s2")), "dst")
    shared = F.size(F.array_intersect("s", "s2"))
    e = e.withColumn("j", shared / (F.lit(2.0 * k) - shared)).where("j > 0")
    return e.groupBy(F.greatest("src", "dst").alias("first"), F.least("src", "dst").alias("second")).agg((F.sum("j") / 2).alias("weight"))


def with_isolated(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """``first``, ``second``, ``weight`` with a loop of weight 1 for every node without an edge."""
    ends = edges.select(F.col("first").alias("e")).unionByName(edges.select(F.col("second").alias("e"))).distinct()
    alone = nodes.select(F.col(key).alias("e")).distinct().join(ends, "e", "left_anti")
    return edges.select("first", "second", "weight").unionByName(alone.select(F.col("e").alias("first"), F.col("e").alias("second"), F.lit(1.0).alias("weight")))


def nearest_vectors(queries: DataFrame, vectors: DataFrame, key: str, vec: str, k: int, metric: str = "euclidean", p: float = 2.0) -> DataFrame:
    """``src``, ``dst``, ``distance``, ``rank``: the ``k`` nearest vectors of each query, exactly, ties by key.

    The queries are a stated set and travel to every task, ``QUERY_BLOCK`` at a
    time; the vectors are scanned once, each task keeps the ``k`` best
    of its rows for every query, and the bests are merged.  ``metric``:
    euclidean, minkowski (``p``), cosine, correlation.  A vector isn't its own
    neighbour.  NULL vectors are left out.
    """
    import numpy as np
    import pandas as pd

    if metric not in ("euclidean", "minkowski", "cosine", "correlation"):
        raise ValueError(f"unknown metric {metric}")
    q = queries.where(F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vec).alias("v"))
    n = q.count()
    blocks = -(-n // QUERY_BLOCK) if n > 2 * QUERY_BLOCK else 1
    if blocks > 1:  # more than travel at a time: block after block
        parts = [nearest_vectors(q.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == i).select(F.col("k").alias(key), F.col("v").alias(vec)), vectors, key, vec, k, metric, p) for i in range(blocks)]
        out = parts[0]
        for d in parts[1:]:
            out = out.unionByName(d)
        return out
    got = q.orderBy("k").toPandas()
    if got.empty:
        return queries.sparkSession.createDataFrame([], "src long, dst long, distance double, rank int")
    qk, qv = got["k"].to_numpy(), np.stack([np.asarray(v, float) for v in got["v"]])

    def shaped(m: np.ndarray) -> np.ndarray:
        if metric == "correlation":
            m = m - m.mean(axis=1, keepdims=True)
        if metric in ("cosine", "correlation"):
            m = m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)
        return m

    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if metric in ("cosine", "correlation"):
            return 1 - a @ b.T
        if metric == "euclidean" or (metric == "minkowski" and p == 2):
            return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))
        if metric == "minkowski":
            return (np.abs(a[:, None, :] - b[None]) ** p).sum(-1) ** (1 / p)
        raise ValueError(f"unknown metric {metric}")

    qs = shaped(qv)

    def best(batches):
        for t in batches:
            if not len(t):
                continue
            keys = t["k"].to_numpy()
            v = shaped(np.stack([np.asarray(r, float) for r in t["v"]]))
            for i in range(0, len(qs), 256):
                d = distances(qs[i : i + 256], v)
                d[keys[None, :] == qk[i : i + 256, None]] = np.inf
                m = min(k, d.shape[1])
                at = np.lexsort((np.broadcast_to(keys, d.shape), d), axis=1)[:, :m]
                r = np.repeat(np.arange(len(d)), m)
                c = at.reshape(-1)
                ok = np.isfinite(d[r, c])
                yield pd.DataFrame({"src": qk[i + r[ok]], "dst": keys[c[ok]], "distance": d[r[ok], c[ok]]})

    rows = vectors.where(F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vec).alias("v"))
    met = rows.mapInPandas(best, "src long, dst long, distance double")
    w = Window.partitionBy("src").orderBy("distance", "dst")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
