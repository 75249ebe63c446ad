"""Clustering of nearest-neighbour graphs over a grid of parameters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelattice.functions.modularity import communities, connected, modularity, relabel_by_size
from corelattice.operators.graph import jaccard, with_isolated
from corelattice.plans.lineage import written
from corelattice.plans.ranks import numbered

LINKS_IN_TASK = 4_000_000  # links that one task clusters; above that, levels are parallel


def grid_range(start: float, stop: float, step: float, digits: int = 6) -> list[float]:
    """``start``, ``start`` + ``step``, ... up to and with ``stop``."""
    return [round(start + i * step, digits) for i in range(int(round((stop - start) / step)) + 1)]


def graph_clusters(edges: DataFrame, resolutions: list[float], least: int = 10, seed: int = 0) -> DataFrame:
    """``node``, ``r``, ``label``, ``quality`` for every resolution.

    ``edges``: ``first``, ``second``, ``weight``, undirected, loops allowed.
    Modularity communities (seeded moves and contraction; communities that aren't
    connected are split), numbered by size; those of ``least`` members or fewer are
    -1.  ``quality`` is the modularity before that.  The first level of moves is
    parallel whatever the size, and levels are while more than ``LINKS_IN_TASK``
    links remain; one task does the rest.  If nothing is left to merge above
    that, the communities are final.
    """
    spark = edges.sparkSession
    edges = written(edges.select(F.col("first").alias("a"), F.col("second").alias("b"), F.col("weight").cast("double").alias("w")), "edges")
    out = None
    for r in resolutions:
        small, names, merged = edges, None, True
        while merged and (names is None or small.count() > LINKS_IN_TASK):
            small, step, merged = contracted(small, r)
            names = step if names is None else written(names.join(step.select(F.col("old").alias("top"), F.col("new").alias("next")), "top").select("old", F.col("next").alias("new")), "names")
            names = names.withColumnRenamed("new", "top")
        sizes = names.groupBy("top").agg(F.count(F.lit(1)).alias("n"))
        if not merged and small.count() > LINKS_IN_TASK:
            got = _numbered(small, sizes, r, least)
        else:
            rows = small.select("a", "b", "w", F.lit(None).cast("long").alias("n"))
            rows = rows.unionByName(sizes.select(F.col("top").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("w"), "n"))
            got = rows.groupBy(F.lit(r).alias("r")).applyInPandas(_clustered(r, least, seed), "node long, label int, quality double")
        got = names.join(got.withColumnRenamed("node", "top"), "top").select(F.col("old").alias("node"), F.lit(float(r)).alias("r"), "label", "quality")
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], "node long, r double, label int, quality double")


def _numbered(edges: DataFrame, sizes: DataFrame, r: float, least: int) -> DataFrame:
    """``node``, ``label``, ``quality`` of a contracted graph whose nodes are the communities."""
    ends = edges.select(F.col("a").alias("node"), "w").unionByName(edges.select(F.col("b").alias("node"), "w"))
    degree = ends.groupBy("node").agg(F.sum("w").alias("k")).agg(F.sum("k").alias("all2"), F.sum(F.col("k") * F.col("k")).alias("squares")).head()
    inside = edges.where("a = b").agg(F.sum("w")).head()[0] or 0.0
    q = 2 * inside / degree.all2 - r * degree.squares / degree.all2**2 if degree.all2 else 0.0
    large = numbered(sizes.where(F.col("n") > least), [F.desc("n"), "top"], "label").select("top", "label")
    out = sizes.join(large, "top", "left")
    return out.select(F.col("top").alias("node"), F.coalesce("label", F.lit(-1)).cast("int").alias("label"), F.lit(float(q)).alias("quality"))


def _clustered(r: float, least: int, seed: int):
    """One task's clustering of a graph given as links, and of the sizes of contracted nodes (``b`` NULL)."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        links = t[t["b"].notna()]
        ids = np.unique(np.r_[links["a"].to_numpy(), links["b"].to_numpy().astype(np.int64)])
        a, b = np.searchsorted(ids, links["a"].to_numpy()), np.searchsorted(ids, links["b"].to_numpy().astype(np.int64))
        order = np.lexsort((b, a))
        a, b, w = a[order], b[order], links["w"].to_numpy()[order]
        com = connected(len(ids), a, b, communities(len(ids), a, b, w, r, 12, seed))
        q = modularity(a, b, w, com, r)
        many = t[t["b"].isna()].set_index("a")["n"]
        n = many.reindex(ids).fillna(1).to_numpy()
        return pd.DataFrame({"node": ids, "label": relabel_by_size(com, n, least).astype(np.int32), "quality": q})

    return run


def contracted(edges: DataFrame, resolution: float, sweeps: int = 6) -> tuple[DataFrame, DataFrame, bool]:
    """A level of moves as joins and aggregates: the contracted edges, ``old`` -> ``new``, and whether any nodes became one."""
    both = edges.where("a <> b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    degree = both.unionByName(edges.where("a = b").withColumn("w", 2 * F.col("w"))).groupBy("a").agg(F.sum("w").alias("k"))
    labels = written(degree.select("a", "k", F.col("a").alias("c")), "labels")
    all2 = labels.agg(F.sum("k")).head()[0] or 1.0
    for sweep in range(sweeps):
        total = labels.groupBy("c").agg(F.sum("k").alias("t"))
        into = both.join(labels.select(F.col("a").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("w").alias("w"))
        seen = into.join(total, "c").join(labels.select("a", "k", F.col("c").alias("own")), "a")
        gain = F.col("w") - resolution * F.col("k") * (F.col("t") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / all2
        best = seen.groupBy("a").agg(F.min_by("c", F.struct(-gain, "c")).alias("c"), F.max(gain).alias("g"), F.max(F.when(F.col("c") == F.col("own"), gain)).alias("stay"))
        moving = F.pmod(F.xxhash64("a", F.lit(sweep // 2)), F.lit(2)) == sweep % 2  # both halves take their turn
        alone = labels.join(total.withColumnRenamed("t", "tt"), "c").select("a", "k", F.col("c").alias("own"), "tt").join(best, "a", "left")
        stay = F.coalesce("stay", -resolution * F.col("k") * (F.col("tt") - F.col("k")) / all2)
        labels = written(alone.select("a", "k", F.when(moving & (F.col("g") > stay + 1e-12), F.col("c")).otherwise(F.col("own")).alias("c")), "labels")
    names = _connected(edges, labels)
    out = edges
    for c in ("a", "b"):
        out = out.join(names.select(F.col("old").alias(c), "new"), c).withColumn(c, F.col("new")).drop("new")
    out = out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").groupBy("a", "b").agg(F.sum("w").alias("w"))
    n = names.agg(F.count(F.lit(1)).alias("old"), F.countDistinct("new").alias("new")).head()
    return written(out, "edges"), names, n.new < n.old


def _connected(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``old`` -> ``new``: the communities ``c`` of the nodes ``a`` split into connected parts, named by their least node."""
    inside = edges.where("a <> b").join(labels.select("a", "c"), "a").join(labels.select(F.col("a").alias("b"), F.col("c").alias("d")), "b").where("c = d")
    inside = written(inside.select("a", "b").unionByName(inside.select(F.col("b").alias("a"), F.col("a").alias("b"))), "inside")
    parts = labels.select(F.col("a").alias("old"), F.col("a").alias("new"))
    while True:
        low = inside.join(parts.select(F.col("old").alias("b"), "new"), "b").groupBy(F.col("a").alias("old")).agg(F.min("new").alias("low"))
        step = parts.join(low, "old", "left").select("old", F.col("new").alias("was"), F.least("new", "low").alias("new"))
        step = written(step, "parts")
        parts = written(step.join(step.select(F.col("old").alias("new"), F.col("new").alias("top")), "new").select("old", "was", F.col("top").alias("new")), "parts")
        if not parts.where("new <> was").take(1):
            return parts.select("old", "new")


def parameter_search(near: DataFrame, nodes: DataFrame, key: str, ks: list[int], rs: list[float], least: int = 10, seed: int = 0) -> DataFrame:
    """``node``, ``k``, ``r``, ``label``, ``quality`` for every k and resolution.

    ``near`` has each node's max(ks) nearest (``src``, ``dst``, ``rank``); each k
    takes the first k of them, refines them to Jaccard weights, gives isolated
    nodes a loop and clusters.  ``ks`` below 2, ``rs`` not above 0 and empty lists
    raise.
    """
    if not ks or not rs:
        raise ValueError("ks and rs must not be empty")
    if min(ks) < 2 or min(rs) <= 0:
        raise ValueError("ks must be at least 2 and rs above 0")
    near = written(near.select("src", "dst", "rank"), "near")
    out = None
    for k in ks:
        edges = with_isolated(jaccard(near.where(F.col("rank") <= k), k), nodes, key)
        got = graph_clusters(edges, rs, least, seed).withColumn("k", F.lit(k))
        out = got if out is None else out.unionByName(got)
    return out.select("node", "k", "r", "label", "quality")


def exported(labels: DataFrame, cells: DataFrame, key: str, k: int, r: float, name: str = "clusters") -> DataFrame:
    """Cells with the label of one run as ``<name>_K<k>_R<r>``."""
    run = labels.where((F.col("k") == k) & (F.col("r") == r)).select(F.col("node").alias(key), F.col("label").alias(f"{name}_K{k}_R{r}"))
    return cells.join(run, key, "left")


def run_names(labels: DataFrame) -> DataFrame:
    """``run`` = ``k_r`` for the agreement scores."""
    return labels.withColumn("run", F.concat_ws("_", F.col("k").cast("string"), F.col("r").cast("string")))
