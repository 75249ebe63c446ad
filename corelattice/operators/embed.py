"""Embeddings: principal components, and batch correction of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelattice.operators.markers import marker


def covariance(df: DataFrame, x: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and sample covariance of the markers over rows without missing values, by one aggregate."""
    vals = [marker(x, i).alias(f"v{i}") for i in range(n)]
    d = df.select(*vals).dropna()
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    row = d.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"v{i}").alias(f"m{i}") for i in range(n)], *[F.covar_samp(f"v{i}", f"v{j}").alias(f"c{i}_{j}") for i, j in pairs]).head()
    c = np.zeros((n, n))
    for i, j in pairs:
        c[i, j] = c[j, i] = row[f"c{i}_{j}"] or 0.0
    return np.array([row[f"m{i}"] or 0.0 for i in range(n)]), c


def pca(df: DataFrame, x: str, n: int, k: int, out: str = "x_pca") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """``out``: scores on the first ``k`` components; and the components and their variances.

    The components come from the covariance of the whole table; each is turned so
    that its greatest entry is positive.  Rows with missing values get NULL.
    """
    mean, cov = covariance(df, x, n)
    val, vec = np.linalg.eigh(cov)
    order = np.argsort(-val)[:k]
    parts = vec[:, order].T
    parts *= np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)])[:, None]
    score = [sum(((marker(x, i) - float(mean[i])) * float(p[i]) for i in range(n)), F.lit(0.0)) for p in parts]
    made = F.array(*score)
    return df.withColumn(out, F.when(F.forall(made, lambda v: v.isNotNull()), made)), parts, val[order]


def harmony(df: DataFrame, key: str, basis: str, batch: str, width: int, clusters: int = 20, rounds: int = 5, sigma: float = 0.1, ridge: float = 1.0, seed: int = 0) -> DataFrame:
    """``<basis>_harmony``: the embedding with batch effects taken out.

    Rounds of soft k-means with a penalty for clusters in which a batch is over
    its share, then a ridge regression on batches within each cluster whose batch
    terms are subtracted.  Each round is one pass: partial sums by partition
    (clusters x batches x width numbers) are added up, so what reaches the driver
    does not grow with the rows.  Rows with a NULL batch, or an embedding that is
    NULL, of another width or has missing values, keep their embedding.
    """
    import pandas as pd

    whole = (F.size(basis) == width) & F.forall(basis, lambda v: v.isNotNull() & ~F.isnan(v))
    d = df.where(F.coalesce(whole, F.lit(False)) & F.col(batch).isNotNull())
    batches = [r[0] for r in d.select(batch).distinct().orderBy(batch).collect()]  # one row for each batch
    number = {b: i for i, b in enumerate(batches)}
    first = d.orderBy(F.xxhash64(key, F.lit(seed))).limit(20_000).select(basis).toPandas()[basis]  # start of the centres only
    z = np.stack([np.asarray(v, float) for v in first]) if len(first) else np.zeros((1, width))
    from corelattice.functions.vectors import kmeans

    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
    cen = unit(kmeans(unit(z).astype(np.float32), clusters, 10, np.random.default_rng(seed)).astype(float))
    k, nb = len(cen), len(batches)
    state = {"cen": cen, "share": np.ones((k, nb)), "beta": np.zeros((k, nb, width))}

    def soft(v: np.ndarray, b: np.ndarray, s: dict) -> np.ndarray:
        r = np.exp(-2 * (1 - unit(v) @ s["cen"].T) / sigma) * s["share"][:, b].T
        return r / np.maximum(r.sum(1, keepdims=True), 1e-300)

    def fixed(v: np.ndarray, b: np.ndarray, s: dict) -> np.ndarray:
        return v - np.einsum("nk,nkd->nd", soft(v, b, s), s["beta"][:, b].transpose(1, 0, 2))

    def arrays(t: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return np.stack([np.asarray(v, float) for v in t["v"]]), t["b"].map(number).to_numpy()

    rows = d.select(F.col(basis).alias("v"), F.col(batch).alias("b"))
    for _ in range(rounds):
        s = dict(state)

        def sums(it):
            n, m = np.zeros((k, nb)), np.zeros((k, nb, width))
            c = np.zeros((k, width))
            for t in it:
                if len(t):
                    v, b = arrays(t)
                    r = soft(v, b, s)
                    u = unit(fixed(v, b, s))
                    c += r.T @ u
                    for j in np.unique(b):
                        own = b == j
                        n[:, j] += r[own].sum(0)
                        m[:, j] += r[own].T @ v[own]
            yield pd.DataFrame({"s": [np.r_[n.reshape(-1), m.reshape(-1), c.reshape(-1)].tolist()]})

        got = rows.mapInPandas(sums, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
        n, m, c = got[: k * nb].reshape(k, nb), got[k * nb : k * nb * (1 + width)].reshape(k, nb, width), got[k * nb * (1 + width) :].reshape(k, width)
        expected = n.sum(1, keepdims=True) * n.sum(0, keepdims=True) / max(n.sum(), 1e-12)
        beta = np.zeros((k, nb, width))
        for i in range(k):  # intercept and one ridge term for each batch
            a = np.zeros((nb + 1, nb + 1))
            a[0, 0], a[0, 1:], a[1:, 0] = n[i].sum(), n[i], n[i]
            a[1:, 1:] = np.diag(n[i] + ridge)
            beta[i] = np.linalg.lstsq(a, np.vstack([m[i].sum(0), m[i]]), rcond=None)[0][1:]
        state = {"cen": unit(c), "share": ((expected + 1) / (n + 1)) ** 2, "beta": beta}
    s = dict(state)
    kind = dict(df.dtypes)[key]

    def apply(it):
        for t in it:
            if len(t):
                v, b = arrays(t)
                yield pd.DataFrame({key: t[key], "h": fixed(v, b, s).tolist()})

    made = d.select(key, F.col(basis).alias("v"), F.col(batch).alias("b")).mapInPandas(apply, f"{key} {kind}, h array<double>")
    return df.join(made, key, "left").withColumn(f"{basis}_harmony", F.coalesce("h", basis)).drop("h")
