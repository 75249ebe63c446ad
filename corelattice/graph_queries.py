"""Queries of graphs, neighbourhoods, clusterings and their agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corelattice.base import CELLS, MARKERS, cells
from corelattice.operators import cluster, embed, evaluate, graph, markers
from corelattice.operators.proximity import in_micrometres
from corelattice.plans.lineage import written
from corelattice.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return keep


_UM = f"""{CELLS}, pts AS (SELECT cell_key, c.image, x_coordinate * CASE coord_system WHEN 'um' THEN 1 ELSE mpp END AS x, y_coordinate * CASE coord_system WHEN 'um' THEN 1 ELSE mpp END AS y
FROM cells c JOIN tma_images i ON i.image = c.image WHERE x_coordinate IS NOT NULL AND y_coordinate IS NOT NULL)"""
_EDGES = "e AS (SELECT src, dst, max(coalesce(weight, 1)) AS weight FROM spatial_connectivities WHERE src IS NOT NULL AND dst IS NOT NULL AND coalesce(weight, 1) <> 0 GROUP BY ALL)"
_SYM = f"{_EDGES}, sym AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"
_VALUES = "(SELECT p, row_number() OVER (ORDER BY p) AS i FROM (SELECT DISTINCT phenotype AS p FROM cells WHERE phenotype IS NOT NULL)) v"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return in_micrometres(cells(spark, sf, "image", "x_coordinate", "y_coordinate", "coord_system"), table(spark, sf, "tma_images"), ["x_coordinate", "y_coordinate"])


def _phenotypes(own: DataFrame) -> list[str]:
    """The phenotypes there are, in order: categories, a short list."""
    return [r[0] for r in own.where("phenotype is not null").select("phenotype").distinct().orderBy("phenotype").collect()]


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.links(table(spark, sf, "spatial_connectivities"))


@query(f"WITH {_UM} SELECT a.cell_key AS src, b.cell_key AS dst, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM pts a JOIN pts b ON a.image = b.image AND a.cell_key <> b.cell_key WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 144")
def radius_graph(spark: SparkSession, sf: str) -> DataFrame:
    out = graph.radius_graph(written(_points(spark, sf), "points"), "image", "cell_key", "x_coordinate", "y_coordinate", 12.0)
    return out.withColumn("distance", F.round("distance", 6))


@query(
    f"""WITH {_UM} SELECT src, dst, distance, rank FROM (SELECT a.cell_key AS src, b.cell_key AS dst, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance,
(row_number() OVER (PARTITION BY a.cell_key ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.cell_key))::INTEGER AS rank FROM pts a JOIN pts b ON a.image = b.image AND a.cell_key <> b.cell_key) WHERE rank <= 5"""
)
def knn_region(spark: SparkSession, sf: str) -> DataFrame:
    out = graph.nearest_in_group(_points(spark, sf), "image", "cell_key", "x_coordinate", "y_coordinate", 5)
    return out.withColumn("distance", F.round("distance", 6))


@query(f"WITH {_SYM} SELECT src, dst, 1.0::DOUBLE AS weight FROM sym")
def symmetrise(spark: SparkSession, sf: str) -> DataFrame:
    return graph.symmetrise(_edges(spark, sf))


@query(
    f"""WITH {CELLS}, {_SYM}, r AS (SELECT src, count(*) FILTER (phenotype = 'fibre') / count(*) AS ratio FROM sym LEFT JOIN cells ON cell_key = dst GROUP BY 1)
SELECT cell_key, round(ratio, 9) AS ratio FROM cells LEFT JOIN r ON src = cell_key WHERE phenotype = 'duct'"""
)
def degree_ratio(spark: SparkSession, sf: str) -> DataFrame:
    own = cells(spark, sf, "phenotype")
    return graph.degree_ratio(_edges(spark, sf), own, "cell_key", "phenotype", "duct", "fibre").withColumn("ratio", F.round("ratio", 9))


@query(f"""WITH {CELLS}, {_EDGES}, r AS (SELECT src, sum(CASE WHEN phenotype = 'fibre' THEN weight ELSE 0 END) / sum(weight) AS ratio FROM e LEFT JOIN cells ON cell_key = dst GROUP BY 1)
SELECT cell_key, round(ratio, 9) AS ratio FROM cells LEFT JOIN r ON src = cell_key WHERE phenotype = 'duct'""")
def degree_ratio_directed(spark: SparkSession, sf: str) -> DataFrame:
    own = cells(spark, sf, "phenotype")
    return graph.degree_ratio(_edges(spark, sf), own, "cell_key", "phenotype", "duct", "fibre", True).withColumn("ratio", F.round("ratio", 9))


def _density_sql(method: str) -> str:
    count = "count(DISTINCT src)" if method == "nodes" else "count(*)"
    return f"""WITH {CELLS}, {_SYM}, own AS (SELECT cell_key, sample_id AS g, phenotype AS p FROM cells WHERE sample_id IS NOT NULL AND phenotype IS NOT NULL),
met AS (SELECT a.g, a.p AS pa, b.p AS pb, {count} AS i FROM sym JOIN own a ON src = a.cell_key JOIN own b ON dst = b.cell_key AND a.g = b.g GROUP BY ALL),
z AS (SELECT g, p, count(*) AS n FROM own GROUP BY ALL), v AS (SELECT * FROM {_VALUES}), q AS (SELECT a.p AS pa, b.p AS pb FROM v a JOIN v b ON a.i <= b.i),
d AS (SELECT g, pa, pb FROM (SELECT DISTINCT g FROM z), q),
s AS (SELECT d.g, d.pa, d.pb, coalesce(za.n, 0) AS n_a, coalesce(zb.n, 0) AS n_b, CASE WHEN d.pa = d.pb THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS h, coalesce(m1.i, 0) + coalesce(m2.i, 0) AS i
  FROM d LEFT JOIN z za ON za.g = d.g AND za.p = d.pa LEFT JOIN z zb ON zb.g = d.g AND zb.p = d.pb
  LEFT JOIN met m1 ON m1.g = d.g AND m1.pa = d.pa AND m1.pb = d.pb LEFT JOIN met m2 ON m2.g = d.g AND m2.pa = d.pb AND m2.pb = d.pa)
SELECT g AS sample_id, pa AS phenotype_a, pb AS phenotype_b, n_a, n_b, i * h AS interactions, (n_a + n_b) * h AS total,
       round(coalesce(i * h / nullif((n_a + n_b) * h, 0), 0), 9) AS density, (n_a + n_b) * h < 2 OR n_a = 0 OR n_b = 0 AS masked FROM s"""


def _density(spark: SparkSession, sf: str, method: str) -> DataFrame:
    own = written(cells(spark, sf, "sample_id", "phenotype"), "own")
    out = graph.proximity_density(_edges(spark, sf), own, "cell_key", "sample_id", "phenotype", graph.all_pairs(_phenotypes(own)), method)
    return out.withColumn("density", F.round("density", 9))


@query(_density_sql("nodes"))
def proximity_density(spark: SparkSession, sf: str) -> DataFrame:
    return _density(spark, sf, "nodes")


@query(_density_sql("edges"))
def pair_interactions_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _density(spark, sf, "edges")


@query(f"WITH {CELLS}, {_EDGES}, v AS (SELECT * FROM {_VALUES}), c AS (SELECT src, phenotype, count(*) AS n FROM e JOIN cells ON cell_key = dst GROUP BY ALL) SELECT cell_key, p AS phenotype, coalesce(n, 0) AS n FROM cells CROSS JOIN v LEFT JOIN c ON src = cell_key AND c.phenotype = p")
def neighbor_counts(spark: SparkSession, sf: str) -> DataFrame:
    own = written(cells(spark, sf, "phenotype"), "own")
    kinds = _phenotypes(own)
    out = graph.neighbour_counts(_edges(spark, sf), own, "cell_key", "phenotype", kinds)
    named = F.arrays_zip(F.array(*[F.lit(p) for p in kinds]).alias("p"), F.col("counts").alias("n"))
    return out.select("cell_key", F.explode(named).alias("z")).select("cell_key", F.col("z.p").alias("phenotype"), F.col("z.n").alias("n"))


def _cn(spark: SparkSession, sf: str, k: int):
    own = written(cells(spark, sf, "phenotype"), "own")
    counts = written(graph.neighbour_counts(_edges(spark, sf), own, "cell_key", "phenotype", _phenotypes(own)), "counts")
    return own, counts, graph.neighbourhoods(counts, "cell_key", k)


@query()
def kmeans_cn(spark: SparkSession, sf: str) -> DataFrame:
    return _cn(spark, sf, 6)[2][0]


@query()
def cn_enrichment_matrix(spark: SparkSession, sf: str) -> DataFrame:
    own, _, (_, centres, _) = _cn(spark, sf, 6)
    kinds = _phenotypes(own)
    row = own.agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("phenotype") == p).cast("long")).alias(str(i)) for i, p in enumerate(kinds)]).head()
    shares = [(row[str(i)] or 0) / max(row["n"], 1) for i in range(len(kinds))]
    made = graph.enrichment(centres, shares)
    rows = [(c, p, v) for c, line in enumerate(made) for p, v in zip(kinds, line)]
    return spark.createDataFrame(rows, "cluster int, phenotype string, score double")


@query()
def inertia_knee(spark: SparkSession, sf: str) -> DataFrame:
    own = written(cells(spark, sf, "phenotype"), "own")
    counts = written(graph.neighbour_counts(_edges(spark, sf), own, "cell_key", "phenotype", _phenotypes(own)), "counts")
    ks = [2, 4, 6, 8]
    cost = [graph.neighbourhoods(counts, "cell_key", k)[2] for k in ks]
    best = graph.knee(ks, cost)
    return spark.createDataFrame([(k, c, k == best) for k, c in zip(ks, cost)], "k int, inertia double, knee boolean")


# embedding space ------------------------------------------------------------

_NEAR = """d AS (SELECT a.vec_id AS src, b.vec_id AS dst, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id{where}),
near AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY src ORDER BY distance, dst))::INTEGER AS rank FROM d) WHERE rank <= 10)"""


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "embedding")


@query("WITH " + _NEAR.format(where=" AND a.vec_id % 100 = 0") + " SELECT src, dst, round(distance, 5) AS distance, rank FROM near")
def knn_embedding(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return graph.nearest_vectors(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding", 10).withColumn("distance", F.round("distance", 5))


@query(
    """WITH v AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda e: e::DOUBLE ** 2))) AS len FROM embeddings),
d AS (SELECT a.vec_id AS src, b.vec_id AS dst, 1 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (a.len * b.len) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0)
SELECT src, dst, round(distance, 5) AS distance, rank FROM (SELECT *, (row_number() OVER (PARTITION BY src ORDER BY distance, dst))::INTEGER AS rank FROM d) WHERE rank <= 10"""
)
def knn_embedding_cosine(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return graph.nearest_vectors(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding", 10, "cosine").withColumn("distance", F.round("distance", 5))


def _near(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return written(graph.nearest_vectors(v, v, "vec_id", "embedding", 10), "near")


_JACCARD = (
    "WITH " + _NEAR.format(where="") + """, s AS (SELECT a.src, a.dst, (SELECT count(*) FROM near x JOIN near y ON x.dst = y.dst WHERE x.src = a.src AND y.src = a.dst) AS k FROM near a),
j AS (SELECT src, dst, k / (20.0::DOUBLE - k) AS j FROM s WHERE k > 0), w AS (SELECT greatest(src, dst) AS first, least(src, dst) AS second, sum(j) / 2 AS weight FROM j GROUP BY ALL)"""
)


@query(_JACCARD + " SELECT first, second, round(weight, 9) AS weight FROM w")
def jaccard_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.jaccard(_near(spark, sf), 10).withColumn("weight", F.round("weight", 9))


@query(_JACCARD + " SELECT first, second, round(weight, 9) AS weight FROM w UNION ALL SELECT vec_id, vec_id, 1.0 FROM embeddings WHERE vec_id NOT IN (SELECT first FROM w UNION SELECT second FROM w)")
def isolated_nodes(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return graph.with_isolated(graph.jaccard(_near(spark, sf), 10), v, "vec_id").withColumn("weight", F.round("weight", 9))


@query()
def cluster_grid(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.parameter_search(_near(spark, sf), _vectors(spark, sf), "vec_id", [5, 10], [0.5, 1.0])


@query()
def cluster_grid_scores(spark: SparkSession, sf: str) -> DataFrame:
    grid = written(cluster.parameter_search(_near(spark, sf), _vectors(spark, sf), "vec_id", [5, 10], [0.5, 1.0]), "grid")
    return evaluate.cluster_scores(cluster.run_names(grid), "node", "ARI")


@query()
def graph_cluster_spatial(spark: SparkSession, sf: str) -> DataFrame:
    """Communities of the stored graph of cells."""
    e = graph.symmetrise(_edges(spark, sf)).where("src <= dst")
    return cluster.graph_clusters(e.select(F.col("src").alias("first"), F.col("dst").alias("second"), "weight"), [1.0])


@query()
def pca(spark: SparkSession, sf: str) -> DataFrame:
    own = markers.log1p(cells(spark, sf, "x"), "x", MARKERS)
    out, _, _ = embed.pca(written(own, "own"), "x", MARKERS, 5)
    return out.where("x_pca is not null").select("cell_key", "x_pca")


@query()
def harmony(spark: SparkSession, sf: str) -> DataFrame:
    own = written(cells(spark, sf, "x_pca", "coord_system"), "own")
    return embed.harmony(own, "cell_key", "x_pca", "coord_system", 6, rounds=3).select("cell_key", "x_pca_harmony")


# agreement ------------------------------------------------------------------


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    own = cells(spark, sf, "phenotype", "neighborhood", "phase")
    runs = F.array(*[F.struct(F.lit(c).alias("run"), F.col(c).alias("label")) for c in ("phenotype", "neighborhood", "phase")])
    return own.select("cell_key", F.explode(runs).alias("r")).select("cell_key", "r.run", "r.label")


_CONT = f"""{CELLS}, l AS (SELECT cell_key, 'phenotype' AS run, phenotype AS label FROM cells UNION ALL SELECT cell_key, 'neighborhood', neighborhood FROM cells UNION ALL SELECT cell_key, 'phase', phase FROM cells),
t AS (SELECT x.run AS run_a, y.run AS run_b, x.label AS a, y.label AS b, count(*)::DOUBLE AS n FROM l x JOIN l y USING (cell_key) WHERE x.label IS NOT NULL AND y.label IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {_CONT} SELECT run_a, run_b, a, b, n::BIGINT AS n FROM t")
def contingency(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.contingency(_labels(spark, sf), "cell_key")


@query(
    f"""WITH {_CONT}, ra AS (SELECT run_a, run_b, a, sum(n) AS na FROM t GROUP BY ALL), rb AS (SELECT run_a, run_b, b, sum(n) AS nb FROM t GROUP BY ALL),
tt AS (SELECT run_a, run_b, sum(n) AS m, sum(n * (n - 1) / 2) AS s FROM t GROUP BY ALL),
sa AS (SELECT run_a, run_b, sum(na * (na - 1) / 2) AS sa, -sum(na / m * ln(na / m)) AS ha FROM ra JOIN tt USING (run_a, run_b) GROUP BY ALL),
sb AS (SELECT run_a, run_b, sum(nb * (nb - 1) / 2) AS sb, -sum(nb / m * ln(nb / m)) AS hb FROM rb JOIN tt USING (run_a, run_b) GROUP BY ALL),
mi AS (SELECT run_a, run_b, sum(n / m * ln(m * n / (na * nb))) AS mi FROM t JOIN ra USING (run_a, run_b, a) JOIN rb USING (run_a, run_b, b) JOIN tt USING (run_a, run_b) GROUP BY ALL)
SELECT run_a, run_b, m::BIGINT AS cells, round((s - sa * sb / (m * (m - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (m * (m - 1) / 2)), 9) AS ari, round(mi, 9) AS mi, round(mi / ((ha + hb) / 2), 9) AS nmi
FROM tt JOIN sa USING (run_a, run_b) JOIN sb USING (run_a, run_b) JOIN mi USING (run_a, run_b)"""
)
def cluster_agreement(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.agreement(written(evaluate.contingency(_labels(spark, sf), "cell_key"), "table"))
    return out.withColumns({c: F.round(c, 9) for c in ("ari", "mi", "nmi")})


@query()
def cluster_ami(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.cluster_scores(_labels(spark, sf), "cell_key", "AMI")
