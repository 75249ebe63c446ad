"""Small cases of the core's operators with results worked out by hand or by brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corelattice.functions import curve
from corelattice.functions.modularity import communities, connected, modularity, relabel_by_size
from corelattice.functions.special import betainc, t_two_sided, u_exact_table
from corelattice.operators import aggregate as A
from corelattice.operators import cluster, embed, evaluate, filters, graph, image, markers, metadata, stats, survival
from corelattice.operators.current import current_rows
from corelattice.operators.proximity import disc_of_polygon, inside_discs, inside_polygons, near_pairs, vertices
from corelattice.operators.quantiles import quantiles
from corelattice.plans.ranks import numbered, summed_before
from corelattice.sources import store


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


# current rows and proximity -------------------------------------------------


def test_current_rows_take_the_latest(spark):
    d = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (2, None, "c"), (2, 0, "d"), (None, 9, "e")], "cell_key long, loaded_at int, v string")
    assert rows(current_rows(d, ["v"]), "cell_key", "v") == [(1, "b"), (2, "d")]
    assert current_rows(d.limit(0), ["v"]).count() == 0


def test_codes_of_a_quad_are_one_range(spark):
    d = spark.createDataFrame([(float(i) / 4, float(j) / 4) for i in range(-8, 8) for j in range(-8, 8)], "x double, y double")
    d = curve.coded(d, "x", "y", "code").withColumn("quad", F.shiftright("code", 4))
    got = d.groupBy("quad").agg(F.count("*").alias("n"), F.min("code").alias("a"), F.max("code").alias("b")).collect()
    assert len(got) == 16 and all(r.n == 16 and r.b - r.a == 15 for r in got)


def test_near_pairs_against_all_pairs(spark):
    rng = random.Random(1)
    pts = [("i%d" % (k % 2), k, rng.uniform(-20, 20), rng.uniform(-20, 20)) for k in range(150)]
    pts += [("i0", 1000, pts[0][2], pts[0][3]), ("i0", 1001, None, 1.0), ("i0", 1002, float("nan"), 1.0), (None, 1003, 0.0, 0.0)]
    d = spark.createDataFrame(pts, "g string, k long, x double, y double").withColumn("code", F.lit(1)).withColumn("n", F.lit("z"))
    got = set(rows(near_pairs(d, "g", "k", "x", "y", 3.0), "key_a", "key_b"))
    ok = [p for p in pts if p[0] and p[2] is not None and p[2] == p[2]]
    want = {(min(a[1], b[1]), max(a[1], b[1])) for a in ok for b in ok if a[1] != b[1] and a[0] == b[0] and math.dist(a[2:], b[2:]) <= 3}
    assert got == want and (0, 1000) in got
    assert near_pairs(d.limit(0), "g", "k", "x", "y", 3.0).count() == 0


def test_inside_discs_and_polygons(spark):
    ring = ", ".join(f"{10 + 5 * math.cos(a):.4f} {20 + 5 * math.sin(a):.4f}" for a in np.linspace(0, 2 * math.pi, 33))
    cores = [(1, "g", 10.0, 20.0, 5.0, None), (2, "g", None, None, None, f"Polygon(({ring}))"), (3, "g", 10.0, 20.0, None, f"POLYGON (({ring}))"), (4, "g", 1.0, 1.0, None, None)]
    d = disc_of_polygon(spark.createDataFrame(cores, "id long, g string, x double, y double, r double, wkt string"), "wkt", "x", "y", "r")
    got = {r.id: r for r in d.collect()}
    assert abs(got[2].x - 10) < 1e-3 and abs(got[2].r - 5) < 1e-3 and abs(got[3].r - 5) < 1e-3 and got[4].r is None
    p = spark.createDataFrame([(7, "g", 13.0, 20.0), (8, "g", 16.0, 20.0), (9, "h", 10.0, 20.0)], "k long, g string, x double, y double")
    assert rows(inside_discs(p, d, "g", "k", "x", "y", "id", "x", "y", "r"), "key_a", "key_b") == [(7, 1), (7, 2), (7, 3)]


def test_regions_of_any_size_and_shape(spark):
    rng = random.Random(3)
    pts = [("g" if k % 3 else "h", k, rng.uniform(-900, 900), rng.uniform(-900, 900)) for k in range(400)] + [("g", 900, None, 0.0), (None, 901, 0.0, 0.0)]
    p = spark.createDataFrame(pts, "g string, k long, x double, y double").withColumn("__lo", F.lit(1))
    discs = [(i, "g", rng.uniform(-500, 500), rng.uniform(-500, 500), r) for i, r in enumerate([0.0, 0.1, 3.0, 40.0, 260.0, 800.0, 5000.0])]
    d = spark.createDataFrame(discs, "id long, g string, x double, y double, r double")
    ok = [q for q in pts if q[0] == "g" and q[2] is not None]
    want = sorted((q[1], c[0]) for q in ok for c in discs if math.dist(q[2:], c[2:4]) <= c[4])
    assert rows(inside_discs(p, d, "g", "k", "x", "y", "id", "x", "y", "r"), "key_a", "key_b") == want and want
    star = [(700 * (1 if i % 2 else 0.3) * math.cos(i * math.pi / 5), 700 * (1 if i % 2 else 0.3) * math.sin(i * math.pi / 5)) for i in range(10)]
    text = "polygon ((" + ", ".join(f"{x:.3f} {y:.3f}" for x, y in [*star, star[0]]) + "))"
    poly = spark.createDataFrame([(1, "g", text), (2, "g", None), (3, "g", "POLYGON EMPTY"), (4, "h", text)], "id long, g string, wkt string").withColumn("ring", vertices("wkt"))

    def inside(x, y):
        ends = list(zip(star, [*star[1:], star[0]]))
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in ends) % 2 == 1

    want = sorted((q[1], 1 if q[0] == "g" else 4) for q in pts if q[0] and q[2] is not None and inside(q[2], q[3]))
    assert rows(inside_polygons(p, poly, "g", "k", "x", "y", "id", "ring"), "key_a", "key_b") == want and len(want) > 20
    assert inside_polygons(p, poly.limit(0), "g", "k", "x", "y", "id", "ring").count() == 0


# filters and transforms -----------------------------------------------------


def test_filters_are_strict_and_drop_missing(spark):
    d = spark.createDataFrame([(i, float(i), "a" if i < 6 else "b", i) for i in range(11)] + [(99, None, None, 0), (98, float("nan"), "c", 0)], "k int, v double, c string, count int")
    assert [r[0] for r in rows(filters.by_quantile(d, "v", 0.1, 0.9), "k")] == list(range(2, 9))
    assert [r[0] for r in rows(filters.by_value(d, "v", 3, 6), "k")] == [4, 5]
    assert [r[0] for r in rows(filters.by_count(d, "c", 5, 10), "k")] == [0, 1, 2, 3, 4, 5]
    x = d.withColumn("x", F.array("v"))
    assert [r[0] for r in rows(filters.by_marker_quantile(x, "x", 0, 0.1, 0.9), "k")] == list(range(2, 10))
    with pytest.raises(ValueError):
        filters.by_count(d, "v")
    with pytest.raises(ValueError):
        filters.by_value(d, "c")
    with pytest.raises(ValueError):
        filters.by_category(d, "c", ["a", "zz"])
    assert rows(filters.relabel(d.where("k in (0, 6, 99)"), "c", {"a": "A"}, "l"), "k", "l") == [(0, "A"), (6, "nan"), (99, "nan")]
    assert rows(filters.with_size_rank(d.where("c is not null"), "c", 1, "r").select("c", "r").distinct(), "c", "r") == [("a", 0), ("b", 1), ("c", -1)]
    assert filters.columns_of_kind(d)["numeric"] == ["k", "v", "count"]


def test_transforms(spark):
    d = spark.createDataFrame([(1, [1.0, 1.0, 1.0]), (2, [1.0, 2.0, 3.0]), (3, None), (4, [None, float("nan"), 4.0])], "k int, x array<double>")
    get = lambda df, c="x": {r.k: r[c] for r in df.collect()}
    z = get(markers.zscore_rows(d, "x", 3))
    assert z[1] == [None] * 3 and z[3] is None and np.allclose(z[2], [-1.2247449, 0, 1.2247449])
    assert get(markers.fill_na(d, "x", 3, 7.0))[4] == [7.0, 7.0, 4.0]
    p = get(markers.percentile_normalise(d, "x", 3))
    assert p[4][0] == 0.0 and p[3] is None if 3 in p else True
    s = get(markers.scale_columns(d, "x", 3))
    assert s[1][0] == 0.0 and s[2][0] == 0.0  # constant marker is only centred
    n = get(markers.normalise_log2p(d, "x", 3))
    assert np.allclose(n[2], np.log2(np.array([1, 2, 3]) / 6 + 1e-3))
    c = get(markers.chain(d, "x", 3, ["fill_na", "arcsinh"]), "fill_na_arcsinh_x")
    assert np.allclose(c[2], np.arcsinh(np.array([1, 2, 3]) / 150))
    a, var = markers.add_obs_as_markers(d, "x", ["a", "b", "c"], ["k"])
    assert get(a, "augmented_x")[2][3] == 2.0 and var[-1] == "k_var"
    assert get(markers.subset_markers(d, "x", ["a", "b", "c"], ["c", "a"]))[2] == [3.0, 1.0]
    with pytest.raises(ValueError):
        markers.chain(d, "x", 3, ["nope"])
    with pytest.raises(ValueError):
        markers.subset_markers(d, "x", ["a"], ["z"])
    assert markers.scale_columns(d.limit(0), "x", 3).count() == 0


# aggregates -----------------------------------------------------------------


def test_aggregates(spark):
    d = spark.createDataFrame([(1, "s", "a", 0.0), (2, "s", "a", 1.0), (3, "s", "b", 5.0), (4, "s", None, 10.0), (5, "t", "b", 11.0), (6, None, "b", 3.0), (7, "t", "b", None)], "cell_key int, s string, c string, v double").withColumn("n", F.lit(3))
    assert rows(A.category_proportions(d, "s", ["c"]), "s", "c", "n") == [("s", "a", 2), ("s", "b", 1), ("t", "b", 2)]
    assert rows(A.binned(d, "s", "v", [0, 5, 10], True), "s", "bin", "n", "proportion")[:2] == [("s", "(0, 5]", 2, 2 / 3), ("s", "(5, 10]", 1, 1 / 3)]
    assert rows(A.binned(d, "s", "v", [0, 5, 10], True).where("s = 't'"), "bin", "n", "proportion") == [("(0, 5]", 0, None), ("(5, 10]", 0, None)]
    m = {r.s: r for r in A.summarised(d, "s", "v", list(A.SUMMARIES), "cell_key").collect()}
    assert (m["s"].first_v, m["s"].last_v, m["s"].median_v, m["t"].sum_v) == (0.0, 10.0, 3.0, 11.0)
    assert rows(A.row_counts(d, "s", spark.createDataFrame([("s",), ("u",)], "s string")), "s", "n") == [("s", 4), ("u", 0)]
    roles = {r.column: r.role for r in A.key_roles(d.withColumn("p", F.col("s")).withColumn("q", F.lit("z")), "s", ["c", "p", "q"]).collect()}
    assert roles == {"c": "super", "p": "true_parallel", "q": "duplicated"}
    assert rows(A.feature_frame(A.category_counts(d, "s", ["c"]), "s", ["c"], "n"), "s", "feature", "value")[0] == ("s", "c$a", 2)
    with pytest.raises(ValueError):
        A.metadata(d, "s", "c", "summarised")
    with pytest.raises(ValueError):
        A.category_proportions(d, "s", ["c"], "v")
    with pytest.raises(Exception):
        A.parallel_value(d, "s", "c").collect()
    assert A.category_proportions(d.limit(0), "s", ["c"]).count() == 0


def test_metadata_and_trees(spark):
    d = spark.createDataFrame([(1, "s", "x"), (2, None, "y")], "k int, s string, label string")
    meta = spark.createDataFrame([("s", "L", 1.0), ("s", "L", 1.0)], "s string, label string, t double")
    assert rows(metadata.attach(d, meta, "s"), "k", "label", "t") == [(1, "x", 1.0), (2, "y", None)]
    child = spark.createDataFrame([(1, "new"), (2, "nan")], "k int, label string")
    assert rows(metadata.absorb(d, child, "k", ["label"]), "k", "label") == [(1, "new"), (2, "y")]
    nodes = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a")], "node string, parent string")
    assert rows(metadata.walk(nodes, "r"), "node", "depth", "terminal") == [("a", 1, False), ("b", 2, True), ("r", 0, False)]


# graphs ---------------------------------------------------------------------


def test_proximity_density_by_hand(spark):
    nodes = spark.createDataFrame([(1, "g", "A"), (2, "g", "A"), (3, "g", "B"), (4, "g", None)], "k long, g string, p string")
    edges = spark.createDataFrame([(1, 3, 1.0), (2, 1, 1.0), (1, 4, 1.0), (1, 99, 1.0)], "src long, dst long, weight double")
    got = {(r.phenotype_a, r.phenotype_b): r for r in graph.proximity_density(edges, nodes, "k", "g", "p", graph.all_pairs(["A", "B"])).collect()}
    assert abs(got["A", "B"].density - 2 / 3) < 1e-12 and got["A", "A"].density == 1.0
    assert got["B", "B"].density == 0.0 and got["B", "B"].masked
    with pytest.raises(ValueError):
        graph.proximity_density(edges, nodes, "k", "g", "p", [], "other")
    ratio = dict(rows(graph.degree_ratio(edges, nodes, "k", "p", "A", "B"), "k", "ratio"))
    assert ratio[2] == 0.0 and abs(ratio[1] - 1 / 4) < 1e-12
    counts = {r.k: r.counts for r in graph.neighbour_counts(edges, nodes, "k", "p", ["A", "B"]).collect()}
    assert counts == {1: [0, 1], 2: [1, 0], 3: [0, 0], 4: [0, 0]}


def test_links_keep_null_weights_and_drop_zeros(spark):
    e = spark.createDataFrame([(1, 2, None), (1, 2, 0.0), (1, 3, 0.0), (2, 2, 1.0), (None, 1, 1.0)], "src long, dst long, weight double")
    assert rows(graph.links(e), "src", "dst", "weight") == [(1, 2, 1.0), (2, 2, 1.0)]


def test_nearest_in_group_against_all_pairs(spark):
    rng = random.Random(3)
    pts = [("a" if k % 3 else "b", k, rng.gauss(0, 5), rng.gauss(0, 1)) for k in range(90)] + [("c", 900, 0.0, 0.0), ("c", 901, 300.0, 0.0)]
    d = spark.createDataFrame(pts, "g string, k long, x double, y double")
    got = {}
    for r in graph.nearest_in_group(d, "g", "k", "x", "y", 4).collect():
        got.setdefault(r.src, {})[r.rank] = r.dst
    for p in pts:
        near = sorted((math.dist(p[2:], q[2:]), q[1]) for q in pts if q[0] == p[0] and q[1] != p[1])[:4]
        assert [got[p[1]][i + 1] for i in range(len(near))] == [k for _, k in near]


def test_nearest_vectors_metrics(spark):
    d = spark.createDataFrame([(i, [float(i), float(i * i), 1.0]) for i in range(12)] + [(50, None)], "k long, v array<double>")
    got = rows(graph.nearest_vectors(d.where("k = 3"), d, "k", "v", 2), "src", "dst", "rank")
    assert [g[1] for g in sorted(got, key=lambda g: g[2])] == [2, 4]
    for metric in ("cosine", "correlation", "minkowski"):
        assert graph.nearest_vectors(d.where("k = 3"), d, "k", "v", 2, metric, 1.0).count() == 2
    with pytest.raises(ValueError):
        graph.nearest_vectors(d, d, "k", "v", 2, "other")
    assert graph.nearest_vectors(d.limit(0), d, "k", "v", 2).count() == 0


def test_jaccard_by_hand_and_isolated(spark):
    near = spark.createDataFrame([(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)], "src long, dst long")
    w = rows(graph.jaccard(near, 2), "first", "second", "weight")
    assert [x[:2] for x in w] == [(1, 0), (2, 0), (2, 1)] and all(abs(x[2] - 1 / 3) < 1e-12 for x in w)
    nodes = spark.createDataFrame([(0,), (1,), (2,), (7,)], "k long")
    assert (7, 7, 1.0) in rows(graph.with_isolated(graph.jaccard(near, 2), nodes, "k"), "first", "second", "weight")


def test_communities_of_two_cliques():
    a, b = np.array([(i, j) for g in (0, 5) for i in range(g, g + 5) for j in range(i + 1, g + 5)] + [(0, 5)]).T
    com = communities(10, a, b, np.ones(len(a)))
    assert len(set(com)) == 2 and len(set(com[:5])) == 1
    assert modularity(a, b, np.ones(len(a)), com) > 0.4
    assert len(set(connected(4, np.array([0, 2]), np.array([1, 3]), np.zeros(4, int)))) == 2
    assert relabel_by_size(np.array([0] * 5 + [1] * 3 + [2]), None, 1).tolist() == [0] * 5 + [1] * 3 + [-1]


def test_large_graphs_move_in_parallel_first(spark, monkeypatch):
    e = [(i, j, 1.0) for g in range(0, 40, 10) for i in range(g, g + 10) for j in range(i + 1, g + 10)] + [(0, 10, 1.0), (20, 30, 1.0)]
    d = spark.createDataFrame(e, "first long, second long, weight double")
    monkeypatch.setattr(cluster, "LINKS_IN_TASK", 60)
    got = cluster.graph_clusters(d, [1.0], 2).toPandas()
    assert len(got) == 40 and all(got[got.node // 10 == g].label.nunique() == 1 for g in range(4))
    assert cluster.grid_range(0.5, 1.0, 0.25) == [0.5, 0.75, 1.0]
    with pytest.raises(ValueError):
        cluster.parameter_search(d, d, "first", [1], [1.0])


def test_contracted_nodes_are_connected(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 6000, (2, 9000))
    a, b, w = a[a < b], b[a < b], rng.choice([0.2, 1.0, 5.0], (a < b).sum())
    d = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), w.tolist())), "a long, b long, w double")
    com = np.arange(6000)
    for r in cluster.contracted(d, 1.0)[1].collect():
        com[r.old] = r.new
    com = np.unique(com, return_inverse=True)[1]
    assert len(set(com)) < 6000 and len(set(connected(6000, a, b, com))) == len(set(com))


def test_large_graphs_with_nothing_to_merge_go_to_no_task(spark, monkeypatch):
    d = spark.createDataFrame([(i, i, 1.0) for i in range(50)], "first long, second long, weight double")
    monkeypatch.setattr(cluster, "LINKS_IN_TASK", 20)
    monkeypatch.setattr(cluster, "_clustered", None)
    got = cluster.graph_clusters(d, [1.0], 0).toPandas()
    assert sorted(got.label) == list(range(50)) and np.allclose(got.quality, 1 - 1 / 50)


# agreement, tests, survival -------------------------------------------------


def test_agreement(spark):
    d = spark.createDataFrame([(i, r, str(l)) for i, (x, y) in enumerate(zip([0, 0, 1, 1], [0, 1, 0, 1])) for r, l in (("x", x), ("y", y), ("one", 0))], "k int, run string, label string")
    t = evaluate.contingency(d, "k")
    got = {(r.run_a, r.run_b): r for r in evaluate.agreement(t).collect()}
    assert got["x", "x"].ari == 1.0 and abs(got["x", "y"].ari + 0.5) < 1e-12 and got["one", "one"].ari == 1.0 and got["one", "one"].nmi == 1.0
    ami = {(r.run_a, r.run_b): r.score for r in evaluate.cluster_scores(d, "k", "AMI").collect()}
    assert abs(ami["x", "x"] - 1) < 1e-9 and ami["x", "y"] < 0
    with pytest.raises(ValueError):
        evaluate.cluster_scores(d, "k", "other")


def test_distributions():
    assert abs(betainc(2, 3, 0.4) - 0.5248) < 1e-10
    assert abs(t_two_sided(2.0, 10) - 0.07338803477074) < 1e-9 and abs(t_two_sided(12.706204736, 1) - 0.05) < 1e-9
    assert u_exact_table(2, 2).tolist() == [1, 1, 2, 1, 1]


def test_two_groups(spark):
    d = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("B", 2.0), ("B", 3.0), (None, 9.0), ("A", None)], "l string, v double")
    assert stats.mann_whitney(d, "v", "l").head().u == 0.5
    r = stats.t_test(d, "v", "l").head()
    assert abs(r.t + 1.4142135623) < 1e-9 and r.df == 2
    assert abs(stats.difference_of_means(d, "v", "l").head().difference + 1.0) < 1e-12
    assert stats.t_test(d.where("l = 'A'"), "v", "l").count() == 0 and stats.mann_whitney(d.where("l = 'A'"), "v", "l").count() == 0


def test_adjustment(spark):
    d = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p double")
    get = lambda m: [r[1] for r in rows(stats.adjust(d.where("p is not null"), "p", m), "p", "p_adjusted")]
    assert np.allclose(get("bonferroni"), [0.03, 0.09, 0.12]) and np.allclose(get("holm"), [0.03, 0.06, 0.06])
    assert np.allclose(get("fdr_bh"), [0.03, 0.04, 0.04]) and np.allclose(get("hommel"), [0.03, 0.04, 0.04])
    assert stats.adjust(d, "p", "holm").where("p is null and p_adjusted is null").count() == 1
    with pytest.raises(ValueError):
        stats.adjust(d, "p", "other")


def test_survival(spark):
    d = spark.createDataFrame([(True, 1.0), (True, 2.0), (False, 2.0), (True, 3.0), (None, 4.0), (True, None)], "e boolean, t double")
    assert [x[1] for x in rows(survival.kaplan_meier(d, "e", "t"), "time", "survival")] == pytest.approx([0.75, 0.5, 0.0])
    got = spark.createDataFrame([(True, 5.0), (False, 5.0), (True, 7.0)], "e boolean, t double")
    assert rows(survival.at_risk(got, "e", "t"), "tick", "at_risk") == [(0.0, 3), (5.0, 2), (10.0, 0)]
    rng = np.random.default_rng(0)
    x = rng.normal(size=200)
    t = rng.exponential(1 / np.exp(0.8 * x))
    s = spark.createDataFrame([(True, float(a), float(b), 1.0) for a, b in zip(t, x)], "e boolean, t double, x double, c double")
    path = survival.cox(s, "e", "t", ["x", "c"], [10.0, 0.0])
    assert path[0]["coef"] == {"x": 0.0, "c": 0.0} and abs(path[1]["coef"]["x"] - 0.8) < 0.2
    assert survival.concordance(s, "e", "t", "x") > 0.65
    brute = [(r, q) for r in zip(t, x) for q in zip(t, x) if r[0] < q[0]]
    assert abs(survival.concordance(s, "e", "t", "x") - np.mean([a[1] > b[1] for a, b in brute])) < 1e-9
    assert survival.cox(s.limit(0), "e", "t", ["x"], [0.1])[0]["coef"] == {"x": 0.0}


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 3)) @ np.diag([5, 2, 0.5])
    d = spark.createDataFrame([(i, v.tolist(), "a" if i % 2 else "b") for i, v in enumerate(m)] + [(99, [1.0, None, 2.0], "a")], "k long, x array<double>, b string")
    out, parts, var = embed.pca(d, "x", 3, 2)
    want = np.linalg.eigvalsh(np.cov(m.T))[::-1][:2]
    assert np.allclose(var, want) and out.where("k = 99").head().x_pca is None
    shifted = d.where("k < 99").withColumn("x", F.when(F.col("b") == "a", F.transform("x", lambda v: v + 3)).otherwise(F.col("x")))
    h = embed.harmony(shifted, "k", "x", "b", 3, clusters=2, rounds=3).toPandas()
    gap = lambda c: abs(np.mean(np.stack(h[h.b == "a"][c])) - np.mean(np.stack(h[h.b == "b"][c])))
    assert gap("x_harmony") < 0.5 * gap("x")


# images and sources ---------------------------------------------------------


def test_projection_and_measures(spark):
    px = spark.createDataFrame([("i", c, y, x, float((x + y + k) % 2)) for k, c in enumerate(["c1", "c2"]) for y in range(3) for x in range(3)], "image string, c string, y int, x int, value double")
    for m, v in (("max", 1.0), ("sum", 1.0), ("mean", 0.5), ("median", 0.5)):
        got = image.project(px, ["c1", "c2"], m)
        assert {r.value for r in got.collect()} == {v} and got.head().c == f"{m}[c1_c2]"
    with pytest.raises(ValueError):
        image.project(px, ["c1"], "other")
    lab = spark.createDataFrame([("i", 0, 0, 1), ("i", 0, 1, 1), ("i", 2, 2, 2), ("i", 1, 1, 0)], "image string, y int, x int, label int")
    got = {(r.label, r.c): r for r in image.measure(lab, px).collect()}
    assert got[1, "c1"].area == 2 and got[1, "c1"].intensity == 0.5 and got[1, "c1"].centroid_x == 0.5 and abs(got[2, "c2"].eccentricity) < 1e-9
    big = spark.createDataFrame([("i", 3, 3, 5), ("i", 3, 6, 6)], "image string, y int, x int, label int")
    assert image.grown(big, 1).count() == 10


def test_masks_blobs_and_grids(spark):
    yy, xx = np.mgrid[:40, :40]
    a = np.exp(-((yy - 10) ** 2 + (xx - 10) ** 2) / 30) + np.exp(-((yy - 30) ** 2 + (xx - 28) ** 2) / 30)
    px = spark.createDataFrame([("i", int(y), int(x), float(a[y, x])) for y in range(40) for x in range(40)], "image string, y int, x int, value double")
    assert image.masks(px, 1.0).select("label").distinct().count() == 2
    b = {(r.y, r.x) for r in image.blobs(px, 2.0, 6.0).collect()}
    assert b == {(10, 10), (30, 28)}
    m = np.array([[1, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0], [1, 0, 0, 1]], bool)
    assert len(np.unique(image.components(m))) == 4 and (image.components(m)[0, 0] == image.components(m)[1, 2])
    pts = spark.createDataFrame([("g", float(v)) for v in (1, 2, 30, 31, 32, 90)], "g string, y double")
    assert rows(image.gap_walk(pts, "g", "y", 10.0), "line", "centre", "n") == [(0, 1.5, 2), (1, 31.0, 3), (2, 90.0, 1)]
    blobs = spark.createDataFrame([("g", 1, 0.0, 0.0), ("g", 2, 10.0, 1.0), ("h", 3, 0.0, 0.0)], "g string, k int, x double, y double")
    r = dict(rows(image.rotation(blobs, "g", "k", "x", "y", F.lit(3.0)), "g", "angle"))
    assert abs(r["g"] - 5.710593137) < 1e-6 and r["h"] == 0.0
    lab = spark.range(1).select(image.grid_label(F.lit(0), F.lit(0)).alias("a"), image.grid_label(F.lit(27), F.lit(1)).alias("b")).head()
    assert (lab.a, lab.b) == ("A-1", "AB-2")


def test_boxes_meet_once(spark):
    rng = random.Random(2)
    d = [("g", k, x, y, x + rng.uniform(1, 40), y + rng.uniform(1, 40)) for k in range(40) for x, y in [(rng.uniform(-50, 100), rng.uniform(-50, 100))]]
    df = spark.createDataFrame(d, "g string, k int, xmin double, ymin double, xmax double, ymax double")
    got = rows(image.box_overlaps(df, df, "g", "k", "k", 25.0).where("k1 < k2"), "k1", "k2")
    want = sorted((a[1], b[1]) for a in d for b in d if a[1] < b[1] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5])
    assert got == want


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    assert s.names() == {}
    d = spark.range(5).toDF("k")
    s.put("a", d, "table")
    with pytest.raises(ValueError):
        s.put("a", d)
    s.put("a", s.get("a").where("k > 2"), overwrite=True)
    assert s.get("a").count() == 2 and s.free_name("a") == "a_1" and s.save_missing({"a": (d, "table"), "b": (d, "graph")}) == ["b"]
    s.drop("b")
    with pytest.raises(KeyError):
        s.get("b")
    (tmp_path / "m.csv").write_text("id,v,w\na,1,x\nb,,2\n")
    assert dict(store.read_metadata_csv(spark, str(tmp_path / "m.csv")).dtypes) == {"id": "string", "v": "double", "w": "string"}
    assert store.plain_name("/x/My-image 1.ome.tif") == "My_image_1" and store.channel_names(["a", "b", "a"]) == ["a_0", "b", "a_1"]


def test_numbers_and_sums_over_a_whole_table(spark):
    rng = random.Random(5)
    v = [(i, float(rng.randrange(40))) for i in range(300)]
    d = spark.createDataFrame(v, "k long, v double").repartition(3)
    order = sorted(v, key=lambda r: (r[1], r[0]))
    got = {r.k: r.n for r in numbered(d, ["v", "k"], "n").collect()}
    assert [got[k] for k, _ in order] == list(range(300))
    got = {r.k: r.s for r in summed_before(d, ["v", "k"], "v", "s").collect()}
    assert all(abs(got[k] - sum(x for _, x in order[:i])) < 1e-9 for i, (k, _) in enumerate(order))
    assert numbered(d.limit(0), ["k"], "n").count() == summed_before(d.limit(0), ["k"], "v", "s").count() == 0


def test_quantiles_are_exact(spark):
    rng = random.Random(6)
    a = [None if i % 17 == 0 else float("nan") if i % 19 == 0 else rng.choice([0.0, 1.0, rng.lognormvariate(0, 5), -rng.random()]) for i in range(2000)]
    d = spark.createDataFrame([(x, 3.0, None, i) for i, x in enumerate(a)], "a double, b double, c double, i long")
    qs = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = quantiles(d, [F.col(c) for c in "abci"], qs)
    clean = np.array([x for x in a if x is not None and x == x])
    assert np.allclose(got[0], np.quantile(clean, qs), rtol=1e-12) and got[1] == [3.0] * 5 and got[2] == [None] * 5
    assert np.allclose(got[3], np.quantile(np.arange(2000), qs))
    ends = spark.createDataFrame([(float("-inf"),), (1.0,), (float("inf"),), (2.0,), (2.0,)], "v double")
    assert quantiles(ends, [F.col("v")], [0.0, 0.5, 1.0]) == [[float("-inf"), 2.0, float("inf")]]
    assert quantiles(d.limit(0), [F.col("a")], [0.5]) == [[None]] and quantiles(d, [], [0.5]) == []


def test_values_go_up_to_every_ancestor(spark):
    rows_ = [(i, "old" if i < 3 else None) for i in range(6)]
    root = spark.createDataFrame(rows_, "k long, kind string")
    mid, leaf = root.where("k < 4"), spark.createDataFrame([(0, "new", 1.5), (1, "nan", 2.5)], "k long, kind string, extra double")
    out = metadata.absorb_upwards({"r": root, "m": mid, "l": leaf}, {"l": "m", "m": "r", "r": None}, "l", "k", ["kind", "extra"])
    assert rows(out["r"], "k", "kind", "extra")[:3] == [(0, "new", 1.5), (1, "old", 2.5), (2, "old", None)] and out["m"].count() == 4
    with pytest.raises(ValueError):
        metadata.absorb_upwards({"r": root, "m": mid}, {"m": "r", "r": "m"}, "m", "k", ["kind"])
    tree = spark.createDataFrame([("r", None), ("it's", "r"), ("l", "it's")], "node string, parent string")
    assert rows(metadata.walk(tree, "it's"), "node", "depth", "terminal") == [("it's", 0, False), ("l", 1, True)]
