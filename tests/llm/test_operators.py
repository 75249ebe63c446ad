"""Problems 2 to 8 against brute force, exact round trips and held-out accuracy."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corelattice.llm import abuse, communities, descent, mixing, neighbours, packing, percentiles, together
from corelattice.llm.profiles import packed, profiles, unpacked
from corelattice.plans.lineage import written


def _profiles(spark, m, extra=()):
    rows = [(i, [None if v != v else float(v) for v in r]) for i, r in enumerate(np.expm1(m))] + list(extra)
    d = spark.createDataFrame(rows, "cell_key long, x array<double>").withColumn("k", F.lit("clash")).withColumn("also", F.lit(None).cast("string"))
    return profiles(d, "cell_key", "x", m.shape[1], ["also"])


# percentiles ----------------------------------------------------------------


def _chunks(spark, values, rows=20):
    d = spark.createDataFrame(values, "s string, k long, x array<double>").withColumn("grp", F.lit(1)).withColumn("count", F.lit(2))
    return written(percentiles.sorted_chunks(d, "s", "x", 2, "k", rows), "chunks")


def test_percentiles_are_exact_over_many_chunks(spark):
    rng = random.Random(0)
    hot = [("hot", i, [float(rng.choice([1, 2, 2, 3, rng.random() * 10])), None if i % 7 == 0 else rng.gauss(0, 1)]) for i in range(900)]
    rest = [("one", 9000, [5.0, float("nan")]), ("two", 9001, [1.0, 2.0]), ("two", 9002, [2.0, 4.0]), (None, 9003, [1.0, 1.0]), ("null", 9004, None), ("short", 9005, [1.0])]
    got = {(r.grp, r.pos, r.percent): r.value for r in percentiles.percentiles(_chunks(spark, hot + rest), [0.0, 25.0, 50.0, 97.5, 100.0], gather=64).collect()}
    for p in (0.0, 25.0, 50.0, 97.5, 100.0):
        for j in (0, 1):
            v = [r[2][j] for r in hot if r[2][j] is not None]
            assert abs(got["hot", j, p] - np.percentile(v, p)) < 1e-12
    assert got["two", 1, 50.0] == 3.0 and got["one", 0, 50.0] == 5.0 and ("one", 1, 50.0) not in got and not any(k[0] in ("null", "short", None) for k in got)


def test_percentiles_of_parts_put_together(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=2000)
    rows = [("g", i, [float(x), 1.0]) for i, x in enumerate(v)]
    both = written(_chunks(spark, rows[:700]).unionByName(_chunks(spark, rows[700:])), "both")
    exact = {(r.pos, r.percent): r.value for r in percentiles.percentiles(both, [50.0], gather=100).collect()}
    assert abs(exact[0, 50.0] - np.median(v)) < 1e-12 and exact[1, 50.0] == 1.0
    big = _chunks(spark, rows[:1000], 500).unionByName(_chunks(spark, rows[1000:], 500))
    thin = percentiles.thin(big, 0.02)
    for r in percentiles.thin_percentiles(thin, [5.0, 50.0, 95.0]).where("pos = 0").collect():
        assert abs((v < r.value).sum() - r.percent / 100 * len(v)) <= 0.02 * len(v) + 1 and r.total == 2000
    assert thin.agg(F.sum(F.size("vals"))).head()[0] < 400


def test_percentiles_of_nothing(spark):
    c = _chunks(spark, [("a", 1, [1.0, 2.0])]).limit(0)
    assert percentiles.percentiles(written(c, "none"), [50.0]).count() == 0


# pairs ----------------------------------------------------------------------


def test_pair_counts_and_association(spark):
    rng = random.Random(2)
    rows = [("s%d" % rng.choice([0, 0, 0, 1]), rng.randrange(5), rng.randrange(5)) for _ in range(3000)]
    d = spark.createDataFrame(rows + [(None, 1, 1), ("s0", None, 2)], "g string, a int, b int").withColumn("code", F.lit(1)).withColumn("n", F.lit(5))
    got = {(r.grp, r.a, r.b): r.n for r in together.pair_counts(d.repartition(3), "g", "a", "b").collect()}
    want: dict = {}
    for g, a, b in rows:
        want[g, min(a, b), max(a, b)] = want.get((g, min(a, b), max(a, b)), 0) + 1
    assert got == want
    counts = spark.createDataFrame([("s", 0, 1, 8), ("s", 0, 0, 1), ("s", 1, 2, 2)], "grp string, a long, b long, n long")
    r = {(x.a, x.b): x for x in together.association(counts).collect()}
    assert (r[0, 1].m, r[0, 1].d_a, r[0, 1].d_b) == (11, 10, 10) and abs(r[0, 1].lift - 2 * 11 * 8 / 100) < 1e-12
    assert abs(r[0, 1].odds_ratio - 8.5 * 10.5 / (2.5 * 2.5)) < 1e-9
    assert together.pair_counts(d.limit(0), "g", "a", "b").count() == 0


def test_runs_are_merged_across_tasks(spark, monkeypatch):
    monkeypatch.setattr(together, "RUN", 50)
    d = spark.range(4000).select(F.lit("hot").alias("g"), F.lit(1).alias("a"), F.lit(2).alias("b"))
    assert [tuple(r) for r in together.pair_counts(d, "g", "a", "b").collect()] == [("hot", 1, 2, 4000)]


# packing --------------------------------------------------------------------


def test_best_fit_closes_the_fullest():
    p = packing.Packer(10, 2)
    assert [p.put(s)[0] for s in (6, 7, 3)] == [0, 1, 1]  # 3 fits bin 1 best
    assert p.put(5) == (2, None) and p.put(9) == (3, 0)  # the fullest open bin, 0 with 6, closes
    assert p.put(10)[0] == 4 and p.left_open() == {2: 5, 3: 1}


def test_packing_holds_every_token_once(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 5, 100, 1024, 1025, 5000])) for i in range(400)] + [(900, None), (None, 5), (901, -1), (902, 200_000)]
    d = spark.createDataFrame(rows, "doc_id long, size long").withColumn("bin", F.lit(0)).withColumn("piece_no", F.lit(0))
    got = packing.pack(d, "doc_id", "size", 1024).toPandas()
    assert (got.groupby("bin").piece_size.sum() <= 1024).all()
    sizes = {i: s for i, s in rows if i is not None and s is not None and s >= 0}
    assert got.groupby("doc_id").piece_size.sum().to_dict() == sizes
    assert (got.groupby("doc_id").size() == got.groupby("doc_id")["size"].first().map(lambda s: max(1, -(-s // 1024)))).all()
    assert packing.pack(d.limit(0), "doc_id", "size", 1024).count() == 0
    assert packing.fill_report(packing.pack(d.limit(0), "doc_id", "size", 1024), 1024).head().containers == 0


def test_tokens_follow_the_rule(spark):
    import re

    texts = ["", "Hello, world_2! ...", "naïve Ünï½ á — x y\x1cz\x85", "a" * 300_000 + " ,,, " * 50_000, "¬\n-\tあ中², #x"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, t string").select("i", packing.token_count(F.col("t")).alias("n"))
    assert {r.i: r.n for r in d.collect()} == {i: len(re.findall(r"\w+|[^\w\s]+", t)) for i, t in enumerate(texts)} | {99: None}


# mixing ---------------------------------------------------------------------


def test_sainte_lague_against_one_seat_at_a_time():
    rng = random.Random(4)
    for _ in range(60):
        w = [rng.choice([0, 1, 1, 2.5, 7]) for _ in range(6)]
        caps, seats = [rng.randrange(0, 30) for _ in w], rng.randrange(0, 80)
        want = [0] * 6
        for _ in range(min(seats, sum(c for c, x in zip(caps, w) if x > 0))):
            i = max((i for i in range(6) if want[i] < caps[i] and w[i] > 0), key=lambda i: (w[i] / (2 * want[i] + 1), -i))
            want[i] += 1
        assert mixing.sainte_lague(w, seats, caps) == want


def test_mix_reaches_its_targets(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice(["Big", " big ", "BIG", "big"]) if i % 3 else "mid", rng.randrange(50, 400)) for i in range(3000)]
    docs += [(5000 + i, "tiny", 100) for i in range(5)] + [(6000, None, 100), (6001, "other", 100), (6002, "mid", None), (6003, "mid", 0)]
    d = spark.createDataFrame(docs, "doc_id long, source string, size long").withColumn("s", F.lit(1)).withColumn("w", F.lit(1))
    t = spark.createDataFrame([("Big", 0.3, 2), ("mid", 0.5, 3), ("tiny", 0.1, 4), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    drawn, report = mixing.mix(d, t, "doc_id", "source", "size")
    r = {x.source: x for x in report.collect()}
    assert r["tiny"].capacity == 2000 < r["tiny"].wanted and r["none"].pages == 0 and r["none"].blocks == 0
    assert abs(r["Big"].reached_share / r["mid"].reached_share - 0.6) < 0.02 and abs(sum(x.reached_share for x in r.values()) - 1) < 1e-9
    most = {x.source: x.n for x in drawn.groupBy("source").agg(F.max("repeats").alias("n")).collect()}
    assert most["Big"] <= 2 and most["mid"] <= 3 and most["tiny"] <= 4 and drawn.groupBy("doc_id").count().where("count > 1").count() == 0
    empty, rep = mixing.mix(d.limit(0), t, "doc_id", "source", "size")
    assert empty.count() == 0 and {x.reached_share for x in rep.collect()} == {0.0}


def test_a_source_short_of_its_target_gives_all_its_tokens(spark):
    d = spark.createDataFrame([(i, "big", 100) for i in range(500)] + [(1000 + i, "tiny", 100) for i in range(4)] + [(2000 + i, "short", 100) for i in range(14)], "k long, source string, size long")
    goal = spark.createDataFrame([("big", 0.8, 2), ("tiny", 0.1, 2), ("short", 0.1, 2)], "source string, target_share double, max_repeats int")
    report = {r.source: r.drawn for r in mixing.mix(d, goal, "k", "source", "size")[1].collect()}
    assert report["tiny"] == 800 and report["short"] == 2800


# neighbours -----------------------------------------------------------------


def _brute(m, k, limit=None):
    there, z = (~np.isnan(m)).astype(float), np.nan_to_num(m)
    d = np.sqrt(np.maximum((z * z) @ there.T + there @ (z * z).T - 2 * z @ z.T, 0))
    np.fill_diagonal(d, np.inf)
    return {i: [int(j) for j in np.argsort(d[i], kind="stable")[:k] if limit is None or d[i, j] <= limit] for i in range(len(m))}


def test_packing_of_profiles_round_trip():
    m = np.array([[1.5, np.nan], [0.25, -0.0]], np.float32)
    assert np.array_equal(unpacked(packed(m), 2), m, equal_nan=True) and np.array_equal(unpacked(packed(m).slice(1), 2), m[1:])


def test_neighbours_recall_and_reach(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(scale=3, size=(5, 8)) + 8
    m = centres[rng.integers(5, size=3000)] + rng.normal(scale=0.3, size=(3000, 8))
    m[1500:1550] = m[:50] + rng.normal(scale=0.01, size=(50, 8))
    m[7, 2] = m[1500, 3] = np.nan
    m = m.astype(np.float32).astype(float)
    base = _profiles(spark, m, [(99_999, None), (99_998, [None] * 8)])
    near = _brute(m, 5)
    got: dict = {}
    for r in neighbours.nearest_neighbours(base, "cell_key", 8, 5, queries="cell_key % 10 = 0").collect():
        got.setdefault(r.cell_key, set()).add(r.neighbour)
    assert set(got) == set(range(0, 3000, 10))
    assert np.mean([len(got[i] & set(near[i])) / 5 for i in got]) >= 0.9
    found = {(r.cell_key, r.neighbour) for r in neighbours.nearest_neighbours(base, "cell_key", 8, 5, limit=0.1).collect()}
    want = {(i, j) for i, js in _brute(m, 5, 0.1).items() for j in js}
    assert len(want - found) <= 0.02 * len(want) and found <= want and (1, 1501) in found


def test_copies_are_each_others_neighbours(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(700, 4)) + 5
    m[:300] = m[0]  # a group of copies
    m[600] = m[601]
    base = _profiles(spark, m)
    got: dict = {}
    for r in neighbours.nearest_neighbours(base, "cell_key", 4, 3, limit=0.001).collect():
        got.setdefault(r.cell_key, []).append((r.distance, r.neighbour))
    assert sorted(got[0]) == [(0.0, 1), (0.0, 2), (0.0, 3)] and sorted(got[2]) == [(0.0, 0), (0.0, 1), (0.0, 3)] and sorted(got[299]) == [(0.0, 0), (0.0, 1), (0.0, 2)]
    assert got[600] == [(0.0, 601)] and set(got) == set(range(300)) | {600, 601}
    assert neighbours.nearest_neighbours(base.limit(0), "cell_key", 4, 3).count() == 0


def test_a_row_asked_for_has_its_nearest_though_its_least_copy_is_not_asked_for(spark):
    m = np.random.default_rng(8).normal(size=(300, 4)) + 5
    m[200] = m[57]
    got: dict = {}
    for r in neighbours.nearest_neighbours(_profiles(spark, m), "cell_key", 4, 5, queries="cell_key % 100 = 0").collect():
        got.setdefault(r.cell_key, []).append((r.distance, r.neighbour))
    d = np.sqrt(((m - m[200]) ** 2).sum(1))
    assert set(got) == {0, 100, 200} and {n for _, n in got[200]} == set(np.argsort(d, kind="stable")[:6]) - {200}


@pytest.mark.parametrize("spread, limit", [(0.05, None), (0.05, 0.2), (0.01, None), (0.01, 0.06)])
def test_the_nearest_in_a_dense_leaf_are_exact(spread, limit):
    rng = np.random.default_rng(9)
    m = rng.normal(size=(1200, 16)).astype(np.float32) + 3
    m[:400] = m[0] + spread * rng.normal(size=(400, 16))
    m[::50, 3] = np.nan
    index = neighbours.Index(m, len(m))
    own, keys = m[:600], np.arange(600)
    q, nb, d = (np.concatenate(c) for c in zip(*neighbours._best(index, index.leaf(m[1:2])[0], keys, own, own, keys, 5, limit)))
    diff = np.nan_to_num(own[:, None] - own[None])
    true = np.sqrt((diff.astype(np.float64) ** 2).sum(-1))
    true[keys, keys] = np.inf
    if limit is not None:
        true[true > limit] = np.inf
    want = {(i, j) for i in keys for j in np.argsort(true[i], kind="stable")[:5] if np.isfinite(true[i, j])}
    assert set(zip(q.tolist(), nb.tolist())) == want and np.allclose(d, true[q, nb])


# clusters -------------------------------------------------------------------


@pytest.mark.parametrize("n, leaf", [(6000, 256), (900, 1024)])
def test_descent_finds_most_neighbours(n, leaf):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 8)).astype(np.float32)
    idx, dist = descent.descend(x, leaf=leaf)
    d = ((x[:200, None] - x[None]) ** 2).sum(-1)
    d[np.arange(200), np.arange(200)] = np.inf
    true = np.argsort(d, axis=1)[:, : descent.LINKS]
    recall = np.mean([len(set(a) & set(b)) / descent.LINKS for a, b in zip(idx[:200], true)])
    assert recall > 0.93 and (n > leaf or recall == 1)
    assert (np.diff(dist, axis=1) >= 0).all() and np.allclose(dist[:200], np.take_along_axis(d, idx[:200].astype(int), 1), atol=1e-4)
    assert descent.descend(x[:1])[0].shape == (1, 0) and descent.descend(x[:0])[0].shape == (0, 0)
    same = descent.descend(np.zeros((500, 3), np.float32))
    assert same[0].shape == (500, descent.LINKS)


def test_rows_find_their_neighbours_across_cells():
    x = np.random.default_rng(11).normal(size=(20_000, 6)).astype(np.float32)
    cells = communities.Cells(x, len(x), 0)
    row, cell, home, hot = cells.dealt(x, np.arange(len(x)))
    assert len(cells.centres) > 1 and (np.bincount(row[home], minlength=len(x)) == 1).all() and (hot == -1).all() and len(row) < 4 * len(x)
    own = np.empty(len(x), int)
    own[row[home]] = cell[home]
    there = set(zip(row.tolist(), cell.tolist()))
    d = ((x[:300, None] - x[None]) ** 2).sum(-1)
    near = np.argsort(d, axis=1)[:, 1:9]
    assert np.mean([(j, own[i]) in there for i in range(300) for j in near[i]]) > 0.9


def test_visitors_are_met_one_cell_after_another(monkeypatch):
    x = np.random.default_rng(14).normal(size=(20_000, 6)).astype(np.float32)
    monkeypatch.setattr(communities, "CELL", 400)
    cells = communities.Cells(x, len(x), 0)
    row, cell, home, _ = cells.dealt(x, np.arange(len(x)))
    own = np.empty(len(x), int)
    own[row[home]] = cell[home]
    at = int(np.bincount(cell).argmax())
    mine, visitors = row[(cell == at) & home], row[(cell == at) & ~home]
    assert len(visitors) > 2 * len(mine)
    held = []
    monkeypatch.setattr(communities.descent, "descend", lambda x, f=communities.descent.descend: held.append(len(x)) or f(x))
    g = communities._Graph(x[mine])
    for other in np.unique(own[visitors]):
        there = np.sort(visitors[own[visitors] == other])
        there = np.r_[there, there[:1]]  # a copy counts once
        g.meet(x[there], there, cells.centres[at], cells.centres[other], cells.strip)
    assert held == [len(mine)]  # whatever the number of visitors
    d = ((x[mine, None] - x[None]) ** 2).sum(-1)
    d[np.arange(len(mine)), mine] = np.inf
    got = np.where(g.visits, g.ids, mine[np.where(g.visits, 0, g.ids)])
    assert np.allclose(g.dist, np.take_along_axis(d, got, 1), atol=1e-4) and all(len(set(r)) == descent.LINKS for r in got)
    true = np.argsort(d, axis=1)[:, : descent.LINKS]
    assert np.mean([len(set(a) & set(b)) / descent.LINKS for a, b in zip(got, true)]) > 0.9


def test_the_strip_along_borders_is_that_of_the_whole_table(spark):
    x = np.random.default_rng(15).normal(size=(6000, 3)).astype(np.float32) + 9
    x[5000] = x[0]  # a copy is no neighbour
    base = spark.createDataFrame(pd.DataFrame({"v": [r.tobytes() for r in x]}), "v binary").repartition(5)
    a, b = communities._neighbours(base, x[:40], x[:1], 3)
    d = ((x[:40, None] - x[None]) ** 2).sum(-1)
    d[d == 0] = np.inf
    at = np.argsort(d, axis=1)[:, : descent.LINKS]
    assert len(a) == 40 * descent.LINKS
    assert {(p.tobytes(), v.tobytes()) for p, v in zip(a, b)} == {(x[i].tobytes(), v.tobytes()) for i in range(40) for v in x[at[i]]}
    cells = communities.Cells(x[:1500], 6000 * 65_536, 0)  # a sample that is far thinner than the table
    wide = cells.strip
    cells.reach(x[np.repeat(np.arange(40), descent.LINKS)], x[at.reshape(-1)])
    assert 0 < cells.strip < wide and len(cells.dealt(x, np.arange(6000))[0]) >= 6000


@pytest.mark.parametrize("cell", [65_536, 300])
def test_clusters_are_the_natural_groups(spark, monkeypatch, cell):
    monkeypatch.setattr(communities, "CELL", cell)
    rng = np.random.default_rng(9)
    centres = np.array([[0, 0, 0, 0], [6, 0, 0, 0], [0, 6, 0, 0], [0, 0, 6, 6]]) + 5
    label = rng.choice(4, 2400, p=[0.5, 0.3, 0.15, 0.05])
    m = centres[label] + rng.normal(scale=0.3, size=(2400, 4))
    m[5, 3] = np.nan  # told apart by the others
    base = _profiles(spark, m)
    got = communities.similarity_clusters(base, "cell_key", 4, "also", typical=True).toPandas().set_index("cell_key").loc[range(2400)]
    size = np.bincount(label)
    names = {i: got.cluster[label == i].mode()[0] for i in range(4)}
    assert [names[i] for i in np.argsort(-size)] == [0, 1, 2, 3] and len(set(names.values())) == 4
    right = got.cluster.to_numpy() == np.array([names[i] for i in label])
    assert right.mean() > 0.97  # stragglers may stay apart, but no cluster mixes groups
    assert all(len(set(label[got.cluster.to_numpy() == c])) == 1 for c in set(got.cluster) - {-1})
    near = ((m - centres[label]) ** 2).sum(1)
    assert np.nanmean(near[got.degree.to_numpy().argsort()[-100:]]) < np.nanmean(near)


def test_a_small_group_beside_large_ones_stays_apart(spark):
    rng = np.random.default_rng(12)
    label = rng.choice(3, 6000, p=[0.7, 0.29, 0.01])
    m = np.array([[0, 0, 0, 0], [3, 0, 0, 0], [0, 3, 0, 0]])[label] + 5 + rng.normal(scale=0.3, size=(6000, 4))
    m[:40] = np.linspace([5, 5.9, 5, 5], [5, 7.1, 5, 5], 40)  # rows between the first and the small group
    got = communities.similarity_clusters(_profiles(spark, m), "cell_key", 4, "also").toPandas().set_index("cell_key").loc[range(6000)]
    ours = got.cluster.to_numpy()
    names = [pd.Series(ours[40:][label[40:] == i]).mode()[0] for i in range(3)]
    assert len(set(names)) == 3 and (ours[40:] == np.array(names)[label[40:]]).mean() > 0.99


def test_large_contracted_graphs_shrink_in_parallel(spark, monkeypatch):
    monkeypatch.setattr(communities, "CELL", 100)
    monkeypatch.setattr(communities, "LINKS_ON_DRIVER", 20)
    rng = np.random.default_rng(10)
    label = np.arange(1500) % 3
    m = np.array([[0, 0, 0], [8, 0, 0], [0, 8, 0]])[label] + 5 + rng.normal(scale=0.3, size=(1500, 3))
    got = communities.similarity_clusters(_profiles(spark, m), "cell_key", 3, "also").toPandas().set_index("cell_key").loc[range(1500)]
    # cells as small as these may leave a group in parts, but never mix groups
    kept = got[got.cluster >= 0]
    assert len(kept) > 0.97 * len(got) and all(len(set(c.index % 3)) == 1 for _, c in kept.groupby("cluster")) and kept.cluster.nunique() <= 8


def test_clusters_of_copies_and_of_nothing(spark, monkeypatch):
    base = _profiles(spark, np.full((60, 3), 2.0))
    assert {r.cluster for r in communities.similarity_clusters(base, "cell_key", 3, "also").collect()} == {0}
    assert communities.similarity_clusters(base.limit(0), "cell_key", 3, "also", typical=True).count() == 0
    monkeypatch.setattr(communities, "CELL", 200)
    m = np.random.default_rng(13).normal(scale=0.2, size=(1800, 3)) + 4
    m[900:] += 5
    m[:600] = m[0]  # a third of all rows is one vector: dealt by hash, yet one cluster
    got = communities.similarity_clusters(_profiles(spark, m), "cell_key", 3, "also", typical=True).toPandas().set_index("cell_key").loc[range(1800)]
    assert len(got) == 1800 and got.cluster[:600].nunique() == 1 and got.cluster[900:].nunique() == 1
    assert got.cluster[0] != got.cluster[900]


def test_communities_are_joined_by_their_share_of_links():
    ring = [(i, (i + 1) % 8, 1.0) for i in range(8)] + [(i, (i + 2) % 8, 1.0) for i in range(8)]
    links = [(a, b, 0.5, 1) for a, b, _ in ring] + [(a + 8, b + 8, 0.5, 1) for a, b, _ in ring] + [(0, 8, 0.25, 1)]
    a, b, w, c = (np.array(v) for v in zip(*links))
    cut = np.arange(16) // 4  # each ring cut in two; between the rings one link, three times as long
    got = communities.joined(a, b, w, c, cut)
    assert len(set(got[:8])) == len(set(got[8:])) == 1 and got[0] != got[8]
    assert communities.joined(a, b, w, c, cut, stretch=9.0).tolist() == [0] * 16
    assert communities.joined(a, b, w, c, cut, share=1.1).tolist() == cut.tolist()
    assert communities.joined(a[:0], b[:0], w[:0], c[:0], np.arange(3)).tolist() == [0, 1, 2]


# abuse ----------------------------------------------------------------------


def _texts(n, seed):
    rng = random.Random(seed)
    who = ["the mayor", "miss adler", "the miller", "old tom", "the baker"]
    plain = ["%s opened the fair", "%s sold nine lots of wool", "%s praised the choir", "rats and vermin were seen by %s", "%s condemned hatred of strangers", "%s kept a quiet dog"]
    bad = ["you filthy swine, %s, drop dead", "hang %s and burn the vermin folk", "%s is a worthless rotten bastard"]
    out = []
    for _ in range(n):
        s = [rng.choice(plain) % rng.choice(who) for _ in range(12)]
        y = rng.random() < 0.2
        if y:
            s[rng.randrange(12)] = rng.choice(bad) % rng.choice(who)
        out.append((". ".join(s) + ".", float(y)))
    return out


def test_scores_find_pages_and_sentences():
    train = [(t, y if random.Random(i).random() > 0.03 else 1 - y) for i, (t, y) in enumerate(_texts(900, 1))]
    model, test = abuse.fit(train), _texts(300, 2)
    said = [model.documents([t])[2][0] >= model.flag for t, _ in test]
    hit = sum(s and y for s, (_, y) in zip(said, test))
    assert hit / max(1, sum(said)) > 0.9 and hit / sum(y for _, y in test) > 0.9
    for t, y in test[:60]:
        if y:
            worst = " ".join(abuse.sentences(t)[int(np.argmax(model.sentence_scores(t)))])
            assert any(w in worst for w in ("swine", "hang", "bastard"))


def test_texts_together_score_as_each_alone():
    model, texts = abuse.fit(_texts(300, 4)), [t for t, _ in _texts(20, 5)] + ["", "...", "one. one. drop dead. drop dead"]
    score, worst, top = model.documents(texts)
    for i, t in enumerate(texts):
        z = model.sentence_scores(t)
        assert np.isclose(score[i], abuse.document_score(z)) and worst[i] == (int(np.argmax(z)) + 1 if z else 0)
        assert np.isclose(top[i], 1 / (1 + np.exp(-max(z))) if z else 0.0)


def test_the_threshold_allows_for_slips():
    y = np.r_[np.ones(192), np.zeros(8), np.zeros(1920), np.ones(80)]  # 4 % of the labels wrong
    top = np.r_[np.full(200, 0.5), np.full(2000, 0.01)]
    assert 0.01 < abuse._threshold(top, y) <= 0.5
    top[200:400] = 0.2
    assert 0.2 < abuse._threshold(top, y) <= 0.5


def test_reading_of_damaged_text():
    assert abuse.sentences("A filt-\nhy s w i n e. Next;\n\n...") == [["a", "filthy", "swine"], ["next"]]
    long = "ab" * 50_000
    words = abuse.Words(abuse.Counter({"stupid": 5, "bastard": 4, "a": 3, "": 9, long: 2}))
    assert words.read("stupld,") == words.read("stup1d") == words.read("stupid") >= 0
    assert words.read("b*st**d") == words.read("bastard") and words.read("zebra") == -1 and words.read("") == -1
    assert words.read(long) == words.read("x" + long[1:]) >= 0 and words.read("xy" + long[2:]) == words.read(long + "a") == -1


def test_scoring_edge_cases(spark):
    model = abuse.fit(_texts(400, 3))
    d = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 400_000), (4, "you filthy swine, old tom, drop dead.")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in abuse.scored(d, model, "doc_id", "text").collect()}
    assert got[1].score == got[2].score == 0.0 and got[1].sentence == 0 and got[4].flagged and got[4].sentence == 1 and not got[3].flagged and not got[1].flagged
    rows = spark.createDataFrame([(4, 1), (4, 1), (4, 0), (1, None), (None, 1)], "doc_id long, toxic int").withColumn("label", F.lit(9))
    assert [tuple(r) for r in abuse.labels(rows, "doc_id", "toxic").collect()] == [(4, 0.5)]
    none = abuse.fitted(d, rows.limit(0), "doc_id", "text", "toxic")
    assert none.sentence_scores("any text") == [-5.0] and none.flag == abuse.FLAG
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(_texts(50, 6))], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    assert len(abuse.fitted(d, marks, "doc_id", "text", "toxic", text_bytes=2000).weight) < len(abuse.fitted(d, marks, "doc_id", "text", "toxic").weight)
