"""Graphs, kernels, indices and statistics: invariants, closed forms, planted truth."""

from __future__ import annotations

import inspect
import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netpanel.operators import clustering, graphs, indices, kernels, panel, stats, vectors


def cliques(spark, k, n):
    edges = [(c * n + a, c * n + b, 1.0) for c in range(k) for a in range(n) for b in range(a + 1, n)]
    return spark.createDataFrame(edges, "i long, j long, w double"), spark.createDataFrame([(v, v // n) for v in range(k * n)], "entity long, label int")


@pytest.mark.parametrize("k", [2, 3, 5])
def test_isolated_cliques_have_closed_forms(spark, k):
    r = indices.graph_indices(*cliques(spark, k, 4)).first()
    assert (r.AVI, r.AVU, r.ANUI) == (1, 0, 1) and math.isclose(r.Q, 1 - 1 / k) and math.isclose(r.TurboMQ, k) and math.isclose(r.MQ_basic, 1)


@pytest.mark.parametrize("k,value", [(2, 1), (3, 2 / 3)])
def test_avu_of_few_clusters_is_constant(spark, k, value):
    r = np.random.default_rng(k)
    edges = spark.createDataFrame([(i, j, float(r.random())) for i in range(12) for j in range(i + 1, 12)], "i long, j long, w double")
    labels = spark.createDataFrame([(v, v % k) for v in range(12)], "entity long, label int")
    assert math.isclose(indices.graph_indices(edges, labels).first().AVU, value)


def test_mutual_and_union(spark):
    directed = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.7), (1, 3, 0.9)], "i long, j long, w double")
    assert [tuple(r) for r in graphs.undirected(directed, True).collect()] == [(1, 2, 0.5)]
    assert sorted(tuple(r) for r in graphs.undirected(directed, False).collect()) == [(1, 2, 0.7), (1, 3, 0.9)]


def test_layers_are_canonical(spark):
    r = np.random.default_rng(2)
    points = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(r.normal(size=(60, 4)))] + [(60, [9.0] * 4), (61, [9.0] * 4)], "entity long, x array<double>")
    for tree in (False, True):
        rows = graphs.behaviour_layer(points, 5, 3, add_mst=tree).collect()
        assert all(x.i < x.j and 0 < x.w <= 1 for x in rows) and len({(x.i, x.j) for x in rows}) == len(rows)
    nodes = points.select("entity")
    assert graphs.components(graphs.behaviour_layer(points, 5, 3, add_mst=True), nodes).select("component").distinct().count() == 1


def test_neighbours_in_blocks_equal_brute_force(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(90, 3)).round(1)
    points = spark.createDataFrame([(k % 2, k, [float(v) for v in row]) for k, row in enumerate(x)], "period long, entity long, x array<double>")
    got = {}
    for q in vectors.neighbours(points, 4, ["period"], block=13).collect():
        got.setdefault(q.i, {})[q["rank"]] = q.j
    for i in range(90):
        order = sorted((round(float(np.sqrt(((x[i] - x[j]) ** 2).sum())), 12), j) for j in range(90) if j != i and j % 2 == i % 2)[:4]
        assert [got[i][k] for k in (1, 2, 3, 4)] == [j for _, j in order]


def test_edge_jaccard(spark):
    a = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "i long, j long, w double")
    b = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)], "i long, j long, w double")
    none = a.limit(0)
    assert [graphs.edge_jaccard(x, y).first().jaccard for x, y in ((a, a), (a, none), (a, b), (none, none))] == [1, 0, 2 / 3, 1]


def test_small_clusters_join_the_nearest(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (2, 3, 0.1), (0, 2, 1.0)], "i long, j long, w double")
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 7), (3, 1), (4, 1), (5, 1)], "entity long, label int")
    found = {r.entity: r.label for r in graphs.merged_small(edges, labels, 2).collect()}
    assert [found[k] for k in range(6)] == [0, 0, 0, 1, 1, 1]


@pytest.fixture(scope="module")
def planted():
    r = np.random.default_rng(0)
    n, labels = 60, np.repeat(np.arange(4), 60)
    x = 3 * r.normal(size=(4, 5))[labels] + r.normal(size=(4 * n, 5))
    a = np.triu(r.random((4 * n, 4 * n)) < np.where(labels[:, None] == labels, 0.3, 0.02), 1).astype(float)
    return x, a + a.T, labels


@pytest.mark.parametrize("method", sorted(kernels.METHODS))
def test_methods_recover_planted_clusters(planted, method):
    x, a, labels = planted
    found = kernels.METHODS[method](x, a, 4, np.random.default_rng(1))
    assert kernels.adjusted_rand(found, labels) > 0.8 and len(set(found)) == 4
    assert (found == kernels.METHODS[method](x, a, 4, np.random.default_rng(1))).all()


def test_temporal_communities(planted):
    _, a, labels = planted
    found = kernels.temporal_leiden([a, a, a], 4, np.random.default_rng(1))
    assert kernels.adjusted_rand(found.ravel(), np.tile(labels, 3)) > 0.95


@pytest.mark.parametrize("metric,balanced", [("euclidean", False), ("euclidean", True), ("cosine", False)])
def test_joint_objective(planted, metric, balanced):
    x, a, labels = planted
    found = kernels.joint_kmeans(x, a, 4, np.random.default_rng(2), metric=metric, balanced=balanced)
    assert kernels.adjusted_rand(found.labels, labels) > 0.8
    if metric == "euclidean":
        assert all(b <= a + 1e-9 for a, b in zip(found.history, found.history[1:], strict=False))


def test_comovement_finds_blocks():
    r = np.random.default_rng(0)
    g = np.repeat(r.normal(size=(24, 3)), 40, axis=1) + 0.5 * r.normal(size=(24, 120))
    w = kernels.comovement(g, 10, (0, 1))
    inside = sum(w[k : k + 40, k : k + 40].sum() for k in (0, 40, 80))
    assert inside > 0.99 * w.sum() and (w == w.T).all() and w.max() <= 1
    assert not kernels.comovement(g[:2], 10, (0, 1)).any()


def growth_rows(spark, g):
    """Windows of 12 periods of the growth g (times x entities); missing values have no row."""
    rows = [(e, p, float(v)) for p, line in enumerate(g) for e, v in enumerate(line) if np.isfinite(v)]
    return panel.growth_window(spark.createDataFrame(rows, "entity long, period long, growth double").repartition(7), 12, 3)


def gappy_growth(n=90):
    r = np.random.default_rng(4)
    g = r.normal(size=(16, 3)) @ r.normal(size=(3, n)) + r.normal(size=(16, n))
    g[r.random(g.shape) < 0.1] = np.nan
    return g


def test_shrinkage_sums_over_parts_of_the_entities(spark):
    g = gappy_growth()
    z = kernels.standardised(g)
    parts = [z[:, s : s + 25] for s in range(0, 90, 25)]
    assert math.isclose(kernels.shrinkage_of_gram(sum(p @ p.T for p in parts), 90), kernels.shrinkage(z))
    found = {(r.t, r.lag): r.delta for r in clustering.comovement_shrinkage(growth_rows(spark, g)).collect()}
    wanted = {(t, lag): d for t in range(2, 16) for lag, (_, d) in kernels.lagged_correlations(g[max(0, t - 11) : t + 1], (0, 1)).items()}
    assert found.keys() == wanted.keys() and all(math.isclose(found[x], wanted[x], abs_tol=1e-9) for x in wanted)


def test_comovement_by_blocks_is_the_dense_one(spark):
    g = gappy_growth()
    found = {(r.t, r.i, r.j): r.w for r in clustering.comovement_layer(growth_rows(spark, g), 4, (0, 1), block=20).collect()}
    wanted = {}
    for t in range(2, 16):
        w = kernels.comovement(g[max(0, t - 11) : t + 1], 4, (0, 1))
        wanted |= {(t, i, j): w[i, j] for i, j in zip(*np.nonzero(np.triu(w, 1)), strict=True)}
    assert found.keys() == wanted.keys() and all(math.isclose(found[x], wanted[x], abs_tol=1e-9) for x in wanted)


def test_comovement_holds_strips_of_the_correlation():
    g = np.random.default_rng(5).normal(size=(4000, 12))
    rows, ids = kernels.correlation_rows(g, {0: (0.2, 1.0), 1: (0.3, 1.0)}), np.arange(4000)
    tracemalloc.start()
    i, j, w = kernels.strongest_comovement(ids, rows, ids, rows, 8, width=1000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    dense = np.maximum(rows[0][0] @ rows[0][0].T, np.maximum(rows[1][0] @ rows[1][1].T, rows[1][1] @ rows[1][0].T))
    np.fill_diagonal(dense, 0)
    order = np.argsort(-dense, axis=1, kind="stable")[:, :8]
    assert (j.reshape(-1, 8) == order).all() and np.allclose(w.reshape(-1, 8), np.take_along_axis(dense, order, 1)) and peak < 8 * 4000 * 4000 / 4


@pytest.mark.parametrize("k,block", [(3, 5), (5, 7), (4, 10_000)])
def test_gravity_on_a_line_is_that_of_all_pairs(spark, k, block):
    r = np.random.default_rng(k)
    values = [*np.repeat(3.25, 12), *r.integers(0, 30, 60) / 4, *r.normal(size=40), -7.0]  # copies, ties on both sides, a lonely one
    places = spark.createDataFrame([(int(e), float(v)) for e, v in zip(r.permutation(len(values)), values, strict=True)], "entity long, value double")
    a, b = places.toDF("i", "x"), places.toDF("j", "y")
    pairs = a.join(b, F.col("i") < F.col("j")).select("i", "j", (F.abs(F.col("x") - F.col("y")) / 2).alias("km"))
    found, wanted = ({(e.i, e.j): e.w for e in rows.collect()} for rows in (graphs.gravity_line(places, k, 3.0, 2.0, block), graphs.gravity_layer(pairs, k, 3.0)))
    assert found == wanted


@pytest.mark.parametrize("k,zero,block", [(3, 1.5, 5), (6, 0.2, 7), (4, 50.0, 10_000)])
def test_gravity_on_a_line_puts_equal_places_apart(spark, k, zero, block):
    r = np.random.default_rng(k)
    values = [*np.repeat(3.25, 12), *r.integers(0, 30, 60) / 4, *np.repeat(r.normal(size=20), 2), -7.0, -7.0]
    places = spark.createDataFrame([(int(e), float(v)) for e, v in zip(r.permutation(len(values)), values, strict=True)], "entity long, value double")
    a, b = places.toDF("i", "x"), places.toDF("j", "y")
    pairs = a.join(b, F.col("i") < F.col("j")).withColumn("km", F.abs(F.col("x") - F.col("y")) / 2).withColumn("km", F.when(F.col("km") > 0, F.col("km")).otherwise(zero))
    found, wanted = ({(e.i, e.j): e.w for e in rows.collect()} for rows in (graphs.gravity_line(places, k, 3.0, 2.0, block, zero), graphs.gravity_layer(pairs, k, 3.0)))
    assert found == wanted


def test_the_study_needs_no_pairs_of_places(spark, sf_dir, monkeypatch):
    from netpanel.plans import graph_queries, serving_queries, stages

    def pairs(*_):
        raise AssertionError("all pairs of suppliers")

    class Built(Exception):
        pass

    def layers(features, distances, config, places=None, per_km=1.0):
        assert distances is None and places.columns == ["entity", "value"]
        raise Built

    monkeypatch.setattr(graph_queries, "distances", pairs)
    monkeypatch.setattr(stages, "build_layers", layers)
    monkeypatch.setattr(serving_queries, "kept", lambda df: df)
    with pytest.raises(Built):
        serving_queries.panel_study(spark, sf_dir)


@pytest.mark.parametrize("name", ["rayleigh", "edge_jaccard"])
def test_places_on_a_line_need_no_pairs(spark, sf_dir, monkeypatch, name):
    from netpanel.plans import graph_queries

    monkeypatch.setattr(graph_queries, "distances", None)
    assert graph_queries.QUERIES[name][0](spark, sf_dir).count() == 1


def test_joint_clusters_of_links_are_those_of_the_matrix_in_little_memory(planted):
    x, a, _ = planted
    found = [kernels.joint_kmeans(x, g, 4, np.random.default_rng(3), balanced=True) for g in (a, kernels.Links.of(a))]
    p = kernels.modularity_matrix(a)
    z = kernels._Joined(x, kernels.Links.of(a))
    assert (found[0].labels == found[1].labels).all() and np.allclose(z[list(range(len(x)))][:, x.shape[1] :], p) and np.allclose(z.squares(), (p**2).sum(1))
    r, n = np.random.default_rng(6), 20_000  # a matrix of them has 3.2 GB
    ring = kernels.Links(n, np.arange(n - 1), np.arange(1, n), np.ones(n - 1))
    tracemalloc.start()
    kernels.joint_kmeans(r.normal(size=(n, 3)), ring, 3, r, n_init=1, rounds=5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2e8


def test_nearest_by_strips_is_brute_force():
    r = np.random.default_rng(7)
    x = np.concatenate([r.integers(0, 4, (300, 3)) / 2, r.normal(size=(200, 3)) + 1e6, np.zeros((40, 3))])
    ids = r.permutation(len(x)) * 3
    order = np.argsort(ids)
    i, j, d = kernels.nearest(ids, x, ids[order], x[order], 6, height=50, width=100)
    every = np.sqrt(((x[:, None] - x[order][None]) ** 2).sum(-1))
    every[ids[:, None] == ids[order]] = np.inf
    wanted = np.stack([np.lexsort((ids[order], row))[:6] for row in every])
    assert (i.reshape(-1, 6) == ids[:, None]).all() and (j.reshape(-1, 6) == ids[order][wanted]).all() and (d.reshape(-1, 6) == np.take_along_axis(every, wanted, 1)).all()


def test_subsamples_of_links_are_those_of_the_matrix(planted):
    _, a, _ = planted
    chosen = np.sort(np.random.default_rng(8).choice(len(a), len(a) // 2, replace=False))
    part = kernels.Links.of(a).among(chosen)
    assert (part.dense() == a[np.ix_(chosen, chosen)]).all() and np.allclose(part.degrees(), part.dense().sum(1)) and kernels.METHODS["kefrin_balanced"] in kernels.LINKS


def test_stability_without_a_graph_makes_none(spark):
    r = np.random.default_rng(9)
    points = spark.createDataFrame([(1, e, [float(v) for v in r.normal(size=2) + 9 * (e % 2)]) for e in range(60)], "period long, entity long, x array<double>")
    pairs, _ = stats.stability(points, None, lambda x, a, k, rng: kernels.kmeans(x, k, rng, 2) if isinstance(a, kernels.Links) else 1 / 0, 2, 3, links=True)
    assert {q.ari for q in pairs.collect()} == {1.0}


def test_replicates_share_edges_and_sizes(spark):
    r = np.random.default_rng(10)
    edges = spark.createDataFrame([(i, j, float(r.random())) for i in range(30) for j in range(i + 1, 30) if r.random() < 0.3], "i long, j long, w double")
    labels = spark.createDataFrame([(v, v % 4) for v in range(30)], "entity long, label int")
    every = edges.join(labels.toDF("i", "a"), "i").join(labels.toDF("j", "b"), "j").select(F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("rep"), "a", "b", "w")
    found = {(q.rep, q.metric): q.value for q in stats._by_replicate(every, labels, 2, ["AVI", "AVU", "Q"]).collect()}
    wanted = indices.graph_indices(edges, labels).first()
    assert len(found) == 6 and all(math.isclose(v, wanted[m]) for (_, m), v in found.items())
    own, other = (stats.permuted(labels, 20).toDF("rep", end, name) for end, name in (("i", "a"), ("j", "b")))
    plain = stats._by_replicate(edges.join(own, "i").join(other, ["rep", "j"]), labels, 20, ["Q"]).agg(F.avg("value")).first()[0]
    assert math.isclose({q.metric: q["mean"] for q in stats.permutation_null(edges, labels, 20).collect()}["Q"], plain)


def test_ward_leaves_out_what_is_gone():
    """Against the sums of squares that each merge adds, over all pairs of clusters."""
    x = np.random.default_rng(11).normal(size=(300, 3))
    groups = [[v] for v in range(300)]
    centres, sizes = x.copy(), np.ones(300)
    while len(groups) > 5:
        cost = kernels.squared_distances(centres) * (sizes[:, None] * sizes) / (sizes[:, None] + sizes)
        np.fill_diagonal(cost, np.inf)
        a, b = sorted(np.unravel_index(cost.argmin(), cost.shape))
        groups[a] += groups.pop(b)
        centres, sizes = np.delete(centres, b, 0), np.delete(sizes, b)
        centres[a], sizes[a] = x[groups[a]].mean(0), len(groups[a])
    wanted = np.zeros(300, int)
    for c, members in enumerate(groups):
        wanted[members] = c
    assert kernels.adjusted_rand(kernels.ward(x, 5), wanted) == 1


@pytest.mark.parametrize("links,count", [([(0, 1), (1, 2), (4, 3), (4, 5)], 6), ([(0, 1), (1, 2), (4, 3), (4, 5)], 2), ([(k, k + 1) for k in range(7)], 5), ([], 3)])
def test_spectrum_by_components(spark, links, count):
    edges = spark.createDataFrame([(i, j, 0.5 + k) for k, (i, j) in enumerate(links)], "i long, j long, w double")
    a = np.zeros((8, 8))
    for k, (i, j) in enumerate(links):
        a[i, j] = a[j, i] = 0.5 + k
    found = sorted((r.place, r.eigenvalue) for r in graphs.spectrum(edges, spark.range(8).toDF("entity"), count).collect())
    assert [p for p, _ in found] == list(range(count)) and np.allclose([v for _, v in found], kernels.laplacian_spectrum(a)[:count], atol=1e-9)


def test_many_components_need_no_matrix(spark):
    edges = spark.range(100_000).filter("id % 10 < 4").selectExpr("id AS i", "id + 1 AS j", "1.0D AS w")  # a matrix of all nodes has 80 GB
    assert [r.eigenvalue for r in graphs.spectrum(edges, spark.range(100_000).toDF("entity"), 4).collect()] == [0.0] * 4


def test_fusion(planted):
    x, a, _ = planted
    w = kernels.fused([np.exp(-kernels.squared_distances(x)), a, np.zeros_like(a)], 10, 5)
    assert np.allclose(w, w.T) and math.isclose(w.max(), 1) and not np.diag(w).any() and kernels._parts(w) == 1


def plain_fusion(layers, k, rounds, alpha=0.5):
    """The mean of all layers' kernels after as many rounds, by matrices of all nodes."""
    n = len(layers[0])

    def full(w):
        w = w - np.diag(np.diag(w))
        rows = w.sum(1, keepdims=True)
        return np.divide(w, rows, out=np.zeros_like(w), where=rows > 0) * (1 - alpha) + np.diag(np.where(rows[:, 0] > 0, alpha, 1.0))

    def local(w):
        s = np.zeros_like(w)
        order = np.argsort(-w, axis=1, kind="stable")[:, :k]
        np.put_along_axis(s, order, np.take_along_axis(w, order, 1), 1)
        s += np.eye(n)
        return s / s.sum(1, keepdims=True)

    p, s = [full(w) for w in layers], [local(w) for w in layers]
    for _ in range(rounds):
        new = [s[v] @ ((sum(p) - p[v]) / (len(p) - 1)) @ s[v].T for v in range(len(p))]
        p = [full((q + q.T) / 2) for q in new]
    return sum(p) / len(p)


@pytest.mark.parametrize("count,threads,small", [(2, 1, 512), (2, 3, 8), (3, 2, 8), (3, 1, 512)])
def test_fusion_in_place_is_that_of_whole_matrices(count, threads, small):
    r = np.random.default_rng(count)
    layers = []
    for _ in range(count):  # three parts without links between them, and two nodes without any
        a = np.triu(np.where(r.random((200, 200)) < 0.05, r.random((200, 200)), 0), 1)
        part = np.repeat([0, 1, 2, 3, 4], [120, 70, 8, 1, 1])
        a[part[:, None] != part] = 0
        layers.append(a + a.T)
    f = plain_fusion(layers, 5, 6)
    f = (f + f.T) / 2
    np.fill_diagonal(f, 0)
    wanted = kernels.strongest(f, 5, True)
    i, j = kernels.maximum_spanning_edges(f)
    wanted[i, j] = wanted[j, i] = f[i, j]
    links = kernels.fused_links([kernels.Links.of(a) for a in layers], 5, 6, threads=threads, small=small)
    assert np.allclose(links.dense(), wanted / wanted.max(), rtol=1e-9, atol=1e-12)


def test_fusion_of_many_components_needs_no_matrix_of_all():
    i, j = np.triu_indices(10, 1)
    i, j = (np.concatenate([v + 10 * c for c in range(500)]) for v in (i, j))  # a matrix of all nodes has 200 MB
    r = np.random.default_rng(0)
    layers = [kernels.Links(5000, i, j, r.random(len(i))) for _ in range(2)]
    tracemalloc.start()
    found = kernels.fused_links(layers, 4, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6 and len(np.unique(kernels.parts_of(5000, found.i, found.j))) == 500


def one_component(n, count):
    """Layers in which every node has a link to the next one and to three others."""
    r, layers = np.random.default_rng(count), []
    for _ in range(count):
        pairs = np.concatenate([np.stack([np.arange(n - 1), np.arange(1, n)], 1), np.sort(r.integers(0, n, (3 * n, 2)), 1)])
        i, j = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0).T
        layers.append(kernels.Links(n, i, j, r.random(len(i)) + 0.01))
    return layers


@pytest.mark.parametrize("n,count,threads,room", [(700, 2, 2, None), (512, 3, 1, 0), (600, 3, 2, 4_000_000), (513, 2, 3, 0)])
def test_fusion_by_blocks_is_that_of_whole_matrices(monkeypatch, n, count, threads, room):
    monkeypatch.setattr(kernels, "PRODUCT", 1)  # a block of rows at a time
    if room is not None:
        monkeypatch.setattr(kernels, "ROOM", room)
    layers = one_component(n, count)
    f = plain_fusion([w.dense() for w in layers], 5, 4)
    f = (f + f.T) / 2
    np.fill_diagonal(f, 0)
    wanted = kernels.strongest(f, 5, True)
    i, j = kernels.maximum_spanning_edges(f)
    wanted[i, j] = wanted[j, i] = f[i, j]
    assert np.allclose(kernels.fused_links(layers, 5, 4, threads=threads).dense(), wanted / wanted.max(), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("room,most", [(10**9, 3), (0, 0.6)])
def test_fusion_holds_half_matrices_or_scratch_files(monkeypatch, room, most):
    monkeypatch.setattr(kernels, "PRODUCT", 1, raising=False)
    monkeypatch.setattr(kernels, "ROOM", room, raising=False)
    layers = one_component(2000, 3)
    tracemalloc.start()
    kernels.fused_links(layers, 5, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < most * 8 * 2000**2  # whole matrices of three layers and their sum: 4


def test_spectrum_counts_components():
    a = np.zeros((6, 6))
    for i, j in ((0, 1), (1, 2), (3, 4), (4, 5)):
        a[i, j] = a[j, i] = 1
    assert (kernels.laplacian_spectrum(a) < 1e-9).sum() == 2


def test_rewiring_keeps_degrees(planted):
    _, a, _ = planted
    i, j = np.nonzero(np.triu(a, 1))
    x, y, w = kernels.rewired(i, j, np.arange(len(i), dtype=float), np.random.default_rng(1), 3)
    assert (np.bincount(np.r_[i, j]) == np.bincount(np.r_[x, y], minlength=len(a))).all()
    assert len(set(zip(x, y, strict=True))) == len(i) and sorted(w) == list(range(len(i)))


def test_grid_and_registry(spark, planted):
    x, a, labels = planted
    points = spark.createDataFrame([(t, k, [float(v) for v in row]) for t in (1, 2) for k, row in enumerate(x)], "period long, entity long, x array<double>")
    i, j = np.nonzero(np.triu(a, 1))
    edges = spark.createDataFrame([(t, int(p), int(q), 1.0) for t in (1, 2) for p, q in zip(i, j, strict=True)], "period long, i long, j long, w double")
    clustering.register("parity", lambda x, a, k, rng: np.arange(len(x)) % k)
    try:
        rows = clustering.grid(points, edges, ["leiden", "kefrin", "parity"], [4]).toPandas()
    finally:
        del kernels.METHODS["parity"]
    for (_, method), group in rows.sort_values("entity").groupby(["period", "method"]):
        assert len(group) == 240 and (method == "parity" or kernels.adjusted_rand(group["label"].to_numpy(), labels) > 0.8)


def test_bootstrap_membership_is_sure_of_clear_clusters(spark, planted):
    x, _, labels = planted
    points = spark.createDataFrame([(1, k, [float(v) for v in row]) for k, row in enumerate(x)], "period long, entity long, x array<double>")
    own = spark.createDataFrame([(1, k, int(v)) for k, v in enumerate(labels)], "period long, entity long, label int")
    found = clustering.bootstrap_membership(points, None, own, "kmeans", 6)
    assert clustering.confidence_summary(clustering.confidence(found)).first().share_sure > 0.9
    assert found.agg(F.max("probability")).first()[0] <= 1
    assert found.groupBy("entity").count().agg(F.min("count"), F.max("count")).first() == (len(set(labels)),) * 2  # every label's probability


@pytest.mark.parametrize("method", ["leiden", "kefrin"])
def test_bootstrap_and_stability_use_the_graph(spark, planted, method):
    """Blocks that only the graph shows: the points say nothing."""
    from netpanel.operators import kernels

    _, a, labels = planted
    noise = np.random.default_rng(2).normal(size=(len(labels), 2)) * 1e-3
    points = spark.createDataFrame([(1, k, [float(v) for v in row]) for k, row in enumerate(noise)], "period long, entity long, x array<double>")
    own = spark.createDataFrame([(1, k, int(v)) for k, v in enumerate(labels)], "period long, entity long, label int")
    i, j = np.nonzero(np.triu(a, 1))
    edges = spark.createDataFrame([(1, int(p), int(q), 1.0) for p, q in zip(i, j, strict=True)], "period long, i long, j long, w double")
    found = clustering.confidence(clustering.bootstrap_membership(points, edges, own, method, 6, 0.9))
    assert clustering.confidence_summary(found, 0.7).first().share_own > 0.85
    pairs, clusters = stats.stability(points, edges, kernels.METHODS[method], len(set(labels)), 4, 0.9)
    summary = stats.stability_summary(pairs, clusters).first()
    assert summary.ari_median > 0.8 and summary.jaccard_worst > 0.7 and pairs.count() == 6


def test_panel_of_metrics_against_chance(spark, planted):
    from netpanel.operators import indices

    x, a, labels = planted
    rows = [(p, k, [float(v) for v in row], int(v)) for p in (1, 2) for k, (row, v) in enumerate(zip(x, labels, strict=True))]
    points = spark.createDataFrame(rows, "period long, entity long, x array<double>, label int")
    i, j = np.nonzero(np.triu(a, 1))
    edges = spark.createDataFrame([(t, int(p), int(q), 1.0) for t in (1, 2) for p, q in zip(i, j, strict=True)], "period long, i long, j long, w double")
    found = {(r.period, r.metric): r for r in stats.panel_null(points, edges, points, 15).collect()}
    assert {m for _, m in found} == set(stats.PANEL)
    assert all(found[1, m].z > 3 and found[1, m].p == 1 / 16 for m in ("SW", "CH", "AVI", "Q"))
    one = points.filter("period = 1")
    panel = {r.metric: r.value for r in indices.feature_panel(points, points.selectExpr("'m' AS method", "4 AS k", "period", "entity", "label")).filter("period = 1").collect()}
    assert math.isclose(panel["CH"], indices.calinski_harabasz(one).first().CH, rel_tol=1e-9)
    assert math.isclose(panel["DBI"], indices.davies_bouldin(one).first().DBI, rel_tol=1e-9)
    assert math.isclose(panel["S_Dbw"], indices.s_dbw(one).first().S_Dbw, rel_tol=1e-9)
    assert math.isclose(panel["SW"], indices.silhouettes(one).agg(F.avg("silhouette")).first()[0], rel_tol=1e-9)
    network = indices.graph_indices(edges.filter("period = 1"), one.select("entity", "label")).first()
    assert all(math.isclose(found[1, m].observed, network[m], rel_tol=1e-9) for m in ("AVI", "AVU", "ANUI", "Q"))
    single = indices.feature_panel(points, points.selectExpr("'m' AS method", "1 AS k", "period", "entity", "0 AS label"))
    assert {r.value for r in single.collect()} == {None}


def test_null_models(spark, planted):
    x, a, labels = planted
    i, j = np.nonzero(np.triu(a, 1))
    edges = spark.createDataFrame([(int(p), int(q), 1.0) for p, q in zip(i, j, strict=True)], "i long, j long, w double")
    own = spark.createDataFrame([(k, int(v)) for k, v in enumerate(labels)], "entity long, label int")
    found = {r.metric: r for r in stats.permutation_null(edges, own, 20).collect()}
    assert found["Q"].z > 10 and found["AVI"].z > 10 and math.isclose(found["Q"].p, 1 / 21)
    assert abs(found["AVI"].mean - 0.25) < 0.03  # a random partition into 4
    dealt = stats.permuted(own, 3).groupBy("rep", "label").count().collect()
    assert all(r["count"] == 60 for r in dealt)


def test_permutations_do_not_depend_on_partitions(spark):
    own = spark.createDataFrame([(k, k % 3) for k in range(50)], "entity long, label int")
    a, b = (sorted(map(tuple, stats.permuted(own.repartition(n), 4, 9).collect())) for n in (1, 5))
    assert a == b


def test_survival_function():
    from netpanel.functions.scalars import chi2_survival

    for x, df, p in ((3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05), (0.0, 3, 1.0), (100.0, 5, 5.285e-20)):
        assert math.isclose(chi2_survival(x, df), p, rel_tol=1e-3)


def test_kruskal_degenerate(spark):
    same = spark.createDataFrame([(1.0, k % 2) for k in range(10)], "v double, l int")
    assert stats.kruskal(same, "v", "l").first().H is None
    apart = spark.createDataFrame([(float(k), int(k > 9)) for k in range(20)] + [(None, 1)], "v double, l int")
    r = stats.kruskal(apart, "v", "l").first()
    assert r.n == 20 and r.eta2 > 0.7 and r.p < 0.001


def test_silhouette_of_two_far_clusters(spark):
    points = spark.createDataFrame([(k, [float(100 * (k % 2)) + k / 100], k % 2) for k in range(20)], "entity long, x array<double>, label int")
    assert all(r.silhouette > 0.99 for r in indices.silhouettes(points).collect())


def test_queries_see_every_period(spark, sf_dir):
    from netpanel.plans import cluster_queries
    from netpanel.sources import tables

    periods = {r.period for r in tables.sales_panel(spark, sf_dir).select("period").distinct().collect()}
    windows = {r.t for r in cluster_queries.comovement_layer(spark, sf_dir).select("t").distinct().collect()}
    assert len(windows) > 1 and max(windows) == max(periods)
    assert {r.period for r in cluster_queries._points(spark, sf_dir).select("period").distinct().collect()} == periods
    assert {r.period for r in cluster_queries.subsample_stability(spark, sf_dir).select("period").distinct().collect()} == periods


def test_study_has_the_whole_panel_and_is_registered(spark, sf_dir):
    from netpanel.config import Config
    from netpanel.plans import serving_queries
    from netpanel.sources import tables

    features, config = serving_queries._study(spark, sf_dir)
    periods = {r.period for r in tables.sales_panel(spark, sf_dir).select("period").distinct().collect()}
    assert {r.period for r in features.points.select("period").distinct().collect()} == periods
    assert config == Config() and "panel_study" in serving_queries.QUERIES


def test_ranks_do_not_depend_on_ranges(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(int(g), int(a), float(v)) for g, a, v in zip(r.integers(0, 2, 400), r.integers(0, 3, 400), r.integers(0, 60, 400) / 4, strict=True)]
    df = spark.createDataFrame(rows, "g int, label int, v double")
    whole = sorted(map(tuple, stats.kruskal(df, "v", "label", ["g"]).collect()))
    monkeypatch.setattr(stats, "RANGE_VALUES", 7)
    parts = sorted(map(tuple, stats.kruskal(df, "v", "label", ["g"]).collect()))
    assert np.allclose(np.array(whole, float), np.array(parts, float)) and len(whole) == 2
    # p against the survival function of chi-squared with two degrees of freedom
    assert all(math.isclose(p, math.exp(-h / 2), rel_tol=1e-9) for _, _, _, h, _, p in whole)


def test_silhouettes_of_many_partitions_take_distances_once(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 3))
    x[:40] = x[0]
    partitions = [rng.integers(0, k, 150) for k in (2, 3, 5)] + [np.where(np.arange(150) == 7, 1, 0)]
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))

    def plain(labels):
        out = []
        for v, own in enumerate(labels):
            inside = labels == own
            if inside.sum() == 1:
                out.append(0.0)
                continue
            a, b = d[v][inside].sum() / (inside.sum() - 1), min(d[v][labels == c].mean() for c in set(labels) - {own})
            out.append((b - a) / max(a, b))
        return np.mean(out)

    roots = []
    monkeypatch.setattr(kernels.np, "sqrt", lambda v, *a, real=np.sqrt, **kw: (roots.append(np.size(v)), real(v, *a, **kw))[1])
    found = kernels.silhouettes(x, partitions, height=64, width=32)
    assert sum(roots) == 150 * 150  # not once for each partition
    assert np.allclose(found, [plain(p) for p in partitions], atol=1e-9)
    assert [m["SW"] for m in kernels.feature_panel(x, [partitions[0], np.zeros(150, int)])] == [kernels.silhouette(x, partitions[0]), None]


def test_leiden_costs_a_node_its_own_slices():
    ring = [{(v + 1) % 6: 1.0, (v - 1) % 6: 1.0} for v in range(6)]
    far = [[(v % 3 * 400_000, 2.0)] for v in range(6)]  # a matrix of slices by nodes would hold 4.8 million sums
    tracemalloc.start()
    found = kernels.leiden(ring, 0.5, np.random.default_rng(1), null=far)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 6 and peak < 20e6
    near = kernels.leiden(ring, 0.5, np.random.default_rng(1), null=[[(v % 3, 2.0)] for v in range(6)])
    assert (found == near).all()


def test_spectral_makes_no_matrix_of_all_nodes():
    rng = np.random.default_rng(2)
    n, blocks = 1500, 5
    i = rng.integers(0, n, 9 * n)
    j = np.where(rng.random(9 * n) < 0.9, rng.integers(0, n // blocks, 9 * n) * blocks + i % blocks, rng.integers(0, n, 9 * n))
    pairs = np.unique(np.minimum(i, j)[i != j] * n + np.maximum(i, j)[i != j])
    links = kernels.Links(n, *np.divmod(pairs, n), np.ones(len(pairs)))
    tracemalloc.start()
    found = kernels.spectral(links, blocks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * n * 8  # not one matrix
    assert kernels.adjusted_rand(found, np.arange(n) % blocks) > 0.95
    whole = kernels.leading(lambda m: links @ m / 20, n, 6, small=n)
    values = lambda v: np.diag(v.T @ (links @ v)) / 20
    assert np.allclose(values(kernels.leading(lambda m: links @ m / 20, n, 6)), values(whole), atol=1e-8)


def test_grid_agglomerates_once_for_all_k(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(90, 2)) + np.repeat([[0, 0], [9, 0], [0, 9]], 30, axis=0)
    assert all((kernels.ward_cuts(x, [3, 5])[at] == kernels.ward(x, k)).all() for at, k in enumerate((3, 5)))
    points = spark.createDataFrame([(1, v, [float(a) for a in x[v]]) for v in range(90)], "period long, entity long, x array<double>")
    edges = spark.createDataFrame([(1, v, v + 1, 1.0) for v in range(89) if v % 30 != 29], "period long, i long, j long, w double")

    def several(*_):
        raise AssertionError("a run for each k")

    monkeypatch.setitem(kernels.METHODS, "once", several)
    monkeypatch.setitem(kernels.CUTS, several, lambda x, a, ks: kernels.ward_cuts(x, ks))
    found = clustering.grid(points, edges, ["once", "spectral"], [2, 3]).toPandas()
    assert found.groupby(["method", "k"])["label"].nunique().to_dict() == {("once", 2): 2, ("once", 3): 3, ("spectral", 2): 2, ("spectral", 3): 3}


def test_nearest_meets_few_points(monkeypatch):
    r = np.random.default_rng(31)
    ids, x = np.arange(5000), r.normal(size=(5000, 3))
    met = []
    monkeypatch.setattr(kernels.np, "nonzero", lambda v, real=np.nonzero: (met.append(np.size(v)), real(v))[1])
    i, j, d = kernels.nearest(ids, x, ids, x, 4)
    assert sum(met) < 5000 * 5000 / 4
    some = r.choice(5000, 50, replace=False)
    for v in some:
        far = np.sqrt(((x - x[v]) ** 2).sum(1))
        far[v] = np.inf
        assert (j[i == v] == np.argsort(far, kind="stable")[:4]).all() and (d[i == v] == np.sort(far)[:4]).all()


def test_kmeans_compares_a_point_again_only_when_it_may_change(monkeypatch):
    r = np.random.default_rng(32)
    x, k = np.concatenate([r.normal(size=(2000, 3)), np.repeat(r.normal(size=(20, 3)), 5, 0)]), 5
    norms = (x**2).sum(1)
    start = x[kernels._seeds(norms, lambda c: x @ x[c], k, np.random.default_rng(1))]
    centres, now, rounds = start.copy(), None, 0
    while True:
        new = kernels.squared_distances(x, centres).argmin(1)
        rounds += 1
        if now is not None and (new == now).all():
            break
        now, centres = new, np.stack([x[new == c].mean(0) for c in range(k)])
    compared = []
    monkeypatch.setattr(kernels, "_least", lambda d, real=kernels._least: (compared.append(d.shape[1]), real(d))[1])
    found, at = kernels._lloyd(x, norms, start, 300)
    assert (found == now).all() and np.allclose(at, centres) and sum(compared) < len(x) * rounds / 2


@pytest.mark.parametrize("metric,balanced", [("euclidean", False), ("euclidean", True), ("cosine", False)])
@pytest.mark.parametrize("hubs", [0, 64])
def test_joint_clusters_are_those_of_whole_rows(planted, monkeypatch, metric, balanced, hubs):
    x, a, _ = planted
    monkeypatch.setattr(kernels, "HUBS", hubs)  # without and with the paths of two links
    monkeypatch.setattr(kernels._Joined, "__getitem__", None)  # no row of the modularity matrix is made
    found = kernels.joint_kmeans(x, a, 4, np.random.default_rng(2), metric=metric, balanced=balanced, n_init=1)
    p = kernels.modularity_matrix(a)
    if metric == "cosine":
        x, p = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, p))
    xi = (x**2).sum() / (p**2).sum() if balanced else 1.0
    z = np.hstack([x, np.sqrt(xi) * p])
    centres = z[kernels._seeds((z**2).sum(1), lambda c: z @ z[c], 4, np.random.default_rng(2))]
    history = []
    for _ in range(found.n_iter):
        labels = kernels.squared_distances(z, centres).argmin(1)
        centres = np.stack([z[labels == c].mean(0) for c in range(4)])
        if metric == "cosine":
            for part, scale in ((slice(None, x.shape[1]), 1.0), (slice(x.shape[1], None), np.sqrt(xi))):
                centres[:, part] *= scale / np.linalg.norm(centres[:, part], axis=1, keepdims=True)
        history.append(((z - centres[labels]) ** 2).sum())
    assert (found.labels == kernels.relabelled(labels)).all() and np.allclose(found.history, history)
    assert np.allclose(np.hstack(found.centres), np.hstack([centres[:, : x.shape[1]], centres[:, x.shape[1] :] / np.sqrt(xi)]))


def test_runs_share_the_graph(spark, monkeypatch):
    r = np.random.default_rng(33)
    edges = spark.createDataFrame([(t, i, j, float(r.random())) for t in (1, 2) for i in range(20) for j in range(i + 1, 21) if r.random() < 0.3], "period long, i long, j long, w double")
    rows = [(m, k, t, v, int(r.integers(k))) for m in "ab" for k in (2, 3) for t in (1, 2, 3) for v in range(20 - k)]  # nodes without a label, a period without links
    labels = spark.createDataFrame(rows, "method string, k int, period long, entity long, label int")
    key = ["method", "k", "period"]
    every = edges.join(labels.select(key).distinct(), "period")
    plain = {tuple(q[c] for c in (*key, "a", "b")): q.s for q in graphs.block_sums(every, labels, key).collect()}
    found = {tuple(q[c] for c in (*key, "a", "b")): q.s for q in graphs.block_sums_of_runs(edges, labels, ["method", "k"]).collect()}
    assert found.keys() == plain.keys() and all(math.isclose(found[q], plain[q]) for q in plain)


def test_leiden_searches_of_all_k_share_their_finds(planted, monkeypatch):
    _, a, labels = planted
    calls = []
    monkeypatch.setattr(kernels, "leiden", lambda g, gamma, rng, real=kernels.leiden, **kw: (calls.append(gamma), real(g, gamma, rng, **kw))[1])
    found = kernels.leiden_cuts(a, [3, 4, 5, 6], np.random.default_rng(1))
    assert len(calls) == len(set(calls)) and kernels.adjusted_rand(found[1], labels) > 0.9
    apart = [kernels.leiden_k(a, k, np.random.default_rng(1)) for k in (3, 4, 5, 6)]
    assert all((x == y).all() for x, y in zip(found, apart, strict=True))
    calls.clear()
    ring = kernels.Links(40, np.arange(0, 40, 2), np.arange(1, 40, 2), np.ones(20))  # 20 parts
    plain = kernels.leiden(kernels.adjacency(40, ring.i, ring.j, ring.w), 1e-4, np.random.default_rng(1))
    calls.clear()
    assert kernels.adjusted_rand(kernels.leiden_k(ring, 5, np.random.default_rng(1)), plain) == 1 and not calls


def test_spectral_of_many_parts_makes_no_matrix_of_them():
    n = 9000  # 3000 parts of three nodes, one of them apart from links between its nodes' neighbours
    at = np.arange(0, n, 3)
    links = kernels.Links(n, np.concatenate([at, at]), np.concatenate([at + 1, at + 2]), np.random.default_rng(3).random(2 * len(at)) + 0.5)
    tracemalloc.start()
    found = kernels.spectral(links, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(found)) == 4 and peak < 3000 * 3000 * 8 * 3


def test_temporal_parts_that_never_join_need_no_search(monkeypatch):
    r = np.random.default_rng(34)
    n, slices = 60, []
    for _ in range(3):
        i, j = (v.ravel() for v in np.meshgrid(np.arange(n), np.arange(n)))
        some = (i < j) & (i // 10 == j // 10) & (r.random(n * n) < 0.4)  # six parts, in all slices
        slices.append(kernels.Links(n, i[some], j[some], r.random(some.sum()) + 0.1))
    calls = []
    monkeypatch.setattr(kernels, "leiden", lambda *a, real=kernels.leiden, **kw: (calls.append(1), real(*a, **kw))[1])
    found = kernels.temporal_leiden(slices, 4, np.random.default_rng(1))
    assert kernels.adjusted_rand(found.ravel(), np.tile(np.arange(n) // 10, 3)) == 1 and not calls
    assert len(np.unique(kernels.temporal_leiden(slices, 8, np.random.default_rng(1)))) >= 7 and calls


def test_rows_of_a_period_are_copied_to_few_blocks(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(vectors, "_blocked", lambda points, by, block, width, real=vectors._blocked: (asked.append((block, width)), real(points, by, block, width))[1])
    points = spark.createDataFrame([(1, 0, [0.0]), (1, 1, [1.0])], "period long, entity long, x array<double>")
    vectors.neighbours(points, 1, ["period"])
    assert asked[0][0] == asked[0][1] and -(-60_000 // inspect.signature(clustering.comovement_layer).parameters["block"].default) <= 4


def test_links_of_entities_without_points_are_left_out():
    edges = pd.DataFrame({"i": [1, 1, 3, 4], "j": [3, 2, 9, 5], "w": [1.0, 2.0, 3.0, 4.0]})
    found = clustering._links(np.array([1, 3, 4, 5]), edges)
    assert list(zip(found.i.tolist(), found.j.tolist(), found.w.tolist(), strict=True)) == [(0, 1, 1.0), (2, 3, 4.0)]
