"""Clusterings of many groups at once: a task has one (period, method, k, replicate) and calls a dense kernel.

Methods are looked up in ``kernels.METHODS``: name -> function(x, a, k, rng) -> labels; ``register`` adds one. Every
task seeds its generator by its key, so results depend neither on partitions nor on order.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netpanel.operators import graphs, indices, kernels, vectors
from netpanel.session import alone, dealt, kept


def register(name: str, method: Callable) -> None:
    """Adds a clustering method: function(x, a, k, rng) -> labels."""
    kernels.METHODS[name] = method


def _rng(*key) -> np.random.Generator:
    return np.random.default_rng(zlib.crc32(":".join(map(str, key)).encode()))


def _links(ids: np.ndarray, edges: pd.DataFrame) -> kernels.Links:
    """The graph of a period, its nodes numbered by their places in ``ids``; links of others, as of entities without points, are left out."""
    edges = edges[edges["i"].isin(ids) & edges["j"].isin(ids)]
    return kernels.Links(len(ids), np.searchsorted(ids, edges["i"].to_numpy()), np.searchsorted(ids, edges["j"].to_numpy()), edges["w"].to_numpy())


def _adjacency(ids: np.ndarray, edges: pd.DataFrame) -> np.ndarray:
    return _links(ids, edges).dense()


def grid(points: DataFrame, edges: DataFrame, methods: Sequence[str], ks: Sequence[int], seed: int = 42) -> DataFrame:
    """period, method, k, entity, label, seconds: every method and k on every period's points (entity, x) and graph (i, j, w)."""
    spark = points.sparkSession
    functions = {m: kernels.METHODS[m] for m in methods}  # goes to the tasks, with methods registered here
    sparse = {m for m in methods if functions[m] in kernels.LINKS}
    cuts = {m: kernels.CUTS[functions[m]] for m in methods if functions[m] in kernels.CUTS}
    drawn = {m: kernels.DRAWN[functions[m]] for m in methods if functions[m] in kernels.DRAWN}
    ks = [int(k) for k in ks]
    names = F.broadcast(spark.createDataFrame([(m,) for m in methods], "method string"))
    left, right = (rows.crossJoin(names) for rows in (points.select("period", "entity", "x"), edges.select("period", "i", "j", "w")))  # a period's rows once for each method
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, for the cogroup

    def cluster(key, nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        period, method = key
        nodes = nodes.sort_values("entity")
        ids = nodes["entity"].to_numpy()
        x, a, out = np.array(nodes["x"].tolist(), float), (_links if method in sparse else _adjacency)(ids, links), []
        began = time.perf_counter()
        every = None
        if len(ids) and ks and method in drawn:
            every = drawn[method](x, a, ks, _rng(seed, period, method))
        elif len(ids) and ks and method in cuts:
            every = cuts[method](x, a, ks)
        shared = (time.perf_counter() - began) / max(len(ks), 1)
        for at, k in enumerate(ks if len(ids) else ()):
            began = time.perf_counter()
            labels = functions[method](x, a, k, _rng(seed, period, method, k)) if every is None else every[at]
            out.append(pd.DataFrame({"period": period, "method": method, "k": k, "entity": ids, "label": np.asarray(labels, "int32"), "seconds": time.perf_counter() - began + shared}))
        return pd.concat(out) if out else pd.DataFrame({"period": [], "method": [], "k": [], "entity": [], "label": [], "seconds": []}).astype({"period": "int64", "method": "str", "k": "int32", "entity": "int64", "label": "int32", "seconds": "float64"})

    key = ("period", "method")
    return dealt(left, *key).groupBy(*key).cogroup(dealt(right, *key).groupBy(*key)).applyInPandas(cluster, "period long, method string, k int, entity long, label int, seconds double")


def temporal(edges: DataFrame, nodes: DataFrame, k: int, omega: float = 0.25, min_size: int = 1, seed: int = 42) -> DataFrame:
    """period, entity, label of one multislice graph over all periods; the one clustering that does not divide by period."""
    periods = nodes.select("period").distinct().withColumn("_one", F.lit(1))
    rows = edges.select("period", "i", "j", "w").withColumn("_one", F.lit(1))
    own = nodes.select("entity").distinct().join(periods, F.lit(True)).select("_one", "period", "entity")

    def cluster(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ids, times = np.unique(a["entity"].to_numpy()), np.unique(a["period"].to_numpy())
        slices = [_links(ids, b[b["period"] == t]) for t in times]
        labels = kernels.temporal_leiden(slices, k, _rng(seed, k), omega, min_size)
        return pd.DataFrame({"period": np.repeat(times, len(ids)), "entity": np.tile(ids, len(times)), "label": labels.ravel().astype("int32")})

    return own.groupBy("_one").cogroup(rows.groupBy("_one")).applyInPandas(cluster, "period long, entity long, label int")


def _growth_rows(growth: DataFrame) -> DataFrame:
    """t, entity, g: growth at each period that the window of t has, NULL where the entity has none; windows of three periods at least."""
    calendar = growth.groupBy("t").agg(F.sort_array(F.collect_set("period")).alias("_periods")).filter(F.size("_periods") >= 3)
    rows = growth.groupBy("t", "entity").agg(F.map_from_entries(F.collect_list(F.struct("period", "growth"))).alias("_g"))
    return rows.join(F.broadcast(calendar), "t").select("t", "entity", F.transform("_periods", lambda p: F.try_element_at("_g", p)).alias("g"))  # a row for each window


def _shrinkage(rows: DataFrame, lags: Sequence[int]) -> DataFrame:
    """t, lag, delta, mu (the mean variance) of ``_growth_rows``: products of times are summed over entities where they lie."""
    lags = tuple(lags)

    def products(batches):
        for batch in batches:
            for t, part in batch.groupby("t"):
                for lag, parts in kernels.lag_parts(np.stack(part["g"]).astype(float), lags).items():
                    gram = sum(z.T @ z for z in parts)
                    a, b = np.indices(gram.shape)
                    yield pd.DataFrame({"t": t, "lag": lag, "a": a.ravel(), "b": b.ravel(), "v": gram.ravel(), "p": len(parts) * len(part)})

    def shrink(key, cells: pd.DataFrame) -> pd.DataFrame:
        n, p = int(cells["a"].max()) + 1, int(cells["p"].iloc[0])
        gram = np.zeros((n, n))
        gram[cells["a"], cells["b"]] = cells["v"]
        return pd.DataFrame({"t": [key[0]], "lag": [key[1]], "delta": [kernels.shrinkage_of_gram(gram, p)], "mu": [np.trace(gram) / n / p]})

    sums = rows.mapInPandas(products, "t long, lag int, a int, b int, v double, p long").groupBy("t", "lag", "a", "b").agg(F.sum("v").alias("v"), F.sum("p").alias("p"))
    return sums.groupBy("t", "lag").applyInPandas(shrink, "t long, lag int, delta double, mu double")


def comovement_layer(growth: DataFrame, k: int = 10, lags: Sequence[int] = (0, 1), mutual: bool = True, block: int = 16384) -> DataFrame:
    """t, i, j, w of entities that grow together in the window of each t (t, period, entity, growth): the largest correlation over lags.

    A task has a block of a window's entities and compares it with all of them, a strip at a time; all go to each block's task, so blocks are large.
    """
    rows = kept(_growth_rows(growth))
    shrunk: dict[int, dict[int, tuple[float, float]]] = {}
    for r in _shrinkage(rows, lags).collect():  # a row for each window and lag
        shrunk.setdefault(r.t, {})[r.lag] = r.delta, r.mu
    sizes = F.broadcast(rows.groupBy("t").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks")))  # a row for each window
    left = rows.join(sizes, "t").withColumn("_l", F.pmod(F.xxhash64("entity"), "_blocks").cast("int")).drop("_blocks")
    right = rows.join(sizes, "t").withColumn("_l", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    right = right.select(*[F.col(c).alias(c) for c in ("t", "entity", "g", "_l")])  # columns of its own, for the cogroup

    def strongest(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({"t": [], "i": [], "j": [], "w": []}).astype({"t": "int64", "i": "int64", "j": "int64", "w": "float64"})
        b = b.sort_values("entity")
        scaled = [kernels.correlation_rows(np.stack(part["g"]).astype(float), shrunk[key[0]]) for part in (a, b)]
        i, j, w = kernels.strongest_comovement(a["entity"].to_numpy(), scaled[0], b["entity"].to_numpy(), scaled[1], k)
        return pd.DataFrame({"t": key[0], "i": i, "j": j, "w": w})

    found = dealt(left, "t", "_l").groupBy("t", "_l").cogroup(dealt(right, "t", "_l").groupBy("t", "_l")).applyInPandas(strongest, "t long, i long, j long, w double")
    return graphs.undirected(found, mutual, ["t"])


def comovement_shrinkage(growth: DataFrame, lags: Sequence[int] = (0, 1)) -> DataFrame:
    """t, lag, delta: how much the correlation of each window was shrunk."""
    return _shrinkage(_growth_rows(growth), lags).select("t", "lag", "delta")


#: Nodes of a period whose fusion any task may hold beside others; larger ones get an executor each.
BESIDE = 2000


def fused_layer(layers: DataFrame, k: int = 10, rounds: int = 10, alpha: float = 0.5, mutual: bool = True, tree: bool = True) -> DataFrame:
    """period, i, j, w: similarity network fusion of each period's layers (layer, period, i, j, w), which are read twice.

    A task has one period; with over ``BESIDE`` nodes in one of them, an executor has one task at a time.
    """
    nodes = layers.select("period", F.explode(F.array("i", "j")).alias("entity")).distinct().groupBy("period").count()
    most = nodes.agg(F.max("count")).first()[0] or 0
    rows, threads = alone(layers, "period") if most > BESIDE else (dealt(layers, "period"), 1)

    def fuse(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(rows[["i", "j"]].to_numpy())
        w = kernels.fused_links([_links(ids, part) for _, part in sorted(rows.groupby("layer"))], k, rounds, alpha, mutual, tree, threads)
        return pd.DataFrame({"period": int(rows["period"].iloc[0]), "i": ids[w.i], "j": ids[w.j], "w": w.w})

    return rows.groupBy("period").applyInPandas(fuse, "period long, i long, j long, w double")


def layer_ablation(labels: DataFrame) -> DataFrame:
    """method, a, b, ari: how much the partitions by two layers agree, by period (layer, method, period, entity, label)."""
    a = labels.select("method", "period", "entity", F.col("layer").alias("a"), F.col("label").alias("la"))
    b = labels.select("method", "period", "entity", F.col("layer").alias("b"), F.col("label").alias("lb"))
    return indices.adjusted_rand(a.join(b, ["method", "period", "entity"]).filter("a < b"), "la", "lb", ["method", "a", "b", "period"])


def bootstrap_membership(points: DataFrame, edges: DataFrame | None, labels: DataFrame, method: str, n: int = 30, share: float = 0.8, seed: int = 42, chunks: int = 4) -> DataFrame:
    """period, entity, label, voted, votes, probability: how many of n subsamples give the entity each of its period's labels (``voted``).

    A subsample's points and the graph among them are clustered and matched to the reference labels, and every entity votes: its own label, or, outside of
    the subsample, that of the nearest centre. Labels without a match do not vote; the denominator stays n. A task has a period and an
    n / ``chunks`` share of its subsamples.
    """
    from netpanel.operators.labels import alignment

    run = kernels.METHODS[method]
    sparse = run in kernels.LINKS
    part = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    rows = points.select("period", "entity", "x").join(labels.select("period", "entity", "label"), ["period", "entity"])
    left = rows.select("period", "entity", "x", "label", part)
    links = edges.select("period", "i", "j", "w") if edges is not None else rows.limit(0).select("period", F.col("entity").alias("i"), F.col("entity").alias("j"), F.lit(1.0).alias("w"))
    right = links.select("period", "i", "j", "w", part).select(*[F.col(c).alias(c) for c in ("period", "i", "j", "w", "chunk")])

    def vote(key, group: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        period, chunk = key
        group = group.sort_values("entity")
        ids, own = group["entity"].to_numpy(), group["label"].to_numpy()
        if not len(ids):
            return pd.DataFrame({c: [] for c in ("period", "entity", "label", "voted", "votes")}).astype({"period": "int64", "entity": "int64", "label": "int32", "voted": "int32", "votes": "int64"})
        x, known = np.array(group["x"].tolist(), float), np.unique(own)
        a = _links(ids, links[links["i"].isin(ids) & links["j"].isin(ids)])
        k, votes = len(known), np.zeros((len(ids), len(known)), np.int64)
        for rep in range(int(chunk), n, chunks):
            rng = _rng(seed, period, rep)
            chosen = np.sort(rng.choice(len(x), min(len(x), max(k + 1, int(round(share * len(x))))), replace=False))
            part = a.among(chosen)
            found = run(x[chosen], part if sparse else part.dense(), k, rng)
            names, which = np.unique(found, return_inverse=True)
            centres = np.stack([x[chosen][which == c].mean(0) for c in range(len(names))])
            every = kernels.squared_distances(x, centres).argmin(1)
            every[chosen] = which
            cells, count = np.unique(np.stack([own[chosen], which], 1), axis=0, return_counts=True)
            matched = alignment([(int(p), int(q), int(c)) for (p, q), c in zip(cells, count, strict=True)])
            voted = np.array([matched.get(c, -1) for c in range(len(names))])[every]
            at = np.minimum(np.searchsorted(known, voted), k - 1)
            hit = known[at] == voted
            votes[np.flatnonzero(hit), at[hit]] += 1
        return pd.DataFrame({"period": period, "entity": np.repeat(ids, k), "label": np.repeat(own, k), "voted": np.tile(known, len(ids)).astype("int32"), "votes": votes.ravel()})

    key = ("period", "chunk")
    votes = dealt(left, *key).groupBy(*key).cogroup(dealt(right, *key).groupBy(*key)).applyInPandas(vote, "period long, entity long, label int, voted int, votes long")
    return votes.groupBy("period", "entity", "label", "voted").agg(F.sum("votes").alias("votes")).withColumn("probability", F.col("votes") / n)


def confidence(membership: DataFrame) -> DataFrame:
    """period, entity, label, modal (the label of most votes; the smaller on ties), confidence (its share), own (the share of the entity's own label)."""
    order = F.struct("probability", (-F.col("voted")).alias("v"))
    own = F.max(F.when(F.col("voted") == F.col("label"), F.col("probability")))
    return membership.groupBy("period", "entity", "label").agg(F.max_by("voted", order).alias("modal"), F.max("probability").alias("confidence"), own.alias("own"))


def confidence_summary(found: DataFrame, threshold: float = 0.7) -> DataFrame:
    """By period: the median confidence, the share of entities above the threshold, and of those whose modal label is their own."""
    share = lambda c: F.avg(c.cast("int"))
    return found.groupBy("period").agg(F.median("confidence").alias("median"), share(F.col("confidence") >= threshold).alias("share_sure"), share(F.col("modal") == F.col("label")).alias("share_own"))


def metrics_union(*tables: DataFrame) -> DataFrame:
    """One long table of metric tables; columns that some do not have (a layer, a replicate) are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def out_of_time(points: DataFrame, labels: DataFrame, train: tuple[int, int], test: tuple[int, int]) -> DataFrame:
    """period, ari, agreement, margin: test periods classified by the centres of the train periods, against their own labels."""
    rows = points.join(labels.select("period", "entity", "label"), ["period", "entity"])
    centres = vectors.centres(rows.filter(F.col("period").between(*train)))
    tested = rows.filter(F.col("period").between(*test))
    classed = vectors.nearest_centre(tested, centres, ("period", "entity")).join(tested.select("period", "entity", "label"), ["period", "entity"])
    agree = classed.groupBy("period").agg(F.avg((F.col("nearest") == F.col("label")).cast("int")).alias("agreement"), F.avg("margin").alias("margin"))
    return indices.adjusted_rand(classed, "nearest", "label", ["period"]).join(agree, "period")


def classified_online(points: DataFrame, labels: DataFrame, train: tuple[int, int], test: tuple[int, int]) -> DataFrame:
    """period, entity, label: train labels as they are, test periods by the nearest train centre."""
    rows = points.join(labels.select("period", "entity", "label"), ["period", "entity"])
    known = rows.filter(F.col("period").between(*train))
    found = vectors.nearest_centre(rows.filter(F.col("period").between(*test)), vectors.centres(known), ("period", "entity"))
    return known.select("period", "entity", "label").unionByName(found.select("period", "entity", F.col("nearest").cast("int").alias("label")))


def outside_panel(points: DataFrame, labels: DataFrame, others: DataFrame) -> DataFrame:
    """period, entity, nearest, margin of entities that have no label: by the centres of the same period; NULL features: -1 and 0."""
    centres = vectors.centres(points.join(labels.select("period", "entity", "label"), ["period", "entity"]), ("period", "label"))
    whole = others.filter(~F.exists("x", lambda v: v.isNull()))
    found = vectors.nearest_centre(whole, centres, ("period", "entity"), ("period",)).select("period", "entity", F.col("nearest").cast("int").alias("nearest"), "margin")
    broken = others.filter(F.exists("x", lambda v: v.isNull())).select("period", "entity", F.lit(-1).alias("nearest"), F.lit(0.0).alias("margin"))
    return found.unionByName(broken)
