"""Similarity graphs as edge tables (i, j, w) with i < j, of one or several layers and periods; and their measures.

``by`` names the columns that tell graphs apart (layer, period); every operator works on all graphs at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netpanel.operators import kernels, vectors
from netpanel.session import dealt, kept, shared_folder


def both_ways(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every edge in both directions."""
    flip = edges.select(*by, F.col("j").alias("i"), F.col("i").alias("j"), "w")
    return edges.select(*by, "i", "j", "w").unionByName(flip)


def finalise(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One edge for each pair, the larger weight of both directions; no loops, no zeros, weights at most 1."""
    pairs = edges.filter("i != j").groupBy(*by, F.least("i", "j").alias("_a"), F.greatest("i", "j").alias("_b")).agg(F.max("w").alias("w"))
    return pairs.filter("w > 0").select(*by, F.col("_a").alias("i"), F.col("_b").alias("j"), F.least("w", F.lit(1.0)).alias("w"))


def top_k(scores: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Of directed scores (i, j, s) the k largest positive ones of each i; ties to the smaller j."""
    order = Window.partitionBy(*by, "i").orderBy(F.desc("s"), "j")
    rows = scores.filter("s > 0 and i != j").withColumn("_n", F.row_number().over(order))
    return rows.filter(F.col("_n") <= k).select(*by, "i", "j", F.col("s").alias("w"))


def undirected(directed: DataFrame, mutual: bool, by: Sequence[str] = ()) -> DataFrame:
    """Mutual: pairs chosen from both sides, with the smaller weight; else from either, with the larger."""
    pairs = directed.groupBy(*by, F.least("i", "j").alias("_a"), F.greatest("i", "j").alias("_b")).agg(F.count(F.lit(1)).alias("_n"), (F.min if mutual else F.max)("w").alias("w"))
    pairs = pairs.filter("_n = 2") if mutual else pairs
    return finalise(pairs.select(*by, F.col("_a").alias("i"), F.col("_b").alias("j"), "w"), by)


def behaviour_layer(points: DataFrame, k: int = 10, local_scale_k: int = 7, mutual: bool = True, add_mst: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """k nearest neighbours with the locally scaled kernel exp(-d^2 / (s_i s_j)); s_i is the distance to the local_scale_k-th.

    With ``add_mst`` the edges of the minimum spanning tree of all distances join, with the same kernel.
    """
    near = vectors.neighbours(points, max(k, local_scale_k), by)
    scale = near.filter(F.col("rank") == local_scale_k).select(*by, F.col("i").alias("_p"), F.greatest("d", F.lit(1e-12)).alias("_s"))

    def weighted(pairs: DataFrame) -> DataFrame:
        out = pairs.join(scale.withColumnRenamed("_p", "i").withColumnRenamed("_s", "_si"), [*by, "i"]).join(scale.withColumnRenamed("_p", "j").withColumnRenamed("_s", "_sj"), [*by, "j"])
        return out.select(*by, "i", "j", F.exp(-F.col("d") * F.col("d") / (F.col("_si") * F.col("_sj"))).alias("w"))

    edges = undirected(weighted(near.filter(F.col("rank") <= k)), mutual, by)
    if add_mst:
        edges = finalise(edges.unionByName(weighted(minimum_spanning_tree(points, by))), by)
    return edges


def minimum_spanning_tree(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(i, j, d) of the tree of least total distance of each group; a group's points are one task's."""
    types = dict(points.dtypes)

    def tree(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("entity")
        ids = rows["entity"].to_numpy()
        a, b, d = kernels.spanning_tree(np.array(rows["x"].tolist(), float))
        out = pd.DataFrame({"i": ids[a], "j": ids[b], "d": d})
        for c in by:
            out[c] = rows[c].iloc[0]
        return out[[*by, "i", "j", "d"]]

    schema = ", ".join([*(f"{c} {types[c]}" for c in by), "i long, j long, d double"])
    return (points if by else points.withColumn("_one", F.lit(1))).groupBy(*(by or ["_one"])).applyInPandas(tree, schema)


def gravity_layer(distances: DataFrame, k: int = 10, scale_km: float = 200.0, by: Sequence[str] = ()) -> DataFrame:
    """exp(-km / scale), the k strongest of each entity, from either side."""
    near = distances.select(*by, "i", "j", F.exp(-F.col("km") / scale_km).alias("s"))
    flip = near.select(*by, F.col("j").alias("i"), F.col("i").alias("j"), "s")
    return undirected(top_k(near.unionByName(flip), k, by), False, by)


def gravity_line(places: DataFrame, k: int = 10, scale_km: float = 200.0, per_km: float = 1.0, block: int = 10_000, zero_km: float = 0.0) -> DataFrame:
    """``gravity_layer`` of places on a line (entity, value) whose distance is |difference| / per_km (``zero_km`` if there is none), without the pairs.

    Entities of one value stand in for each other, so the k + 1 smallest of each value and the k values on either side hold every nearest one.
    Values lie in blocks by their rank, with k of the next ones at both ends; a task has one block.
    """
    rows = places.filter(F.col("value").isNotNull() & ~F.isnan("value")).select("entity", F.col("value").cast("double").alias("value"))
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy("value").orderBy("entity")))
    some = kept(numbered.filter(F.col("_n") <= k + 1).groupBy("value").agg(F.sort_array(F.collect_list("entity")).alias("near")))
    ranges = -(-some.count() // block)
    cuts = sorted(set(some.approxQuantile("value", [q / ranges for q in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("value"))) if cuts else F.lit(0)
    some = some.withColumn("_at", at)
    sizes = some.groupBy("_at").agg(F.count(F.lit(1)).alias("_s"))
    before = sizes.select("_at", F.coalesce(F.sum("_s").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_at").orderBy("value")) - 1
    ranked = some.join(F.broadcast(before), "_at").select("value", "near", rank.alias("_rank"))
    first, last = F.floor(F.greatest(F.col("_rank") - k, F.lit(0)) / block), F.floor((F.col("_rank") + k) / block)
    spread = ranked.withColumn("_block", F.explode(F.sequence(first, last))).withColumn("own", F.floor(F.col("_rank") / block) == F.col("_block"))

    order = Window.partitionBy("_block").orderBy("_rank")
    side = F.collect_list(F.struct(F.col("value").alias("v"), "near")).over(order.rowsBetween(-k, k))
    around = spread.withColumn("around", side).filter("own").select("value", "around")
    met = rows.join(around, "value").select(F.col("entity").alias("i"), "value", F.explode("around").alias("o"))
    km = F.abs(F.col("value") - F.col("o.v")) / per_km
    met = met.select("i", F.exp(-F.when(km > 0, km).otherwise(F.lit(zero_km)) / scale_km).alias("s"), F.explode("o.near").alias("j"))
    best = met.filter("s > 0 and i != j").groupBy("i").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("n"), "j"))), 1, k).alias("b"))
    directed = best.select("i", F.explode("b").alias("b")).select("i", F.col("b.j").alias("j"), (-F.col("b.n")).alias("w"))
    return undirected(directed, False)


def mean_fuse(layers: DataFrame, n_layers: int, k: int | None = None, by: Sequence[str] = (), layer: str = "layer") -> DataFrame:
    """The mean over layers of edges scaled to a largest weight of 1; then the k strongest of each entity, from either side."""
    top = layers.groupBy(*by, layer).agg(F.max("w").alias("_top"))
    mean = layers.join(top, [*by, layer]).groupBy(*by, "i", "j").agg((F.sum(F.col("w") / F.col("_top")) / n_layers).alias("w"))
    if k is None:
        return finalise(mean, by)
    return undirected(top_k(both_ways(mean, by).withColumnRenamed("w", "s"), k, by), False, by)


def edge_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Common edges over all edges of two graphs, one row; two empty graphs are equal."""
    both = a.select("i", "j", F.lit(1).alias("_a")).join(b.select("i", "j", F.lit(1).alias("_b")), ["i", "j"], "outer")
    return both.agg(F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("common"), F.count(F.lit(1)).alias("all_edges")).select("common", "all_edges", F.when(F.col("all_edges") > 0, F.col("common") / F.col("all_edges")).otherwise(1.0).alias("jaccard"))


def degrees(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return both_ways(edges, by).groupBy(*by, F.col("i").alias("entity")).agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """entity, component (its smallest entity): smallest labels spread and labels of labels are followed, until nothing changes."""
    shared_folder(edges.sparkSession)
    around = both_ways(edges).select("i", "j")
    now = nodes.select("entity", F.col("entity").alias("component")).checkpoint()
    total = None
    while True:
        seen = around.join(now.select(F.col("entity").alias("j"), "component"), "j").groupBy(F.col("i").alias("entity")).agg(F.min("component").alias("_near"))
        step = now.join(seen, "entity", "left").select("entity", F.least("component", F.coalesce("_near", "component")).alias("component"))
        jump = step.select(F.col("entity").alias("component"), F.col("component").alias("_further"))
        now = step.join(jump, "component").select("entity", F.least("component", "_further").alias("component")).checkpoint()
        new = now.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if new == total:
            return now
        total = new


def local_clustering(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """entity, degree, triangles and the share of its neighbours' pairs that are linked (0 below two neighbours).

    A triangle is found once, from its node of least degree: that bounds the pairs at a hub.
    """
    deg = degrees(edges).select("entity", "degree")
    ranked = edges.join(deg.withColumnRenamed("entity", "i").withColumnRenamed("degree", "di"), "i").join(deg.withColumnRenamed("entity", "j").withColumnRenamed("degree", "dj"), "j")
    first = (F.col("di") < F.col("dj")) | ((F.col("di") == F.col("dj")) & (F.col("i") < F.col("j")))
    out = ranked.select(F.when(first, F.col("i")).otherwise(F.col("j")).alias("u"), F.when(first, F.col("j")).otherwise(F.col("i")).alias("v"))
    wedges = out.alias("a").join(out.alias("b"), F.col("a.u") == F.col("b.u")).filter("a.v < b.v").select(F.col("a.u").alias("u"), F.col("a.v").alias("i"), F.col("b.v").alias("j"))
    closed = wedges.join(edges.select("i", "j"), ["i", "j"])
    per_node = closed.select(F.explode(F.array("u", "i", "j")).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("triangles"))
    rows = nodes.select("entity").join(deg, "entity", "left").join(per_node, "entity", "left").fillna(0, ["degree", "triangles"])
    return rows.withColumn("clustering", F.when(F.col("degree") > 1, 2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0))


def assortativity(edges: DataFrame) -> DataFrame:
    """Correlation of the degrees at both ends of edges, one row."""
    deg = degrees(edges).select("entity", "degree")
    ends = both_ways(edges).join(deg.withColumnRenamed("entity", "i").withColumnRenamed("degree", "a"), "i").join(deg.withColumnRenamed("entity", "j").withColumnRenamed("degree", "b"), "j")
    return ends.agg(F.corr("a", "b").alias("assortativity"))


def rayleigh(edges: DataFrame, values: DataFrame) -> DataFrame:
    """How smooth a value (entity, value) is on the graph: sum of w (x_i - x_j)^2 over sum of x^2, plain and with degrees, of centred values."""
    mean = values.agg(F.avg("value").alias("_mean"))
    x = values.crossJoin(F.broadcast(mean)).select("entity", (F.col("value") - F.col("_mean")).alias("x"))  # one row
    ends = edges.join(x.withColumnRenamed("entity", "i").withColumnRenamed("x", "xi"), "i").join(x.withColumnRenamed("entity", "j").withColumnRenamed("x", "xj"), "j")
    strength = degrees(edges).select("entity", "strength")
    top = ends.agg(F.sum(F.col("w") * (F.col("xi") - F.col("xj")) * (F.col("xi") - F.col("xj"))).alias("top"))
    low = x.join(strength, "entity", "left").agg(F.sum(F.col("x") * F.col("x")).alias("plain"), F.sum(F.coalesce("strength", F.lit(0.0)) * F.col("x") * F.col("x")).alias("weighted"))
    return top.crossJoin(low).select((F.col("top") / F.col("plain")).alias("rayleigh"), (F.col("top") / F.col("weighted")).alias("rayleigh_normalised"))  # one row each


def summary(edges: DataFrame, nodes: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Size, density, mean degree and weight, components, shares of the largest one and of isolated nodes, clustering, assortativity; one row."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    m = edges.agg(F.count(F.lit(1)).alias("edges"), F.avg("w").alias("mean_weight"))
    comp = components(edges, nodes).groupBy("component").agg(F.count(F.lit(1)).alias("size")).agg(F.count(F.lit(1)).alias("components"), F.max("size").alias("giant"), F.count(F.when(F.col("size") == 1, 1)).alias("isolated"))
    parts = [n, m, comp, local_clustering(edges, nodes).agg(F.avg("clustering").alias("clustering")), assortativity(edges)]
    if lengths is not None:
        parts.append(edges.join(lengths, ["i", "j"]).agg(F.avg("km").alias("mean_km")))
    out = reduce(lambda a, b: a.crossJoin(b), parts)  # one row each
    density = F.when(F.col("nodes") > 1, 2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)))
    return out.withColumns({"density": density, "mean_degree": 2 * F.col("edges") / F.col("nodes"), "giant_share": F.col("giant") / F.col("nodes"), "isolated_share": F.col("isolated") / F.col("nodes")})


def spectrum(edges: DataFrame, nodes: DataFrame, count: int = 10) -> DataFrame:
    """place, eigenvalue: the smallest of the normalised Laplacian; of a graph that one task holds.

    Its eigenvalues are those of its components, each of which has one zero: with ``count`` components no matrix is made, else one for each.
    """
    ids = nodes.select(F.col("entity").alias("i"), F.col("entity").alias("j"), F.lit(0.0).alias("w"))

    def values(rows: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(rows[["i", "j"]].to_numpy())
        rows = rows[(rows["i"] != rows["j"]) & (rows["w"] > 0)].groupby(["i", "j"], as_index=False)["w"].max()
        i, j, w = np.searchsorted(names, rows["i"].to_numpy()), np.searchsorted(names, rows["j"].to_numpy()), rows["w"].to_numpy()
        part = kernels.parts_of(len(names), i, j)
        found = np.zeros(part.max() + 1 if len(part) else 0)
        if len(found) < count:
            found = []
            for c in range(part.max() + 1 if len(part) else 0):
                own, inside = np.flatnonzero(part == c), part[i] == c
                a = np.zeros((len(own), len(own)))
                x, y = np.searchsorted(own, i[inside]), np.searchsorted(own, j[inside])
                np.maximum.at(a, (x, y), w[inside])
                found.append(kernels.laplacian_spectrum(np.maximum(a, a.T))[:count])
            found = np.sort(np.concatenate(found)) if found else np.zeros(0)
        found = found[:count]
        return pd.DataFrame({"place": np.arange(len(found)), "eigenvalue": found})

    return edges.select("i", "j", "w").unionByName(ids).withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(values, "place int, eigenvalue double")


def block_sums(edges: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """a, b, s: the weight between clusters, both directions, so that inner weight counts twice; only pairs that have any."""
    own = labels.select(*by, F.col("entity").alias("i"), F.col("label").alias("a"))
    other = labels.select(*by, F.col("entity").alias("j"), F.col("label").alias("b"))
    once = edges.join(own, [*by, "i"]).join(other, [*by, "j"]).groupBy(*by, "a", "b").agg(F.sum("w").alias("s"))
    flip = once.select(*by, F.col("b").alias("a"), F.col("a").alias("b"), "s")
    return once.unionByName(flip).groupBy(*by, "a", "b").agg(F.sum("s").alias("s"))


def block_sums_of_runs(edges: DataFrame, labels: DataFrame, by: Sequence[str]) -> DataFrame:
    """``block_sums`` of each period's one graph (period, i, j, w) under its many partitions (by, period, entity, label): its links are not copied to them."""
    types = dict(labels.dtypes)

    def sums(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        out = []
        for run, part in nodes.groupby(list(by)) if len(links) else ():
            part = part.sort_values("entity")
            ids, (names, which) = part["entity"].to_numpy(), np.unique(part["label"].to_numpy(), return_inverse=True)
            i, j = (np.minimum(np.searchsorted(ids, links[c].to_numpy()), len(ids) - 1) for c in "ij")
            both = (ids[i] == links["i"].to_numpy()) & (ids[j] == links["j"].to_numpy())
            cells, k = which[i[both]] * len(names) + which[j[both]], len(names)
            s, n = (np.bincount(cells, w, k * k).reshape(k, k) for w in (links["w"].to_numpy()[both], None))
            a, b = np.nonzero(n + n.T)
            out.append(pd.DataFrame({**dict(zip(by, run, strict=True)), "period": part["period"].iloc[0], "a": names[a], "b": names[b], "s": (s + s.T)[a, b]}))
        columns = [*by, "period", "a", "b", "s"]
        return pd.concat(out)[columns] if out else pd.DataFrame({c: nodes[c if c in nodes else "label"].iloc[:0] if c != "s" else np.zeros(0) for c in columns})

    left, right = labels.select(*by, "period", "entity", "label"), edges.select("period", "i", "j", "w")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, for the cogroup
    schema = ", ".join([*(f"{c} {types[c]}" for c in (*by, "period")), f"a {types['label']}, b {types['label']}, s double"])
    return dealt(left, "period").groupBy("period").cogroup(dealt(right, "period").groupBy("period")).applyInPandas(sums, schema)


def merged_small(edges: DataFrame, labels: DataFrame, min_size: int) -> DataFrame:
    """Labels where clusters below ``min_size`` join the large one they share most weight with, or the largest if none."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    large, small = sizes.filter(F.col("n") >= min_size), sizes.filter(F.col("n") < min_size)
    sums = block_sums(edges, labels)
    best = sums.join(small.select(F.col("label").alias("a")), "a").join(large.select(F.col("label").alias("b")), "b").groupBy("a").agg(F.max_by("b", F.struct("s", -F.col("b"))).alias("into"))
    largest = large.agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("largest"))
    mapping = sizes.join(best.withColumnRenamed("a", "label"), "label", "left").crossJoin(F.broadcast(largest))  # one row
    target = F.when(F.col("n") >= min_size, F.col("label")).otherwise(F.coalesce("into", "largest", "label"))
    return labels.join(F.broadcast(mapping.select("label", target.alias("_into"))), "label").withColumn("label", F.col("_into")).drop("_into")
