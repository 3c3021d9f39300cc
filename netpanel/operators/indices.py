"""Validity indices of partitions: of the network, from sums between clusters; of the features, from centres and distances."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netpanel.operators import kernels, vectors
from netpanel.operators.graphs import block_sums, block_sums_of_runs

#: Whether more is better.
DIRECTION = {"SW": 1, "CH": 1, "DBI": -1, "S_Dbw": -1, "AVI": 1, "AVU": -1, "ANUI": 1, "Q": 1, "MQ": 1, "TurboMQ": 1}


def _ratio(top: Column, low: Column) -> Column:
    return F.when(low > 0, top / low).otherwise(F.lit(0.0))


def cluster_table(sums: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """By cluster: n, row (all its weight), inner (weight within, counted twice), out."""
    return _cluster_table(sums, labels.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n")), by)


def _cluster_table(sums: DataFrame, sizes: DataFrame, by: Sequence[str]) -> DataFrame:
    rows = sums.groupBy(*by, F.col("a").alias("label")).agg(F.sum("s").alias("row"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("s"))), F.lit(0.0)).alias("inner"))
    out = sizes.join(rows, [*by, "label"], "left").fillna(0.0, ["row", "inner"])
    return out.withColumn("out", F.col("row") - F.col("inner"))


def graph_indices(edges: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AVI, AVU, AVU_pair, ANUI, Q, Q_density, TurboMQ, MQ_basic of each graph (``by``) and its partition."""
    return indices_of_sums(block_sums(edges, labels, by), labels.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n")), by)


def indices_of_runs(edges: DataFrame, labels: DataFrame, by: Sequence[str]) -> DataFrame:
    """``graph_indices`` of each period's one graph under its many partitions (by, period, entity, label)."""
    key = [*by, "period"]
    return indices_of_sums(block_sums_of_runs(edges, labels, by), labels.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("n")), key)


def indices_of_sums(sums: DataFrame, sizes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same from the sums between clusters (``graphs.block_sums``) and the clusters' sizes (label, n)."""
    clusters = _cluster_table(sums, sizes, by)
    whole = clusters.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum("row").alias("m2"))
    q = clusters.join(whole, list(by)) if by else clusters.crossJoin(F.broadcast(whole))  # one row
    n = F.col("n").cast("double")
    share = lambda top, low: F.when(low > 0, top / low).otherwise(0.0)
    one = q.groupBy(*by).agg(
        F.first("k").alias("k"),
        F.avg(_ratio(F.col("inner"), F.col("row"))).alias("AVI"),
        F.sum(_ratio(F.col("inner"), F.col("row"))).alias("TurboMQ"),
        F.sum(F.when(F.col("m2") > 0, F.col("inner") / F.col("m2") - (F.col("row") / F.col("m2")) * (F.col("row") / F.col("m2"))).otherwise(0.0)).alias("Q"),
        F.sum(F.when(F.col("m2") > 0, (F.col("inner") / 2 - F.col("row") * F.col("row") / (2 * F.col("m2"))) / n).otherwise(0.0)).alias("Q_density"),
        F.avg(share(F.col("inner") / 2, n * (n - 1) / 2)).alias("_intra"),
    )
    slim = clusters.select(*by, F.col("label").alias("_l"), F.col("out").alias("_o"), F.col("n").alias("_n"))
    a = slim.select(*by, F.col("_l").alias("a"), F.col("_o").alias("oa"), F.col("_n").alias("na"))
    b = slim.select(*by, F.col("_l").alias("b"), F.col("_o").alias("ob"), F.col("_n").alias("nb"))
    pairs = sums.filter("a != b").join(a, [*by, "a"]).join(b, [*by, "b"])
    low = F.col("oa") + F.col("ob") - F.col("s")
    two = pairs.groupBy(*by).agg(F.sum(_ratio(F.col("s"), low)).alias("_u"), (F.sum(F.col("s") / (F.col("na") * F.col("nb"))) / 2).alias("_inter"))
    out = one.join(two, list(by), "left") if by else one.crossJoin(two)
    k = F.col("k")
    avu = F.when(k > 1, F.coalesce("_u", F.lit(0.0)) / k).otherwise(0.0)
    pair = F.when(k > 1, F.coalesce("_u", F.lit(0.0)) / (k * (k - 1))).otherwise(0.0)
    inter = F.when(k > 1, F.coalesce("_inter", F.lit(0.0)) / (k * (k - 1) / 2)).otherwise(0.0)
    out = out.withColumns({"AVU": avu, "AVU_pair": pair, "MQ_basic": F.col("_intra") - inter})
    return out.withColumn("ANUI", F.when(F.col("AVI") > 0, 1 / (F.col("AVU") + 1 / F.col("AVI"))).otherwise(0.0)).drop("_u", "_inter", "_intra")


def expected_at_random(k: Column) -> tuple[Column, Column]:
    """Expected AVI and AVU of a random partition into k clusters."""
    return 1 / k, F.when(k > 1, (k - 1) / (2 * k - 3))


def silhouettes(points: DataFrame) -> DataFrame:
    """entity, label, silhouette (exact, Euclidean; 0 for a cluster of one)."""
    sums = vectors.distance_sums(points)
    own = F.max(F.when(F.col("other") == F.col("label"), F.when(F.col("n") > 0, F.col("total") / F.col("n"))))
    near = F.min(F.when((F.col("other") != F.col("label")) & (F.col("n") > 0), F.col("total") / F.col("n")))
    rows = sums.groupBy("entity", "label").agg(own.alias("a"), near.alias("b"))
    top = F.greatest("a", "b")
    return rows.select("entity", "label", F.when(F.col("a").isNull() | F.col("b").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top).alias("silhouette"))


def _spread(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Centres with sizes; and every point with its own centre and squared distance."""
    centres = vectors.centres(points)
    own = points.join(F.broadcast(centres.withColumnRenamed("n", "_n")), "label").withColumn("_d2", vectors.squared_distance("x", "centre"))
    return centres, own


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """Between over within spread, each by its degrees of freedom; and by the number of points. One row."""
    centres, own = _spread(points)
    within = own.agg(F.sum("_d2").alias("w"), F.count(F.lit(1)).alias("n"))
    overall = vectors.centres(points.withColumn("_one", F.lit(1)), ["_one"]).select(F.col("centre").alias("_all"))
    between = centres.crossJoin(F.broadcast(overall)).agg(F.sum(F.col("n") * vectors.squared_distance("centre", "_all")).alias("b"), F.count(F.lit(1)).alias("k"))  # one row
    ch = (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))
    return within.crossJoin(between).select("k", "n", ch.alias("CH"), (ch / F.col("n")).alias("CH_n"))


def davies_bouldin(points: DataFrame) -> DataFrame:
    """Mean over clusters of the worst ratio of spreads to the distance of centres. One row."""
    centres, own = _spread(points)
    spread = own.groupBy("label").agg(F.avg(F.sqrt("_d2")).alias("s"))
    rows = centres.join(spread, "label")
    a, b = rows.select(F.col("label").alias("a"), F.col("centre").alias("ca"), F.col("s").alias("sa")), rows.select(F.col("label").alias("b"), F.col("centre").alias("cb"), F.col("s").alias("sb"))
    worst = a.join(F.broadcast(b), F.col("a") != F.col("b")).groupBy("a").agg(F.max((F.col("sa") + F.col("sb")) / vectors.distance("ca", "cb")).alias("r"))  # K x K rows
    return worst.agg(F.avg("r").alias("DBI"))


def s_dbw(points: DataFrame, package: bool = False) -> DataFrame:
    """S_Dbw: mean scatter of the clusters and density between them. One row: scatter, density, S_Dbw.

    The radius is the root of the summed lengths of the clusters' variance vectors, over their number; density counts
    the points of the two clusters. ``package``: standard deviations instead of variances, and a centre's density
    counts its own cluster's points alone.
    """
    norm = lambda c: F.sqrt(F.aggregate(F.transform(c, lambda v: (v if package else v * v)), F.lit(0.0), lambda s, v: s + v))
    per = vectors.variances(points, ["label"]).select("label", norm("v").alias("s"))
    whole = vectors.variances(points.withColumn("_one", F.lit(1)), ["_one"]).select(norm("v").alias("all_s"))
    stats = per.agg(F.avg("s").alias("mean_s"), F.count(F.lit(1)).alias("k"), F.sum("s").alias("sum_s"))
    radius = F.sqrt("sum_s") / F.col("k")
    scalars = stats.crossJoin(whole).select("k", (F.col("mean_s") / F.col("all_s")).alias("scatter"), radius.alias("radius"))  # one row each
    centres = vectors.centres(points).select("label", "centre")
    a, b = centres.select(F.col("label").alias("a"), F.col("centre").alias("ca")), centres.select(F.col("label").alias("b"), F.col("centre").alias("cb"))
    middle = a.join(F.broadcast(b), F.col("a") < F.col("b")).withColumn("m", F.zip_with("ca", "cb", lambda x, y: (x + y) / 2))  # K x K rows
    met = points.select("label", "x").crossJoin(F.broadcast(scalars.select("radius"))).join(F.broadcast(middle), (F.col("label") == F.col("a")) | (F.col("label") == F.col("b")))
    inside = lambda c: F.sum((vectors.distance("x", c) <= F.col("radius")).cast("int"))
    own = lambda side, c: F.sum(((F.col("label") == F.col(side)) & (vectors.distance("x", c) <= F.col("radius"))).cast("int"))
    counts = met.groupBy("a", "b").agg(inside("m").alias("dm"), (own("a", "ca") if package else inside("ca")).alias("da"), (own("b", "cb") if package else inside("cb")).alias("db"))
    density = counts.withColumn("r", _ratio(F.col("dm"), F.greatest("da", "db"))).agg(F.sum("r").alias("r"))
    out = scalars.crossJoin(density)  # one row each
    dens = F.when(F.col("k") > 1, F.coalesce("r", F.lit(0.0)) * 2 / (F.col("k") * (F.col("k") - 1))).otherwise(0.0)
    return out.select("scatter", dens.alias("density"), (F.col("scatter") + dens).alias("S_Dbw"))


def adjusted_rand(pairs: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Agreement of two partitions of the same entities, corrected for chance."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = pairs.groupBy(*by, a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows, cols = cells.groupBy(*by, a).agg(F.sum("n").alias("n")), cells.groupBy(*by, b).agg(F.sum("n").alias("n"))
    parts = [cells.groupBy(*by).agg(two("n").alias("s"), F.sum("n").alias("total")), rows.groupBy(*by).agg(two("n").alias("ra")), cols.groupBy(*by).agg(two("n").alias("rb"))]
    out = parts[0].join(parts[1], list(by)).join(parts[2], list(by)) if by else parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each
    expected = F.col("ra") * F.col("rb") / (F.col("total") * (F.col("total") - 1) / 2)
    most = (F.col("ra") + F.col("rb")) / 2
    return out.select(*by, F.when(most == expected, 1.0).otherwise((F.col("s") - expected) / (most - expected)).alias("ari"))


def normalised_mutual_information(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information over the mean of both entropies. One row."""
    cells = pairs.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = cells.agg(F.sum("n").alias("t"))
    entropy = lambda df, name: df.crossJoin(F.broadcast(total)).agg((-F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") / F.col("t")))).alias(name))
    parts = [entropy(cells, "hab"), entropy(cells.groupBy(a).agg(F.sum("n").alias("n")), "ha"), entropy(cells.groupBy(b).agg(F.sum("n").alias("n")), "hb")]
    out = parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each
    return out.select(F.when(F.col("ha") + F.col("hb") > 0, 2 * (F.col("ha") + F.col("hb") - F.col("hab")) / (F.col("ha") + F.col("hb"))).otherwise(1.0).alias("nmi"))


def oriented(metrics: DataFrame) -> DataFrame:
    """Long metrics (metric, value) with ``oriented``: more is better."""
    table = metrics.sparkSession.createDataFrame([(m, float(d)) for m, d in DIRECTION.items()], "metric string, direction double")
    return metrics.join(F.broadcast(table), "metric").withColumn("oriented", F.col("value") * F.col("direction")).drop("direction")


def feature_panel(points: DataFrame, found: DataFrame) -> DataFrame:
    """method, k, period, metric, value: SW, CH, CH_n, DBI and S_Dbw of every partition (method, k, period, entity, label), NULL where undefined.

    A period's points (period, entity, x) go to one task once, whatever the number of its partitions.
    """

    def measure(nodes: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(nodes) and len(rows):
            nodes = nodes.sort_values("entity")
            ids, x = nodes["entity"].to_numpy(), np.array(nodes["x"].tolist(), float)
            alike: dict[bytes, list] = {}  # partitions of the same points
            for (method, k), part in rows.groupby(["method", "k"]):
                part = part[part["entity"].isin(ids)].sort_values("entity")
                if len(part):
                    alike.setdefault(np.searchsorted(ids, part["entity"].to_numpy()).tobytes(), []).append((method, int(k), part["label"].to_numpy()))
            for places, runs in alike.items():
                for (method, k, _), values in zip(runs, kernels.feature_panel(x[np.frombuffer(places, int)], [r[2] for r in runs]), strict=True):
                    out += [(method, k, int(rows["period"].iloc[0]), m, v) for m, v in values.items()]
        return pd.DataFrame(out, columns=["method", "k", "period", "metric", "value"]).astype({"value": "float64"})

    left, right = points.select("period", "entity", "x"), found.select("method", "k", "period", "entity", "label")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    out = left.groupBy("period").cogroup(right.groupBy("period")).applyInPandas(measure, "method string, k int, period long, metric string, value double")
    return out.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
