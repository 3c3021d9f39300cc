"""Points as arrays: distances, centres, nearest centres, and exact neighbours in blocks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netpanel.operators import kernels
from netpanel.session import dealt

#: Points of a block of exact comparisons.
BLOCK = 2000


def squared_distance(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(squared_distance(a, b))


def complete(points: DataFrame, x: str = "x") -> DataFrame:
    """Points without a missing component."""
    return points.filter(F.col(x).isNotNull() & ~F.exists(x, lambda v: v.isNull()))


def centres(points: DataFrame, by: Sequence[str] = ("label",), x: str = "x") -> DataFrame:
    """The mean point and the number of complete points of each group, in one aggregation."""
    return complete(points, x).groupBy(*by).agg(vector_to_array(Summarizer.mean(array_to_vector(x))).alias("centre"), F.count(F.lit(1)).alias("n"))


def variances(points: DataFrame, by: Sequence[str] = (), x: str = "x") -> DataFrame:
    """Population variance by component of each group."""
    out = complete(points, x).groupBy(*by).agg(vector_to_array(Summarizer.variance(array_to_vector(x))).alias("v"), F.count(F.lit(1)).alias("n"))
    ratio = F.when(F.col("n") > 0, (F.col("n") - 1) / F.col("n"))
    return out.withColumn("v", F.transform("v", lambda e: e * ratio))


def to_centres(points: DataFrame, centre_rows: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Every point with ``met``: (d, centre_label) of all centres, nearest first, ties by label. Centres (label, centre) are few: one broadcast array of K,
    or one for each value of ``on``; points stay where they are."""
    arrays = centre_rows.groupBy(*on).agg(F.collect_list(F.struct(F.col("label").alias("centre_label"), "centre")).alias("_c"))
    joined = points.join(F.broadcast(arrays), list(on)) if on else points.crossJoin(F.broadcast(arrays))  # one row
    met = F.transform("_c", lambda c: F.struct(distance("x", c["centre"]).alias("d"), c["centre_label"].alias("centre_label")))
    return joined.filter(F.size("_c") > 0).withColumn("met", F.array_sort(met)).drop("_c")


def nearest_centre(points: DataFrame, centre_rows: DataFrame, keys: Sequence[str] = ("entity",), on: Sequence[str] = ()) -> DataFrame:
    """keys, nearest (label; the smaller on ties), d1, d2, margin = (d2 - d1) / d1 cut at 1 (1 if there is no second); a row for each point."""
    rows = to_centres(points, centre_rows, on)
    d1, second = F.col("met")[0]["d"], F.when(F.size("met") > 1, F.element_at("met", 2)["d"])
    margin = F.when(second.isNull(), 1.0).when(d1 > 0, F.least(F.lit(1.0), (second - d1) / d1)).when(second > 0, 1.0).otherwise(0.0)
    return rows.select(*keys, F.col("met")[0]["centre_label"].alias("nearest"), d1.alias("d1"), second.alias("d2"), margin.alias("margin"))


def membership_margin(points: DataFrame, centre_rows: DataFrame) -> DataFrame:
    """entity, label, d_own, d_other, margin = (other - own) / (other + own) in -1 .. 1, 1 if both are 0."""
    first = lambda own: F.filter("met", lambda m: (m["centre_label"] == F.col("label")) if own else (m["centre_label"] != F.col("label")))[0]["d"]
    rows = to_centres(points, centre_rows).select("entity", "label", first(True).alias("d_own"), first(False).alias("d_other"))
    total = F.col("d_own") + F.col("d_other")
    return rows.withColumn("margin", F.when(total > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("d_other") - F.col("d_own")) / total))).otherwise(F.lit(1.0)))


def typical_and_border(margins: DataFrame, n: int = 3) -> DataFrame:
    """By label the n rows nearest to their own centre and the n of least margin, with their places."""
    typical = Window.partitionBy("label").orderBy("d_own", "entity")
    border = Window.partitionBy("label").orderBy("margin", "entity")
    rows = [margins.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("label", F.lit(kind).alias("kind"), "place", "entity", "d_own", "margin") for w, kind in ((typical, "typical"), (border, "border"))]
    return rows[0].unionByName(rows[1])


def _blocked(points: DataFrame, by: Sequence[str], block: int, width: int | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Points dealt to block pairs (left block, right block) within a group; the numbers of blocks come from the group's size. Right blocks may be wider."""
    blocks = lambda size: F.greatest(F.ceil(F.count(F.lit(1)) / size).cast("int"), F.lit(1))
    sizes = (points.groupBy(*by) if by else points).agg(blocks(block).alias("_ls"), blocks(width or block).alias("_rs"))
    rows = points.join(F.broadcast(sizes), list(by)) if by else points.crossJoin(F.broadcast(sizes))
    own = lambda n: F.pmod(F.xxhash64("entity"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.withColumn("_l", own("_ls")).withColumn("_r", every("_rs")).drop("_ls", "_rs")
    right = rows.withColumn("_r", own("_rs")).withColumn("_l", every("_ls")).drop("_ls", "_rs")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, for the cogroup
    return left, right, [*by, "_l", "_r"]


def neighbours(points: DataFrame, k: int, by: Sequence[str] = (), block: int | None = None, width: int = 32 * BLOCK) -> DataFrame:
    """by, i, j, d, rank: the k nearest others of each point within its group, exactly; ties to the smaller id.

    A task compares ``block`` points with ``width`` others, near ones first; a point's nearest of each are merged. Of several groups a task has
    as many points as others: it makes its parts of the others once, and no row is copied to a group's blocks.
    """
    left, right, key = _blocked(points.select(*by, "entity", "x"), by, block or (width if by else 2 * BLOCK), width)

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({**{c: a[c].iloc[:0] for c in by}, "i": np.zeros(0, int), "j": np.zeros(0, int), "d": np.zeros(0)})
        b = b.sort_values("entity")
        i, j, d = kernels.nearest(a["entity"].to_numpy(), np.array(a["x"].tolist(), float), b["entity"].to_numpy(), np.array(b["x"].tolist(), float), k)
        return pd.DataFrame({**{c: a[c].iloc[0] for c in by}, "i": i, "j": j, "d": d})

    types = dict(points.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in by), "i long, j long, d double"])
    found = dealt(left, *key).groupBy(*key).cogroup(dealt(right, *key).groupBy(*key)).applyInPandas(compare, schema)
    order = Window.partitionBy(*by, "i").orderBy("d", "j")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def distance_sums(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """entity, label, other (label), total and n: the sum of distances from each point to the points of each label."""
    left, right, key = _blocked(points.select("entity", "label", "x"), (), block)

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"entity": [], "label": [], "other": [], "total": [], "n": []}).astype({"entity": "int64", "label": "int32", "other": "int32", "total": "float64", "n": "int64"})
        x, y = np.array(a["x"].tolist(), float), np.array(b["x"].tolist(), float)
        labels, which = np.unique(b["label"].to_numpy(), return_inverse=True)
        one = np.zeros((len(y), len(labels)))
        one[np.arange(len(y)), which] = 1
        total = np.zeros((len(x), len(labels)))
        for s in range(0, len(x), 128):
            d = np.sqrt(np.maximum(((x[s : s + 128, None] - y[None]) ** 2).sum(-1), 0)) if x.shape[1] * len(y) * 128 < 5e7 else np.sqrt(np.maximum((x[s : s + 128] ** 2).sum(1)[:, None] + (y**2).sum(1) - 2 * x[s : s + 128] @ y.T, 0))
            total[s : s + 128] = d @ one
        same = a["entity"].to_numpy()[:, None] == b["entity"].to_numpy()
        count = (~same).astype(float) @ one
        n = len(labels)
        return pd.DataFrame({"entity": np.repeat(a["entity"].to_numpy(), n), "label": np.repeat(a["label"].to_numpy(), n), "other": np.tile(labels, len(a)), "total": total.ravel(), "n": count.ravel().astype("int64")})

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(sums, "entity long, label int, other int, total double, n long")
    return found.groupBy("entity", "label", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))

