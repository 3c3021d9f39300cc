"""The study from a long panel to ranked methods, followed types and their explanation: compositions of the operators.

Each stage takes and returns tables; what is dear to compute is kept (persisted) by its caller or saved by
``sources.sinks``. Parameters come from ``config``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netpanel.config import Config
from netpanel.operators import clustering, graphs, indices, interpret, labels, panel, stats, vectors
from netpanel.session import kept


@dataclass
class FeatureSet:
    raw: DataFrame
    members: DataFrame
    points: DataFrame  # period, entity, x
    growth: DataFrame
    names: list[str]


def build_features(long: DataFrame, named: Sequence[str], config: Config, drop: DataFrame | None = None) -> FeatureSet:
    """Raw features of all entities; scores and growth of the panel's, with moments over all entities."""
    c = config.features
    raw = panel.raw_features(long, named, c.total, c.residual, c.pseudocount, c.level_weight)
    names = [*(f"clr_{n}" for n in (*named, c.residual)), "log_level_rel"]
    members = panel.full_history(raw, c.min_periods, drop)
    scores = panel.features(raw, names, c.smoothing_window, members)
    points = vectors.complete(scores.select("period", "entity", F.array(*names).alias("x")))
    return FeatureSet(raw, members, points, panel.log_growth(panel.in_panel(raw, members), c.total), names)


def build_layers(features: FeatureSet, distances: DataFrame | None, config: Config, places: DataFrame | None = None, per_km: float = 1.0) -> DataFrame:
    """layer, period, i, j, w: behaviour, comovement, gravity (if there are distances, or places on a line) and their fusion, for every period at once."""
    g = config.graphs
    pick = ["layer", "period", "i", "j", "w"]
    near = graphs.behaviour_layer(features.points, g.k, g.local_scale_k, g.mutual, g.add_mst, ["period"]).withColumn("layer", F.lit("behaviour"))
    windows = panel.growth_window(features.growth, g.comovement_window, g.comovement_min)
    together = clustering.comovement_layer(windows, g.k, g.comovement_lags).withColumnRenamed("t", "period").withColumn("layer", F.lit("comovement"))
    parts = [near.select(pick), together.select(pick)]
    if distances is not None or places is not None:
        periods = features.points.select("period").distinct()
        if places is not None:
            far = graphs.gravity_line(places, g.k, g.gravity_scale_km, per_km, zero_km=config.features.zero_distance_km)
        else:
            known = distances.withColumn("km", F.when(F.col("km") > 0, F.col("km")).otherwise(config.features.zero_distance_km))
            far = graphs.gravity_layer(known, g.k, g.gravity_scale_km)
        far = far.crossJoin(F.broadcast(periods))  # the calendar
        parts.append(far.withColumn("layer", F.lit("gravity")).select(pick))
    layers = kept(reduce(lambda a, b: a.unionByName(b), parts))
    fused = clustering.fused_layer(layers, g.k, g.fusion_rounds, g.fusion_alpha).withColumn("layer", F.lit("fused"))
    return layers.unionByName(fused.select(pick))


def cluster(features: FeatureSet, layers: DataFrame, methods: Sequence[str], config: Config, layer: str | None = None) -> DataFrame:
    """method, k, period, entity, label, seconds on the primary layer (or the one named)."""
    edges = layers.filter(F.col("layer") == (layer or config.graphs.primary))
    return clustering.grid(features.points, edges, methods, config.methods.k_grid, config.methods.seed)


def evaluate(features: FeatureSet, edges: DataFrame, found: DataFrame) -> DataFrame:
    """method, k, period, metric, value of all indices for every partition: of the network in one aggregation, of the features period by period."""
    key = ["method", "asked", "period"]  # the indices have a k of their own: the clusters found
    found = found.withColumnRenamed("k", "asked")
    table = indices.indices_of_runs(edges, found, key[:2])
    network = table.unpivot(key, ["AVI", "AVU", "ANUI", "Q", "Q_density", "TurboMQ", "MQ_basic"], "metric", "value").withColumnRenamed("asked", "k")
    return network.unionByName(indices.feature_panel(features.points, found.withColumnRenamed("asked", "k")))


def fixed_k(metrics: DataFrame, k: int) -> DataFrame:
    """method, metric, value (median over periods) and iqr at one k."""
    return panel.median_iqr(metrics.filter(F.col("k") == k), ["method", "metric"]).withColumnRenamed("median", "value")


def best_k(metrics: DataFrame) -> DataFrame:
    """method, metric, k, value (median over periods) of the k that serves each method's metric best; the smaller on ties."""
    every = indices.oriented(panel.median_iqr(metrics, ["method", "metric", "k"]).withColumnRenamed("median", "value").filter("value is not null"))
    best = F.struct((-F.col("oriented")).alias("o"), F.col("k"))
    return every.groupBy("method", "metric").agg(F.min_by("k", best).alias("k"), F.min_by("value", best).alias("value"))


def paired(metrics: DataFrame, config: Config) -> DataFrame:
    """By metric and pair of methods: the bootstrap of the difference over periods at the fixed k, more being better."""
    rows = indices.oriented(metrics.filter((F.col("k") == config.methods.k) & F.col("value").isNotNull()))
    place = F.dense_rank().over(Window.partitionBy("metric").orderBy("period")) - 1  # periods of one metric
    rows = kept(rows.select("metric", place.alias("row"), "method", F.col("oriented").alias("value")))
    one = lambda m: stats.paired_bootstrap(rows.filter(F.col("metric") == m).drop("metric"), config.compare.bootstrap).select(F.lit(m).alias("metric"), "*")
    return reduce(lambda x, y: x.unionByName(y), map(one, RANKED))


#: The metrics that rank methods; the others are variants of these.
RANKED = ("SW", "CH", "S_Dbw", "AVI", "AVU", "ANUI", "Q")


def compare(metrics: DataFrame, config: Config) -> DataFrame:
    """method, score (Borda), rank (threshold rule) and grades, at the fixed k."""
    table = fixed_k(metrics, config.methods.k).filter(F.col("metric").isin(*RANKED)).select("method", "metric", "value")
    return stats.borda(table).join(stats.threshold_rank(table, config.compare.grades), "method")


def through_labels(found: DataFrame, reference: int) -> DataFrame:
    """period, entity, label: names that go through time, numbered by size in a reference period."""
    aligned = labels.align_sequence(found.select("period", "entity", "label"))
    rows = labels.renumbered(aligned.select("period", "entity", F.col("aligned").alias("label")), reference)
    return rows.select("period", "entity", F.col("number").alias("label"))


def follow(series: DataFrame, config: Config) -> dict[str, DataFrame]:
    """What the types do: transitions, confirmed series and events, decomposition, life cycle, sizes, trajectories."""
    d = config.dynamics
    confirmed = labels.confirmed_series(series, d.min_run)
    sure = confirmed.select("entity", "period", F.col("confirmed").alias("label"))
    return {
        "transitions": labels.transitions(series, 1),
        "transitions_confirmed": labels.transitions(sure, 1),
        "confirmed": confirmed,
        "events": labels.confirmed_changes(series, d.min_run),
        "decomposition": labels.change_decomposition(series, d.min_run),
        "lifecycle": labels.lifecycle(series, d.match_threshold),
        "sizes": labels.sizes_over_time(series),
        "trajectories": labels.trajectories(sure),
    }


def dynamics_summary(series: DataFrame, config: Config) -> dict[str, Any]:
    """A small document: mobility at lags 1 and 12, stability, changes by kind."""
    d = config.dynamics
    sure = labels.confirmed_series(series, d.min_run).select("entity", "period", F.col("confirmed").alias("label"))
    mobility = {name: {lag: labels.shorrocks(labels.transitions(rows, lag)).first().mobility for lag in (1, 12)} for name, rows in (("raw", series), ("confirmed", sure))}
    stable = {name: labels.n_changes(rows).agg(F.avg((F.col("n_changes") == 0).cast("int"))).first()[0] for name, rows in (("raw", series), ("confirmed", sure))}
    kinds = {r.kind: r["count"] for r in labels.confirmed_changes(series, d.min_run).groupBy("kind").count().collect()}
    total = labels.change_decomposition(series, d.min_run).filter("period is null").first()
    return {"mobility": mobility, "never_changed": stable, "events": kinds, "changes": total.asDict() if total else {}}


def explain(features: FeatureSet, series: DataFrame, config: Config) -> dict[str, DataFrame]:
    """Profiles of the types: spread explained, leading features, medians, typical and border members in the last period."""
    rows = features.points.select("period", "entity", "x", *[F.col("x")[k].alias(n) for k, n in enumerate(features.names)]).join(series, ["period", "entity"])
    profile = interpret.mirkin_profile(rows, features.names)
    last = rows.agg(F.max("period").alias("period"))
    members = rows.join(F.broadcast(last), "period").select("entity", "label", "x")  # one row
    margins = vectors.membership_margin(members, vectors.centres(members))
    return {
        "profile": profile,
        "spread": interpret.spread_totals(rows, features.names),
        "leading": interpret.top_features(profile, config.interpret.top),
        "members": vectors.typical_and_border(margins, config.interpret.typical),
    }


def entity_table(series: DataFrame, margins: DataFrame, dictionary: DataFrame) -> DataFrame:
    """A wide row for each entity: its modal type and share, trajectory, margin, and what the dictionary says."""
    modal = labels.modal_label(series).withColumnRenamed("label", "modal").withColumnRenamed("share", "modal_share")
    return labels.trajectories(series).join(modal, "entity", "left").join(margins.select("entity", "d_own", "d_other", "margin"), "entity", "left").join(dictionary, "entity", "left")
