"""What the types are: profiles, names by rules, external checks, a surrogate tree, summary documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netpanel.operators import stats

ALL = "all"


def _long(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), list(columns), "feature", "value")


def mirkin_profile(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """By label and feature: n, share, mean, global mean, relative deviation, contribution, and its per cent of all and of the explained spread."""
    rows = _long(df, columns, [label])
    whole = rows.groupBy("feature").agg(F.avg("value").alias("global_mean"), F.stddev_pop("value").alias("_sd"), F.var_pop("value").alias("_var"), F.count(F.lit(1)).alias("_all"))
    own = rows.groupBy(label, "feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    joined = own.join(F.broadcast(whole), "feature")  # a row for each feature
    dev = F.col("mean") - F.col("global_mean")
    sd = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    rel = F.when(F.abs("global_mean") < 1e-6 * sd, dev / sd).otherwise(dev / F.abs("global_mean"))
    table = joined.withColumns({"share": F.col("n") / F.col("_all"), "rel_dev": rel, "contrib": F.col("n") * dev * dev})
    totals = whole.agg(F.sum(F.col("_var") * F.col("_all")).alias("_T")).crossJoin(table.agg(F.sum("contrib").alias("_B")))  # one row each
    out = table.crossJoin(F.broadcast(totals))
    pct = lambda t: F.when(F.col(t) > 0, 100 * F.col("contrib") / F.col(t))
    return out.select(label, "feature", "n", "share", "mean", "global_mean", "rel_dev", "contrib", pct("_T").alias("contrib_pct_T"), pct("_B").alias("contrib_pct_B"))


def spread_totals(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """T, B, W and B / T: all spread, what the labels explain, and the rest. One row."""
    rows = _long(df, columns, [label])
    total = rows.groupBy("feature").agg((F.var_pop("value") * F.count(F.lit(1))).alias("t")).agg(F.sum("t").alias("T"))
    within = rows.groupBy(label, "feature").agg((F.var_pop("value") * F.count(F.lit(1))).alias("w")).agg(F.sum("w").alias("W"))
    out = total.crossJoin(within).withColumn("B", F.col("T") - F.col("W"))  # one row each
    return out.withColumn("B_over_T", F.when(F.col("T") > 0, F.col("B") / F.col("T")))


def top_features(profile: DataFrame, n: int = 3, label: str = "label") -> DataFrame:
    """By label the n features that contribute most, with the sign of their deviation."""
    order = Window.partitionBy(label).orderBy(F.desc("contrib"), "feature")
    rows = profile.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    return rows.select(label, "place", "feature", F.when(F.col("rel_dev") >= 0, "+").otherwise("-").alias("sign"), "contrib_pct_B")


def readable_profile(df: DataFrame, shares: Sequence[str], levels: Sequence[str], label: str = "label") -> DataFrame:
    """Medians by label and over all (label NULL), in one pass: shares in per cent, levels as they are and in per cent of the overall median."""
    medians = [F.median(F.col(c) * 100).alias(f"{c}_pct") for c in shares] + [F.median(c).alias(c) for c in levels]
    rows = df.rollup(label).agg(F.count(F.lit(1)).alias("n"), *medians)
    overall = df.agg(*[F.median(c).alias(f"_{c}") for c in levels])
    out = rows.crossJoin(F.broadcast(overall))  # one row
    return out.withColumns({f"{c}_rel_pct": F.when(F.col(f"_{c}") != 0, 100 * F.col(c) / F.col(f"_{c}")) for c in levels}).drop(*[f"_{c}" for c in levels])


def numeric_validation(df: DataFrame, variables: Sequence[str], label: str = "label") -> DataFrame:
    """Kruskal-Wallis of each variable by label, strongest first, undefined last."""
    found = stats.kruskal(_long(df, variables, [label]), "value", label, ["feature"])
    return found.orderBy(F.desc_nulls_last("eta2"), "feature")


def categorical_validation(df: DataFrame, variables: Sequence[str], label: str = "label", min_size: int = 5) -> DataFrame:
    """Cramer's V of each variable by label, rare categories as one, strongest first."""
    from netpanel.operators.external import collapse_rare

    parts = []
    for v in variables:
        rows = collapse_rare(df.select(label, F.col(v).cast("string").alias("_c")).filter("_c is not null"), "_c", min_size)
        parts.append(stats.cramers_v(rows, "_c", label).select(F.lit(v).alias("feature"), "*"))
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy(F.desc_nulls_last("V"), "feature")


def medians_by_type(df: DataFrame, variables: Sequence[str], label: str = "label") -> DataFrame:
    return _long(df, variables, [label]).groupBy(label, "feature").agg(F.median("value").alias("median"), F.count("value").alias("n"))


def _limits(rule: Mapping[str, Any], thresholds: Mapping[str, float]) -> list[tuple[str, str, float]]:
    """(feature, side, number) of a rule's conditions, with named thresholds as their numbers."""
    given = [(f, side, limits[side]) for f, limits in rule.get("when", {}).items() for side in ("min", "max") if side in limits]
    return [(f, side, float(thresholds.get(v, v))) for f, side, v in given]


#: What the second and further types of one rule get after their name; the last one stays from there on.
NUMERALS = ("", " II", " III", " IV", " V", " VI", " VII", " VIII")


def rule_names(means: DataFrame, rules: Sequence[Mapping[str, Any]], thresholds: Mapping[str, float], label: str = "label", leading: DataFrame | None = None, phrases: DataFrame | None = None, fallback: str = "Type") -> DataFrame:
    """label, name, short, description, rule: by the first rule all of whose conditions a label's means satisfy.

    ``means`` has a column for each feature. A rule: {"name": ..., "short": ..., "description": ..., "when": {feature: {"min": number or threshold's name,
    "max": ...}}}. The first label of a rule, in their order, has its plain name, the next ones get a numeral. A label that no rule fits is called
    by its number and its leading features (``leading``, as ``top_features`` gives them). ``phrases`` (label, phrase) end the descriptions.
    """
    chosen = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        tests = [F.lit(f in means.columns) & ((F.col(f) >= v) if side == "min" else (F.col(f) <= v)) if f in means.columns else F.lit(False) for f, side, v in _limits(rule, thresholds)]
        chosen = F.when(F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False)), F.lit(k)).otherwise(chosen)
    rows = means.withColumn("_rule", chosen)
    if leading is not None:
        words = F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("place", "feature", "sign"))), lambda x: F.concat(x["feature"], F.lit(" "), x["sign"])))
        rows = rows.join(leading.groupBy(label).agg(words.alias("_features")), label, "left")
    else:
        rows = rows.withColumn("_features", F.lit(None).cast("string"))
    rows = rows.join(phrases.select(label, F.col("phrase").alias("_phrase")), label, "left") if phrases is not None else rows.withColumn("_phrase", F.lit(None).cast("string"))
    numeral = F.element_at(F.array(*map(F.lit, NUMERALS)), F.least(F.row_number().over(Window.partitionBy("_rule").orderBy(label)), F.lit(len(NUMERALS))))
    pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values], F.lit(None).cast("string")), F.col("_rule") + 1)
    plain = F.concat(F.lit(f"{fallback} "), F.col(label).cast("string"))
    by_rule = F.col("_rule").isNotNull()
    name = F.when(by_rule, F.concat(pick([r["name"] for r in rules]), numeral)).otherwise(F.concat_ws(": ", plain, F.nullif("_features", F.lit(""))))
    short = F.when(by_rule, F.concat(pick([r.get("short", r["name"]) for r in rules]), numeral)).otherwise(plain)
    said = F.when(by_rule, F.nullif(pick([r.get("description") for r in rules]), F.lit(""))).when(F.coalesce("_features", F.lit("")) != "", F.concat(F.lit("Leading features: "), F.col("_features"), F.lit(".")))
    return rows.select(label, name.alias("name"), short.alias("short"), F.concat_ws(" ", said, "_phrase").alias("description"), pick([r["name"] for r in rules]).alias("rule"))


def split_names(names: Sequence[str], levels: Sequence[str] | None = None) -> tuple[list[str], list[str]]:
    """Raw features as (shares, levels): by the list given, else those whose names speak of a level or a total."""
    levels = [n for n in names if any(w in n.lower() for w in ("level", "total"))] if levels is None else list(levels)
    return [n for n in names if n not in levels], levels


def display_names(names: Sequence[str], levels: Sequence[str] | None = None, unit: str = "", level_name: str = "Total per head") -> list[str]:
    """Names with units, in their order: shares in per cent, levels in theirs; a single level has a name of its own."""
    _, own = split_names(names, levels)
    of_level = lambda n: ", ".join(x for x in (level_name if len(own) == 1 else n, unit) if x)
    return [of_level(n) if n in own else f"Share of {n.replace('share_', '')}, %" for n in names]


def phrases(readable: DataFrame, shares: Sequence[str], levels: Sequence[str], label: str = "label") -> DataFrame:
    """label, phrase: the medians of a type (as ``readable_profile`` gives them) where they differ from all entities' by a point or more."""
    overall = readable.filter(F.col(label).isNull()).select(*[F.col(f"{c}_pct").alias(f"_{c}") for c in shares])
    rows = readable.filter(F.col(label).isNotNull()).crossJoin(F.broadcast(overall))  # one row
    number = lambda c, digits: F.format_number(c, digits)
    parts = [F.when(F.col(f"{c}_rel_pct").isNotNull(), F.concat(F.lit(f"{c} "), number(F.col(f"{c}_rel_pct"), 0), F.lit(" % of the overall median"))) for c in levels]
    for c in shares:
        off = F.col(f"{c}_pct") - F.col(f"_{c}")
        text = F.concat(F.lit(f"share of {c} "), number(F.col(f"{c}_pct"), 1), F.when(off > 0, F.lit(" % (above the overall by ")).otherwise(F.lit(" % (below the overall by ")), number(F.abs(off), 1), F.lit(" points)"))
        parts.append(F.when((F.col(f"_{c}") > 0) & (F.abs(off) >= 1), text))
    joined = F.concat_ws("; ", *parts)
    return rows.select(label, F.when(joined != "", F.concat(F.lit("Medians: "), joined, F.lit("."))).alias("phrase"))


def with_locked(names: DataFrame, locked: DataFrame, method: str, k: int, period: str, label: str = "label") -> DataFrame:
    """Names that people have settled (method, k, period, label, name, short, description) in place of drafts, for the same method, k and period alone."""
    own = locked.filter((F.col("method") == method) & (F.col("k") == k) & (F.col("period") == period)).select(label, *[F.col(c).alias(f"_{c}") for c in ("name", "short", "description")])
    return names.join(F.broadcast(own), label, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in ("name", "short", "description")}).drop("_name", "_short", "_description")  # a row for each type


def profile_wide(profile: DataFrame, features: Sequence[str], value: str = "mean", label: str = "label") -> DataFrame:
    """A row for each label (NULL: all), a column for each feature."""
    return profile.groupBy(label).pivot("feature", list(features)).agg(F.first(value))


def inconsistent_totals(raw: DataFrame, total: str, levels: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Rows of which the total is not the sum of its levels (missing ones count 0), with the difference."""
    gap = F.col(total) - reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in levels])
    return raw.withColumn("gap", gap).filter(F.abs("gap") > tolerance * F.greatest(F.abs(F.col(total)), F.lit(1.0)))


def rule_violations(means: DataFrame, declared: Mapping[Any, Mapping[str, Any]], thresholds: Mapping[str, float], label: str = "label") -> DataFrame:
    """label, feature, side, bound, value of every condition of a declared rule that its label's means break."""
    rows = [(k, *limit) for k, rule in declared.items() for limit in _limits(rule, thresholds)]
    bounds = means.sparkSession.createDataFrame(rows, f"{label} {dict(means.dtypes)[label]}, feature string, side string, bound double")
    values = _long(means, [c for c in means.columns if c != label], [label])
    joined = F.broadcast(bounds).join(values, [label, "feature"], "left")
    broken = F.col("value").isNull() | ((F.col("side") == "min") & (F.col("value") < F.col("bound"))) | ((F.col("side") == "max") & (F.col("value") > F.col("bound")))
    return joined.filter(broken)


def surrogate_tree(df: DataFrame, columns: Sequence[str], label: str = "label", depth: int = 3, leaf: int = 30, folds: int = 5, seed: int = 42) -> dict[str, Any]:
    """A shallow tree that repeats the labels: its rules as text, accuracy on all rows and over stratified folds, and its leaves."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="skip").transform(df).withColumn("_y", F.col(label).cast("double"))
    place = F.row_number().over(Window.partitionBy("_y").orderBy(F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])))
    rows = rows.withColumn("_fold", (place - 1) % folds).cache()
    tree = DecisionTreeClassifier(featuresCol="_x", labelCol="_y", maxDepth=depth, minInstancesPerNode=leaf, maxBins=256, seed=seed)
    hit = F.avg((F.col("prediction") == F.col("_y")).cast("int")).alias("hit")
    model = tree.fit(rows)
    scored = model.transform(rows)
    leaves = scored.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), hit).orderBy("prediction").collect()
    accuracy = scored.agg(hit).first().hit
    held = [tree.fit(rows.filter(F.col("_fold") != k)).transform(rows.filter(F.col("_fold") == k)).agg(hit).first().hit for k in range(folds)]
    text = model.toDebugString
    for k, c in sorted(enumerate(columns), reverse=True):
        text = text.replace(f"feature {k} ", f"{c} ")
    rows.unpersist()
    return {"rules": text, "accuracy": accuracy, "cv_accuracy": sum(held) / len(held), "leaves": [(int(r.prediction), r.n, r.hit) for r in leaves]}


def permutation_importance(df: DataFrame, columns: Sequence[str], label: str = "label", seed: int = 0) -> DataFrame:
    """label, feature, drop: how much less often the nearest centre gives a label's rows that label when the feature's values are dealt anew.

    All features are dealt at once: a row for each feature has that feature's value from another row.
    """
    from netpanel.operators import vectors

    points = df.select("entity", label, F.array(*columns).alias("x"))
    centres = vectors.centres(points, [label]).withColumnRenamed(label, "label")
    each = points.select("entity", label, "x", F.explode(F.sequence(F.lit(0), F.lit(len(columns) - 1))).alias("k"))
    of = Window.partitionBy("k")
    placed = each.withColumn("_n", F.row_number().over(of.orderBy("entity"))).withColumn("_m", F.row_number().over(of.orderBy(stats.mixed(F.col("entity"), F.col("k"), seed), "entity")))
    given = placed.select(F.col("k").alias("_k"), F.col("_m").alias("_to"), F.element_at("x", F.col("k") + 1).alias("_v"))
    dealt = placed.join(given, (F.col("k") == F.col("_k")) & (F.col("_n") == F.col("_to")))
    changed = dealt.select("entity", label, "k", F.transform("x", lambda v, i: F.when(i == F.col("k"), F.col("_v")).otherwise(v)).alias("x"))
    hit = lambda rows, keys: vectors.nearest_centre(rows, centres, keys).select(*keys, (F.col("nearest") == F.col(label)).cast("int").alias("hit"))
    plain = hit(points, ("entity", label)).groupBy(label).agg(F.avg("hit").alias("before"))
    after = hit(changed, ("entity", label, "k")).groupBy(label, "k").agg(F.avg("hit").alias("after"))
    names = F.array(*[F.lit(c) for c in columns])
    return after.join(plain, label).select(label, F.element_at(names, F.col("k") + 1).alias("feature"), (F.col("before") - F.col("after")).alias("drop"))


def summary_documents(profile: DataFrame, names: DataFrame, typical: DataFrame, label: str = "label") -> DataFrame:
    """A nested row for each type: name, size, features in order of contribution, typical and border entities."""
    features = profile.groupBy(label).agg(F.first("n").alias("n"), F.first("share").alias("share"), F.sort_array(F.collect_list(F.struct((F.col("contrib")).alias("contrib"), "feature", "mean", "rel_dev")), asc=False).alias("features"))
    members = typical.groupBy(label, "kind").agg(F.array_sort(F.collect_list(F.struct("place", "entity"))).alias("e")).groupBy(label).pivot("kind", ["typical", "border"]).agg(F.first("e"))
    return features.join(names, label, "left").join(members, label, "left")


def name_search(entities: DataFrame, text: str, column: str = "name") -> DataFrame:
    """Entities whose name begins with the text, then has a word that does, then holds it; loosely (case, ё as е)."""
    plain = lambda c: F.translate(F.lower(c), "ё", "е")
    name, want = plain(F.col(column)), text.lower().replace("ё", "е")
    place = F.when(name.startswith(want), 0).when(F.concat(F.lit(" "), F.regexp_replace(name, "[-(]", " ")).contains(" " + want), 1).when(name.contains(want), 2)
    return entities.withColumn("place", place).filter("place is not null")


def best_by_metric(table: DataFrame) -> DataFrame:
    """metric, method, value of the best method of each metric, by direction; the first name wins ties."""
    from netpanel.operators.indices import oriented

    rows = oriented(table)
    return rows.groupBy("metric").agg(F.min_by("method", F.struct(-F.col("oriented"), F.col("method"))).alias("method"), F.min_by("value", F.struct(-F.col("oriented"), F.col("method"))).alias("value"))
