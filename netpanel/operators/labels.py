"""Algebra of label series: runs, transitions, confirmed changes, alignment, life cycles, trajectories.

A label table has entity, period (whole number) and label (integer); negative labels count as undefined where
that is said. Everything is windows within an entity or small tables of labels by labels.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series():
    """An entity's periods in order."""
    return Window.partitionBy("entity").orderBy("period")


def encoded(df: DataFrame, column: str = "label") -> DataFrame:
    """Labels numbered 0 .. K - 1 in the order of their values; the distinct values are a small table."""
    values = df.select(column).distinct().filter(F.col(column).isNotNull())
    numbered = values.withColumn("_code", (F.dense_rank().over(Window.orderBy(column)) - 1).cast("int"))
    return df.join(F.broadcast(numbered), column).drop(column).withColumnRenamed("_code", column)


def known_below(df: DataFrame, k: int, column: str = "label") -> DataFrame:
    """Labels from k on count as undefined: -1."""
    return df.withColumn(column, F.when(F.col(column) >= k, F.lit(-1)).otherwise(F.col(column)))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def runs(labels: DataFrame, confidence: str | None = None, head: int = 0) -> DataFrame:
    """Stretches of equal labels: entity, run, label, start, length, last; with ``confidence`` the mean of its first ``head`` periods."""
    new = F.coalesce((F.col("label") != F.lag("label").over(series())).cast("int"), F.lit(1))
    marked = labels.withColumn("_new", new).withColumn("run", F.sum("_new").over(series()))
    extra = []
    if confidence:
        marked = marked.withColumn("_at", F.row_number().over(Window.partitionBy("entity", "run").orderBy("period")))
        extra = [F.avg(F.when(F.col("_at") <= head, F.col(confidence))).alias("confidence")]
    return marked.groupBy("entity", "run").agg(F.first("label").alias("label"), F.min("period").alias("start"), F.count(F.lit(1)).alias("length"), F.max("period").alias("last"), *extra)


def remaining(labels: DataFrame) -> DataFrame:
    """Of each period: how long the label goes on from there, itself included."""
    rows = labels.withColumn("_new", F.coalesce((F.col("label") != F.lag("label").over(series())).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(series()))
    whole = Window.partitionBy("entity", "_run")
    return rows.withColumn("remaining", F.count(F.lit(1)).over(whole) - F.row_number().over(whole.orderBy("period")) + 1).drop("_new", "_run")


def n_changes(labels: DataFrame) -> DataFrame:
    changed = (F.col("label") != F.lag("label").over(series())).cast("int")
    return labels.withColumn("_c", changed).groupBy("entity").agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n_changes"), F.max(F.when(F.col("_c") == 1, F.col("period"))).alias("last_change"))


def stability_curve(labels: DataFrame) -> DataFrame:
    """By period: the share of entities that have not changed so far."""
    changed = F.coalesce((F.col("label") != F.lag("label").over(series())).cast("int"), F.lit(0))
    rows = labels.withColumn("_c", changed).withColumn("_ever", F.max("_c").over(series()))
    return rows.groupBy("period").agg((1 - F.avg("_ever")).alias("unchanged"))


def transitions(labels: DataFrame, lag: int = 1) -> DataFrame:
    """Pairs (from, to) pooled over all periods t and t + lag: n and its share of the row."""
    later = labels.select("entity", (F.col("period") - lag).alias("period"), F.col("label").alias("to_label"))
    counts = labels.join(later, ["entity", "period"]).groupBy(F.col("label").alias("from_label"), "to_label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from_label")))


def densified_transitions(counts: DataFrame, label_values: DataFrame) -> DataFrame:
    """All K x K cells; a row that nothing leaves has NULL shares."""
    grid = label_values.select(F.col("label").alias("from_label")).crossJoin(F.broadcast(label_values.select(F.col("label").alias("to_label"))))
    full = grid.join(counts.select("from_label", "to_label", "n"), ["from_label", "to_label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    row = F.sum("n").over(Window.partitionBy("from_label"))
    return full.withColumn("p", F.when(row > 0, F.col("n") / row))


def shorrocks(trans: DataFrame) -> DataFrame:
    """Mobility (K - trace) / (K - 1) over the rows that have transitions; one row, NULL for fewer than two."""
    k = F.countDistinct("from_label")
    trace = F.sum(F.when(F.col("from_label") == F.col("to_label"), F.col("p")).otherwise(F.lit(0.0)))
    return trans.agg(k.alias("k"), F.when(k > 1, (k - trace) / (k - 1)).alias("mobility"))


def _confirmed_runs(labels: DataFrame, min_run: int, confidence: str | None, threshold: float) -> DataFrame:
    """Runs with ok: long enough, and sure enough if there is a confidence."""
    found = runs(labels, confidence, min_run)
    ok = F.col("length") >= min_run
    if confidence:
        ok = ok & (F.coalesce("confidence", F.lit(0.0)) >= threshold)
    return found.withColumn("ok", ok)


def confirmed_changes(labels: DataFrame, min_run: int = 3, confidence: str | None = None, threshold: float = 0.7) -> DataFrame:
    """Events: entity, kind, from_label, to_label, period, run_length, known_at.

    A run counts if it is long (and sure) enough. Runs that do not are dropped and equal neighbours joined: what is
    left is the confirmed series. Its first label holds from the beginning; an entity without any such run has its
    longest one (the earliest on ties) throughout. Every later run is a confirmed change, known after min_run
    periods. A last run that does not count but touches the series' end, and differs, is a candidate.
    """
    found = _confirmed_runs(labels, min_run, confidence, threshold)
    order = Window.partitionBy("entity").orderBy("start")
    sure = found.filter("ok").withColumn("_before", F.lag("label").over(order))
    changes = sure.filter("_before is not null and label != _before").select("entity", F.lit("confirmed").alias("kind"), F.col("_before").alias("from_label"), F.col("label").alias("to_label"), F.col("start").alias("period"), F.col("length").alias("run_length"), (F.col("start") + min_run - 1).alias("known_at"))
    last_sure = found.filter("ok").groupBy("entity").agg(F.max_by("label", "start").alias("sure"))
    first_longest = F.struct("length", -F.col("start"))
    ends = found.groupBy("entity").agg(F.max_by("label", first_longest).alias("longest"), F.max_by("start", first_longest).alias("longest_start"), F.max_by(F.struct("label", "start", "ok", "length"), "start").alias("tail"))
    ends = ends.join(last_sure, "entity", "left").withColumn("current", F.coalesce("sure", "longest"))
    after = F.col("sure").isNotNull() | (F.col("tail.start") > F.col("longest_start"))
    tails = ends.filter(~F.col("tail.ok") & (F.col("tail.label") != F.col("current")) & after)
    candidates = tails.select("entity", F.lit("candidate").alias("kind"), F.col("current").alias("from_label"), F.col("tail.label").alias("to_label"), F.col("tail.start").alias("period"), F.col("tail.length").alias("run_length"), F.lit(None).cast("long").alias("known_at"))
    return changes.unionByName(candidates)


def confirmed_series(labels: DataFrame, min_run: int = 3, confidence: str | None = None, threshold: float = 0.7) -> DataFrame:
    """Every row with ``confirmed``: the label of the latest run that counts, the first one before that."""
    found = _confirmed_runs(labels, min_run, confidence, threshold)
    starts = found.filter("ok").select("entity", F.col("start").alias("period"), F.col("label").alias("_sure"))
    first = found.groupBy("entity").agg(F.coalesce(F.min_by(F.when(F.col("ok"), F.col("label")), F.when(F.col("ok"), F.col("start"))), F.max_by("label", F.struct("length", -F.col("start")))).alias("_first"))
    rows = labels.join(starts, ["entity", "period"], "left").join(first, "entity")
    return rows.withColumn("confirmed", F.coalesce(F.last("_sure", ignorenulls=True).over(series()), "_first")).drop("_sure", "_first")


def change_decomposition(labels: DataFrame, min_run: int = 3, recur_after: int = 12) -> DataFrame:
    """By step: raw changes, and of these confirmed, short noise, noise that returns, candidates, recurrent; and a total row (period NULL).

    A raw change is confirmed if the confirmed series changes with it. Of the others one whose run is shorter than
    min_run is a candidate if it touches the end, else short noise; a long run returns to the confirmed label.
    Recurrent: the same change of the same entity ``recur_after`` periods before or later.
    """
    end = labels.groupBy("entity").agg(F.max("period").alias("_end"))
    rows = remaining(confirmed_series(labels, min_run)).join(end, "entity")
    before, sure_before = F.lag("label").over(series()), F.lag("confirmed").over(series())
    rows = rows.withColumns({"from_label": before, "_sure": sure_before.isNotNull() & (F.col("confirmed") != sure_before)})
    rows = rows.filter("from_label is not null and label != from_label").withColumn("to_label", F.col("label"))
    touches = F.col("period") + F.col("remaining") > F.col("_end")
    kind = F.when(F.col("_sure"), "confirmed").when((F.col("remaining") < min_run) & touches, "candidate").when(F.col("remaining") < min_run, "noise_short").otherwise("noise_return")
    rows = recurrent(rows.withColumn("_kind", kind), recur_after)
    counts = [F.count(F.lit(1)).alias("n_raw"), *[F.count(F.when(F.col("_kind") == k, 1)).alias(f"n_{k}") for k in ("confirmed", "noise_short", "noise_return", "candidate")], F.count(F.when(F.col("recurs"), 1)).alias("n_recurrent")]
    entities = labels.agg(F.countDistinct("entity").alias("_entities"))
    out = rows.rollup("period").agg(*counts).crossJoin(F.broadcast(entities))  # one row
    return out.withColumns({"share_raw": F.col("n_raw") / F.col("_entities"), "noise_share": F.when(F.col("n_raw") > 0, (F.col("n_noise_short") + F.col("n_noise_return")) / F.col("n_raw")), "confirmed_share": F.when(F.col("n_raw") > 0, F.col("n_confirmed") / F.col("n_raw"))}).drop("_entities")


def recurrent(events: DataFrame, after: int = 12) -> DataFrame:
    """Events (entity, from_label, to_label, period) with whether the same one happens exactly ``after`` periods before or later."""
    same = events.select("entity", "from_label", "to_label", F.explode(F.array(F.col("period") - after, F.col("period") + after)).alias("period")).distinct()
    return events.join(same.withColumn("recurs", F.lit(True)), ["entity", "from_label", "to_label", "period"], "left").withColumn("recurs", F.coalesce("recurs", F.lit(False)))


def calendar_lift(events: DataFrame, steps: DataFrame, place: Column) -> DataFrame:
    """By place in the calendar: events, their share, the share of steps there, and the ratio of these."""
    found = events.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    chances = steps.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("steps"))
    both = chances.join(found, "place", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = both.agg(F.sum("n").alias("all_n"), F.sum("steps").alias("all_steps"))
    out = both.crossJoin(F.broadcast(total))
    return out.select("place", "n", (F.col("n") / F.col("all_n")).alias("share"), (F.col("steps") / F.col("all_steps")).alias("expected"), (F.col("n") / F.col("all_n") / (F.col("steps") / F.col("all_steps"))).alias("lift"))


def modal_label(labels: DataFrame) -> DataFrame:
    """Each entity's most frequent label (the last period's on ties, then the smaller), and its share; negatives are skipped."""
    known = labels.filter("label >= 0")
    last = known.groupBy("entity").agg(F.max_by("label", "period").alias("_last"), F.count(F.lit(1)).alias("_all"))
    counts = known.groupBy("entity", "label").agg(F.count(F.lit(1)).alias("n")).join(last, "entity")
    best = F.struct(F.col("n"), (F.col("label") == F.col("_last")).cast("int"), -F.col("label"))
    return counts.groupBy("entity").agg(F.max_by("label", best).alias("label"), (F.max("n") / F.first("_all")).alias("share"))


def trajectories(labels: DataFrame) -> DataFrame:
    """One row by entity: labels in order joined by commas, changes, first and last label, last change."""
    steps = F.array_sort(F.collect_list(F.struct("period", "label")))
    rows = labels.groupBy("entity").agg(steps.alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["label"].cast("string")), ",")
    first, last = F.col("s")[0]["label"], F.element_at("s", -1)["label"]
    return rows.select("entity", text.alias("trajectory"), first.alias("first_label"), last.alias("last_label")).join(n_changes(labels), "entity")


def sizes_over_time(labels: DataFrame) -> DataFrame:
    """Entities by label and period, 0 where none is."""
    values, periods = labels.select("label").distinct(), labels.select("period").distinct()
    counts = labels.groupBy("label", "period").agg(F.count(F.lit(1)).alias("n"))
    return values.crossJoin(F.broadcast(periods)).join(counts, ["label", "period"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def overlaps(labels: DataFrame, lag: int = 1) -> DataFrame:
    """For consecutive periods: common entities of each pair of labels, sizes and Jaccard similarity."""
    sizes = labels.groupBy("period", "label").agg(F.count(F.lit(1)).alias("size"))
    later = labels.select("entity", (F.col("period") - lag).alias("period"), F.col("label").alias("to_label"))
    common = labels.join(later, ["entity", "period"]).groupBy("period", F.col("label").alias("from_label"), "to_label").agg(F.count(F.lit(1)).alias("n"))
    out = common.join(sizes.select("period", F.col("label").alias("from_label"), F.col("size").alias("from_size")), ["period", "from_label"])
    out = out.join(sizes.select((F.col("period") - lag).alias("period"), F.col("label").alias("to_label"), F.col("size").alias("to_size")), ["period", "to_label"])
    return out.withColumn("jaccard", F.col("n") / (F.col("from_size") + F.col("to_size") - F.col("n")))


def lifecycle(labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Events between consecutive periods at Jaccard >= threshold: continue, merge, split, birth, death.

    period (of the later one), kind, from_ids, to_ids, jaccard (the largest of the pairs; for births and deaths the
    largest below the threshold, 0 if there is none), size_from, size_to.
    """
    every = overlaps(labels)
    match = every.filter(F.col("jaccard") >= threshold)
    linked = match.join(match.groupBy("period", "from_label").agg(F.count(F.lit(1)).alias("outs")), ["period", "from_label"])
    linked = linked.join(match.groupBy("period", "to_label").agg(F.count(F.lit(1)).alias("ins")), ["period", "to_label"])
    ids = lambda c: F.array_sort(F.collect_list(c))
    one = linked.filter("ins = 1 and outs = 1").select("period", F.lit("continue").alias("kind"), F.array("from_label").alias("from_ids"), F.array("to_label").alias("to_ids"), "jaccard", F.col("from_size").alias("size_from"), F.col("to_size").alias("size_to"))
    merges = linked.filter("ins > 1").groupBy("period", "to_label").agg(ids("from_label").alias("from_ids"), F.max("jaccard").alias("jaccard"), F.sum("from_size").alias("size_from"), F.first("to_size").alias("size_to"))
    merges = merges.select("period", F.lit("merge").alias("kind"), "from_ids", F.array("to_label").alias("to_ids"), "jaccard", "size_from", "size_to")
    splits = linked.filter("outs > 1").groupBy("period", "from_label").agg(ids("to_label").alias("to_ids"), F.max("jaccard").alias("jaccard"), F.first("from_size").alias("size_from"), F.sum("to_size").alias("size_to"))
    splits = splits.select("period", F.lit("split").alias("kind"), F.array("from_label").alias("from_ids"), "to_ids", "jaccard", "size_from", "size_to")
    sizes = labels.groupBy("period", "label").agg(F.count(F.lit(1)).alias("size"))
    periods = sizes.select("period").distinct()
    none = F.array().cast(f"array<{labels.schema['label'].dataType.simpleString()}>")

    def unmatched(side: str, shift: int, kind: str) -> DataFrame:
        """Labels of one side of a step that match none of the other."""
        own = sizes.select((F.col("period") - shift).alias("period"), F.col("label").alias(side), "size")
        own = own.join(periods.select((F.col("period") - 1 + shift).alias("period")), "period", "left_semi")
        best = every.groupBy("period", side).agg(F.max("jaccard").alias("best"))
        rows = own.join(match.select("period", side), ["period", side], "left_anti").join(best, ["period", side], "left")
        ids_of = (F.array(side), none) if kind == "death" else (none, F.array(side))
        zero = F.lit(0).cast("long")
        size = (F.col("size"), zero) if kind == "death" else (zero, F.col("size"))
        return rows.select("period", F.lit(kind).alias("kind"), ids_of[0].alias("from_ids"), ids_of[1].alias("to_ids"), F.coalesce("best", F.lit(0.0)).alias("jaccard"), size[0].alias("size_from"), size[1].alias("size_to"))

    out = one.unionByName(merges).unionByName(splits).unionByName(unmatched("from_label", 0, "death")).unionByName(unmatched("to_label", 1, "birth"))
    return out.withColumn("period", F.col("period") + 1)


def assignment(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the largest total score, by shortest augmenting paths; for small matrices of labels."""
    cost = -np.asarray(score, float)
    flipped = cost.shape[0] > cost.shape[1]
    if flipped:
        cost = cost.T
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while owner[j0]:
            used[j0] = True
            i0 = owner[j0]
            slack = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better] = slack[better]
            way[1:][better] = j0
            free = np.where(used, np.inf, least)
            free[0] = np.inf
            j1 = int(free.argmin())
            delta = free[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) for a, b in pairs) if flipped else sorted(pairs)


def alignment(table: Sequence[tuple[int, int, int]], next_label: int | None = None) -> dict[int, int]:
    """New names of current labels from a table (previous, current, n) of common entities.

    Largest total Jaccard similarity; pairs without a common entity do not match. Labels left over get fresh
    numbers from the largest previous one on (or ``next_label``), by size, then by label.
    """
    before, now = sorted({a for a, _, _ in table}), sorted({b for _, b, _ in table})
    n = np.zeros((len(before), len(now)))
    for a, b, count in table:
        n[before.index(a), now.index(b)] += count
    jaccard = n / np.maximum(n.sum(1, keepdims=True) + n.sum(0) - n, 1)
    names = {now[j]: before[i] for i, j in assignment(jaccard) if jaccard[i, j] > 0}
    fresh = max(before, default=-1) + 1 if next_label is None else next_label
    rest = sorted((b for b in now if b not in names), key=lambda b: (-n[:, now.index(b)].sum(), b))
    return names | {b: fresh + k for k, b in enumerate(rest)}


def align_sequence(labels: DataFrame) -> DataFrame:
    """Renames the labels of each period after those of the period before, already renamed; fresh names are never used again.

    One pass finds all tables of neighbouring periods (K x K each); the renaming walks over these small tables.
    """
    later = labels.select("entity", (F.col("period") - 1).alias("period"), F.col("label").alias("later"))
    counts = labels.join(later, ["entity", "period"]).groupBy("period", "label", "later").agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = labels.groupBy("period", "label").agg(F.count(F.lit(1)).alias("n")).collect()
    spark = labels.sparkSession
    periods = sorted({r.period for r in sizes})
    own, met = ({p: [] for p in periods} for _ in range(2))
    for r in sizes:
        own[r.period].append((r.label, r.n))
    for r in counts:
        met[r.period].append(r)
    if not periods:
        return labels
    names = {periods[0]: {label: label for label, _ in own[periods[0]]}}
    fresh = max((label for label, _ in own[periods[0]]), default=-1) + 1
    for before, now in zip(periods, periods[1:], strict=False):
        table = [(names[before][r.label], r.later, r.n) for r in met[before]] if now == before + 1 else []
        found = alignment(table, fresh)
        for label, _ in sorted(own[now], key=lambda x: (-x[1], x[0])):
            if label not in found:
                found[label] = max([fresh - 1, *found.values()]) + 1
        names[now] = {label: found[label] for label, _ in own[now]}
        fresh = max([fresh - 1, *names[now].values()]) + 1
    rows = [(p, a, b) for p, m in names.items() for a, b in m.items()]
    mapping = spark.createDataFrame(rows, "period long, label int, aligned int")
    return labels.join(F.broadcast(mapping), ["period", "label"])


def renumbered(labels: DataFrame, reference: int) -> DataFrame:
    """Labels numbered by size in the reference period (ties by label); labels that are not there follow by total size."""
    sizes = labels.groupBy("label").agg(F.count(F.when(F.col("period") == reference, 1)).alias("_ref"), F.count(F.lit(1)).alias("_all"))
    order = Window.orderBy((F.col("_ref") > 0).cast("int").desc(), F.when(F.col("_ref") > 0, F.col("_ref")).otherwise(F.col("_all")).desc(), "label")  # a row for each label
    numbers = sizes.withColumn("number", (F.row_number().over(order) - 1).cast("int")).select("label", "number")
    return labels.join(F.broadcast(numbers), "label")


def flows(labels: DataFrame, first: int, last: int) -> DataFrame:
    """Entities by label in one period and in another, and shares of the first label."""
    a = labels.filter(F.col("period") == first).select("entity", F.col("label").alias("from_label"))
    b = labels.filter(F.col("period") == last).select("entity", F.col("label").alias("to_label"))
    counts = a.join(b, "entity").groupBy("from_label", "to_label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("from_label")))


def first_events(events: DataFrame, n: int = 200, order: Sequence[str] = ("period", "entity")) -> DataFrame:
    """The first n events in an order that leaves no ties open."""
    return events.orderBy(*order, *[c for c in events.columns if c not in order]).limit(n)


def event_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Recall, precision and recall at the exact period of events (entity, to_label, period)."""
    key = ["entity", "to_label"]
    t, f = truth.select(*key).distinct(), found.select(*key).distinct()
    exact = truth.select(*key, "period").distinct()
    hit = t.join(f, key, "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    precise = exact.join(found.select(*key, "period").distinct(), [*key, "period"], "left_semi").agg(F.count(F.lit(1)).alias("exact_hits"))
    out = hit.crossJoin(precise).crossJoin(t.agg(F.count(F.lit(1)).alias("n_truth"))).crossJoin(f.agg(F.count(F.lit(1)).alias("n_found"))).crossJoin(exact.agg(F.count(F.lit(1)).alias("n_exact")))  # one row each
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.select("n_truth", "n_found", ratio("hits", "n_truth").alias("recall"), ratio("hits", "n_found").alias("precision"), ratio("exact_hits", "n_exact").alias("exact_recall"))
