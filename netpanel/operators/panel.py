"""Panel algebra: from long rows (entity, period, category, value) to compositional features.

``period`` is a whole number that counts consecutive periods, so that frames and lags are arithmetic.
Missing is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("entity", "period")


def pivot(long: DataFrame, categories: Sequence[str], agg: str = "first") -> DataFrame:
    """One row for each entity and period, one column for each category; the list spares Spark a job to find it."""
    value = {"first": F.first("value", ignorenulls=True), "sum": F.sum("value"), "mean": F.avg("value")}[agg]
    return long.groupBy(*KEY).pivot("category", list(categories)).agg(value)


def _sum(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def with_residual(wide: DataFrame, named: Sequence[str], total: str, residual: str) -> DataFrame:
    """The total less the named categories; a missing named category counts as 0."""
    return wide.withColumn(residual, F.col(total) - _sum([F.coalesce(F.col(c), F.lit(0.0)) for c in named]))


def with_total(wide: DataFrame, parts: Sequence[str], total: str) -> DataFrame:
    return wide.withColumn(total, _sum([F.coalesce(F.col(c), F.lit(0.0)) for c in parts]))


def full_history(wide: DataFrame, min_periods: int, drop: DataFrame | None = None) -> DataFrame:
    """Entities with rows for at least ``min_periods`` periods, but for those in ``drop``."""
    kept = wide.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_periods).select("entity")
    return kept.join(drop.select("entity").distinct(), "entity", "left_anti") if drop is not None else kept


def in_panel(wide: DataFrame, panel: DataFrame) -> DataFrame:
    return wide.join(panel.select("entity"), "entity", "left_semi")


def shares(wide: DataFrame, parts: Sequence[str], total: str, pseudocount: float = 1e-4) -> DataFrame:
    """Parts of the total, at least ``pseudocount`` (also where a residual is negative), then scaled to sum to 1."""
    clipped = wide.withColumns({f"share_{c}": F.when(F.col(c).isNotNull() & (F.col(total) != 0), F.greatest(F.col(c) / F.col(total), F.lit(pseudocount))) for c in parts})
    whole = _sum([F.col(f"share_{c}") for c in parts])
    return clipped.withColumn("_whole", whole).withColumns({f"share_{c}": F.col(f"share_{c}") / F.col("_whole") for c in parts}).drop("_whole")


def clr(df: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Centred log ratios of the shares."""
    logs = [F.ln(F.col(f"share_{c}")) for c in parts]
    mean = _sum(logs) / len(parts)
    return df.withColumn("_mean", mean).withColumns({f"clr_{c}": F.ln(F.col(f"share_{c}")) - F.col("_mean") for c in parts}).drop("_mean")


def relative_level(df: DataFrame, total: str, weight: float = 1.0) -> DataFrame:
    """Log of the total over the period's median, over all entities given."""
    medians = df.groupBy("period").agg(F.median(total).alias("_median"))
    level = F.when((F.col(total) > 0) & (F.col("_median") > 0), F.ln(F.col(total) / F.col("_median")) * weight)
    return df.join(medians, "period").withColumn("log_level_rel", level).drop("_median")


def raw_features(long: DataFrame, named: Sequence[str], total: str, residual: str, pseudocount: float = 1e-4, weight: float = 1.0) -> DataFrame:
    """Pivot, residual, shares, centred log ratios and relative level of a long panel that has a total category."""
    wide = with_residual(pivot(long, [*named, total]), named, total, residual)
    parts = [*named, residual]
    return relative_level(clr(shares(wide, parts, total, pseudocount), parts), total, weight)


def densify(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for every entity and every period that occurs; absent ones with NULL."""
    grid = df.select("entity").distinct().crossJoin(F.broadcast(df.select("period").distinct()))  # the periods are the calendar
    return grid.join(df.select(*KEY, *columns), list(KEY), "left")


def causal_mean(df: DataFrame, columns: Sequence[str], window: int) -> DataFrame:
    """Mean of what the periods t - window + 1 .. t hold; a missing period shortens the mean."""
    frame = Window.partitionBy("entity").orderBy("period").rangeBetween(1 - window, 0)
    return df.withColumns({c: F.avg(c).over(frame) for c in columns})


def zscore_within(df: DataFrame, columns: Sequence[str], by: str = "period") -> DataFrame:
    """Scores within a period, with the population's deviation; 0 deviation counts as 1.

    Moments are aggregated and joined back: no task gets all rows of a period.
    """
    moments = df.groupBy(by).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scored = df.join(moments, by)
    sd = {c: F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0)) for c in columns}
    scored = scored.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / sd[c] for c in columns})
    return scored.drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def features(raw: DataFrame, columns: Sequence[str], window: int, panel: DataFrame | None = None) -> DataFrame:
    """Causal means, then scores within the period over all entities, then the panel's entities alone."""
    smooth = zscore_within(causal_mean(raw.select(*KEY, *columns), columns, window), columns)
    return in_panel(smooth, panel) if panel is not None else smooth


def log_growth(df: DataFrame, level: str) -> DataFrame:
    """Log change on the period before, less the period's median change."""
    order = Window.partitionBy("entity").orderBy("period")
    step = F.when((F.lag("period").over(order) == F.col("period") - 1) & (F.col(level) > 0) & (F.lag(level).over(order) > 0), F.ln(F.col(level)) - F.ln(F.lag(level).over(order)))
    grown = df.select(*KEY, step.alias("change")).filter("change is not null")
    medians = grown.groupBy("period").agg(F.median("change").alias("_median"))
    return grown.join(medians, "period").select(*KEY, (F.col("change") - F.col("_median")).alias("growth"))


def growth_window(growth: DataFrame, window: int, least: int) -> DataFrame:
    """For each period t the growth rows of (t - window, t], if at least ``least`` periods are there."""
    periods = growth.select(F.col("period").alias("t")).distinct()
    rows = growth.withColumn("t", F.explode(F.sequence(F.col("period"), F.col("period") + window - 1)))
    rows = rows.join(F.broadcast(periods), "t", "left_semi")
    enough = rows.groupBy("t").agg(F.countDistinct("period").alias("n")).filter(F.col("n") >= least)
    return rows.join(F.broadcast(enough.select("t")), "t", "left_semi").select("t", *KEY, "growth")


def period_average(df: DataFrame, columns: Sequence[str], first: int | None = None, last: int | None = None) -> DataFrame:
    """Mean of each column over the selected periods, by entity."""
    rows = df if first is None else df.filter(F.col("period").between(first, last))
    return rows.groupBy("entity").agg(*[F.avg(c).alias(c) for c in columns])


def median_iqr(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Median and distance of the quartiles (linear interpolation) of a value by keys."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return long.groupBy(*keys).agg(q.alias("q")).select(*keys, F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def audit(long: DataFrame) -> DataFrame:
    """By category: rows, missing values, repeated keys, periods, entities, least, median and largest value, coverage."""
    cells = long.select(F.countDistinct("entity").alias("e"), F.countDistinct("period").alias("p"))
    keyed = long.groupBy("category", *KEY).agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("m"))
    counts = keyed.groupBy("category").agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - F.col("m")).alias("n_missing"), F.sum(F.col("n") - 1).alias("n_repeated"), F.countDistinct("period").alias("n_periods"), F.countDistinct("entity").alias("n_entities"), F.count(F.lit(1)).alias("n_cells"))
    stats = long.groupBy("category").agg(F.min("value").alias("lowest"), F.median("value").alias("middle"), F.max("value").alias("highest"))
    out = counts.join(stats, "category").crossJoin(F.broadcast(cells))
    return out.select("category", "n_rows", "n_missing", "n_repeated", "n_periods", "n_entities", "lowest", "middle", "highest", (F.col("n_cells") / (F.col("e") * F.col("p"))).alias("coverage"))


def median_change(df: DataFrame, value: str, by: str = "category") -> DataFrame:
    """Relative change of the period's median on the period before, by category."""
    medians = df.groupBy(by, "period").agg(F.median(value).alias("middle"))
    before = F.lag("middle").over(Window.partitionBy(by).orderBy("period"))
    return medians.select(by, "period", "middle", F.when(before != 0, F.col("middle") / before - 1).alias("change"))


def of_period(df: DataFrame, prefix: str | None, column: str = "month") -> DataFrame:
    """Rows whose period's name begins with the prefix (a year, a month); all rows without one."""
    return df.filter(F.col(column).cast("string").startswith(prefix)) if prefix else df
