"""External statistics by code and section: cleaning, sector sums, weighted wages, derived shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netpanel.functions.scalars import code8, number, section_code
from netpanel.operators.entities import first_by


def top_level(rows: DataFrame, level: str, columns: Sequence[str]) -> DataFrame:
    """Rows of the top municipal level with codes and numbers parsed, missing columns added, whole repeats dropped."""
    rows = rows.filter(F.col("mun_level") == level)
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in columns if c not in rows.columns})
    return rows.withColumns({"oktmo8": code8("oktmo"), "stable8": code8("oktmo_stable"), "value": number("indicator_value")}).dropDuplicates()


def population(rows: DataFrame, kinds: Mapping[str, str], total: str) -> DataFrame:
    """By code: one column for each kind of settlement (the first row counts); 0 people in all is missing, shares lie in 0 .. 1."""
    first = first_by(rows, ["oktmo8", "mest"], F.desc_nulls_last("value"))
    wide = first.groupBy("oktmo8").pivot("mest", list(kinds)).agg(F.first("value"))
    wide = wide.select("oktmo8", *[F.col(f"`{k}`").alias(v) for k, v in kinds.items()])
    wide = wide.withColumn(total, F.when(F.col(total) > 0, F.col(total)))
    others = [v for v in kinds.values() if v != total]
    return wide.withColumns({c: F.greatest(F.col(c), F.lit(0.0)) for c in others}).withColumns({f"{c}_share": F.least(F.lit(1.0), F.col(c) / F.col(total)) for c in others})


def best_period(rows: DataFrame, priority: Sequence[str]) -> DataFrame:
    """By code: the reporting period of least rank among the total's rows, else among all."""
    rank = reduce(lambda w, x: w.when(F.col("indicator_period") == x[1], F.lit(x[0])), enumerate(priority[1:], 1), F.when(F.col("indicator_period") == priority[0], F.lit(0)))
    ranked = rows.withColumn("_rank", rank.otherwise(F.lit(len(priority))))
    best = ranked.groupBy("oktmo8").agg(F.coalesce(F.min(F.when(F.col("section") == "_total", F.col("_rank"))), F.min("_rank")).alias("_best"))
    return ranked.join(best, "oktmo8").filter("_rank = _best").drop("_rank", "_best")


def sections(employment: DataFrame, wages: DataFrame) -> DataFrame:
    """Employment and wages by code and section, whichever has a row: a full outer join."""
    e = employment.select("oktmo8", "section", F.col("value").alias("employees"))
    w = wages.select("oktmo8", "section", F.col("value").alias("wage"))
    return e.join(w, ["oktmo8", "section"], "outer")


def assembled(people: DataFrame, sectors: DataFrame, meta: Sequence[str], key: str = "oktmo8") -> DataFrame:
    """Population and sectors side by side, whichever has a row; columns of ``meta``, which both have, from the first that has a value."""
    right = sectors.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in meta], *[c for c in sectors.columns if c not in (key, *meta)])
    rows = people.join(right, F.col(key) == F.col("_key"), "outer")
    own = [c for c in (*people.columns, *sectors.columns) if c not in (key, *meta)]
    return rows.select(F.coalesce(key, "_key").alias(key), *own, *[F.coalesce(c, f"_{c}").alias(c) for c in meta])


def sector_aggregate(rows: DataFrame, sector_of: Mapping[str, str]) -> DataFrame:
    """By code and sector: employees (all missing: missing) and the mean wage, weighted by employees where both are known, else plain."""
    mapping = F.create_map(*[F.lit(x) for item in sector_of.items() for x in item])
    both = F.when(F.col("employees").isNotNull() & F.col("wage").isNotNull(), F.col("employees"))
    return (
        rows.withColumn("sector", mapping[F.col("section")]).filter("sector is not null").groupBy("oktmo8", "sector")
        .agg(F.sum("employees").alias("employees"), F.coalesce(F.sum(both * F.col("wage")) / F.nullif(F.sum(both), F.lit(0.0)), F.avg("wage")).alias("wage"), F.count("employees").alias("reported"))
    )


def derive(wide: DataFrame, sectors: Sequence[str], total: str = "total") -> DataFrame:
    """Shares of sectors in the total, the rest's share, concentration (sum of squares), the largest named sector, relative wage."""
    known = F.when(F.col(total) > 0, F.col(total))
    out = wide.withColumns({f"share_{s}": F.col(s) / known for s in sectors})
    named = [F.coalesce(F.col(f"share_{s}"), F.lit(0.0)) for s in sectors]
    some = F.coalesce(*[F.col(s) for s in sectors]).isNotNull() & known.isNotNull()
    rest = F.when(some, F.greatest(F.lit(0.0), 1 - reduce(lambda a, b: a + b, named)))
    squares = reduce(lambda a, b: a + b, [x * x for x in named])
    ranked = F.array(*[F.struct(F.coalesce(F.col(s), F.lit(-1.0)).alias("v"), (-F.lit(k)).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(sectors)])
    out = out.withColumns({"share_rest": rest, "hhi": F.when(some, squares + F.coalesce(rest, F.lit(0.0)) ** 2), "top_sector": F.when(F.coalesce(*[F.col(s) for s in sectors]).isNotNull(), F.array_max(ranked)["s"])})
    if "wage" not in wide.columns:
        return out
    middle = wide.agg(F.median("wage").alias("_median"))
    return out.crossJoin(F.broadcast(middle)).withColumn("wage_rel", F.col("wage") / F.col("_median")).drop("_median")  # one row


def merge_sources(rows: DataFrame, key: str, sums: Sequence[str], means: Sequence[tuple[str, str]], flags: Sequence[str], names: Sequence[str], least: Sequence[str] = ()) -> DataFrame:
    """Several source rows of a key as one: sums, weighted means, least values, flags all true, distinct names joined in order."""
    both = lambda v, w: F.when(F.col(v).isNotNull() & F.col(w).isNotNull(), F.col(w))
    return rows.groupBy(key).agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.coalesce(F.sum(F.col(v) * both(v, w)) / F.nullif(F.sum(both(v, w)), F.lit(0.0)), F.avg(v)).alias(v) for v, w in means],
        *[F.min(c).alias(c) for c in least],
        *[F.every(F.col(c)).alias(c) for c in flags],
        *[F.array_join(F.array_sort(F.collect_set(c)), ", ").alias(c) for c in names],
    )


def coverage(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """How many rows have a value, column by column; with ``by`` for each group."""
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in columns])
    return counted.unpivot([*by, "n"], list(columns), "column", "n_known")


def collapse_rare(df: DataFrame, column: str, least: int, other: str = "прочее") -> DataFrame:
    """Categories of fewer than ``least`` rows become one; missing stays missing."""
    sizes = df.groupBy(column).agg(F.count(F.lit(1)).alias("_size"))
    rare = F.when(F.col(column).isNotNull(), F.when(F.col("_size") < least, F.lit(other)).otherwise(F.col(column)))
    return df.join(sizes, column, "left").withColumn(column, rare).drop("_size")


def section_rows(rows: DataFrame, total: str = "Всего") -> DataFrame:
    return rows.withColumn("section", section_code("okved2", total)).filter("section is not null")


def ranked_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))))
