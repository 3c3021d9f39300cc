"""Panel queries: features, growth, audits; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netpanel.operators import panel
from netpanel.sources import tables
from netpanel.sources.tables import CATEGORIES

NAMED, TOTAL, RESIDUAL = CATEGORIES[:5], "total", "other"
CLR = [*(f"clr_{c}" for c in (*NAMED, RESIDUAL)), "log_level_rel"]

PANEL_SQL = """
panel AS (SELECT l_suppkey AS entity, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) AS BIGINT) AS period,
                 l_returnflag || l_linestatus AS category, sum(l_extendedprice) AS value
          FROM lineitem GROUP BY 1, 2, 3)"""

WIDE_SQL = PANEL_SQL + """,
wide0 AS (SELECT entity, period, """ + ", ".join(f"max(CASE WHEN category = '{c}' THEN value END) AS \"{c}\"" for c in NAMED) + """, sum(value) AS total
          FROM panel GROUP BY 1, 2),
wide AS (SELECT *, total - (""" + " + ".join(f'coalesce("{c}", 0.0)' for c in NAMED) + """) AS other FROM wide0)"""

_PARTS = (*NAMED, RESIDUAL)
RAW_SQL = WIDE_SQL + """,
clipped AS (SELECT entity, period, total, """ + ", ".join(f'CASE WHEN "{c}" IS NOT NULL AND total <> 0 THEN greatest("{c}" / total, 1e-4) END AS "s_{c}"' for c in _PARTS) + """ FROM wide),
whole AS (SELECT *, """ + " + ".join(f'"s_{c}"' for c in _PARTS) + """ AS w FROM clipped),
shares AS (SELECT entity, period, total, """ + ", ".join(f'"s_{c}" / w AS "share_{c}"' for c in _PARTS) + """ FROM whole),
logs AS (SELECT *, (""" + " + ".join(f'ln("share_{c}")' for c in _PARTS) + """) / 6 AS m FROM shares),
medians AS (SELECT period, median(total) AS med FROM wide GROUP BY 1),
raw AS (SELECT entity, l.period AS period, total, """ + ", ".join(f'"share_{c}"' for c in _PARTS) + ", " + ", ".join(f'ln("share_{c}") - m AS "clr_{c}"' for c in _PARTS) + """, ln(total / med) AS log_level_rel
        FROM logs l JOIN medians USING (period))"""

Z_SQL = RAW_SQL + """,
smooth AS (SELECT entity, period, """ + ", ".join(f'avg("{c}") OVER w AS "{c}"' for c in CLR) + """ FROM raw
           WINDOW w AS (PARTITION BY entity ORDER BY period RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)),
moments AS (SELECT period, """ + ", ".join(f'avg("{c}") AS "m_{c}", CASE WHEN stddev_pop("{c}") > 0 THEN stddev_pop("{c}") ELSE 1.0 END AS "s_{c}"' for c in CLR) + """ FROM smooth GROUP BY 1),
z AS (SELECT entity, s.period AS period, """ + ", ".join(f'("{c}" - "m_{c}") / "s_{c}" AS "{c}"' for c in CLR) + """ FROM smooth s JOIN moments USING (period)),
full_history AS (SELECT entity FROM wide GROUP BY 1 HAVING count(*) >= 28)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _round(columns, digits: int = 6) -> str:
    return ", ".join(f'round("{c}", {digits}) + 0.0 AS "{c}"' for c in columns)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivoted = panel.pivot(tables.sales_panel(spark, sf_dir), CATEGORIES)
    return panel.with_residual(panel.with_total(pivoted, CATEGORIES, TOTAL).drop(CATEGORIES[-1]), NAMED, TOTAL, RESIDUAL)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [*NAMED, RESIDUAL]
    return panel.relative_level(panel.clr(panel.shares(wide(spark, sf_dir), parts, TOTAL), parts), TOTAL)


def zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wide(spark, sf_dir)
    return panel.features(raw(spark, sf_dir), CLR, 3, panel.full_history(rows, 28))


def panel_pivot(spark, sf_dir):
    return rounded(wide(spark, sf_dir).select("entity", "period", *NAMED, TOTAL, RESIDUAL), 2)


def panel_full_history(spark, sf_dir):
    rows = panel.pivot(tables.order_panel(spark, sf_dir), ["1-URGENT"], "sum")
    return panel.full_history(rows, 7)


def clr_features(spark, sf_dir):
    return rounded(raw(spark, sf_dir).select("entity", "period", *(f"share_{c}" for c in _PARTS), *CLR))


def causal_zscore(spark, sf_dir):
    return rounded(zscores(spark, sf_dir).select("entity", "period", *CLR))


def causal_mean_gaps(spark, sf_dir):
    return rounded(panel.causal_mean(tables.event_days(spark, sf_dir).select("entity", "period", "value"), ["value"], 3), 4)


def densified_smoothing(spark, sf_dir):
    days = tables.event_days(spark, sf_dir).select("entity", "period", "value")
    return rounded(panel.causal_mean(panel.densify(days, ["value"]), ["value"], 3), 4)


def log_growth(spark, sf_dir):
    return rounded(panel.log_growth(wide(spark, sf_dir), TOTAL))


def growth_window(spark, sf_dir):
    rows = panel.growth_window(panel.log_growth(wide(spark, sf_dir), TOTAL), 4, 3)
    return rounded(rows.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum("growth").alias("total_growth"), F.min("period").alias("first_period")), 5)


def period_average(spark, sf_dir):
    return rounded(panel.period_average(zscores(spark, sf_dir), CLR, 1997 * 4 + 1, 1997 * 4 + 4))


def metric_summary(spark, sf_dir):
    return rounded(panel.median_iqr(tables.sales_panel(spark, sf_dir), ["category", "period"]), 4)


def panel_audit(spark, sf_dir):
    return rounded(panel.audit(tables.sales_panel(spark, sf_dir)), 4)


def median_change(spark, sf_dir):
    return rounded(panel.median_change(tables.sales_panel(spark, sf_dir), "value"))


def pivot_mean(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("period"), F.col("event_type").alias("category"), "value")
    return rounded(panel.pivot(rows, EVENT_TYPES, "mean"), 4)


EVENT_TYPES = ("click", "login", "logout", "purchase", "view")
EVENT_DAYS_SQL = """
days AS (SELECT user_id AS entity, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS period, sum(value) AS value, arg_max(event_type, ts) AS label
         FROM events GROUP BY 1, 2)"""

QUERIES = {
    "panel_pivot": (panel_pivot, f"WITH {WIDE_SQL} SELECT entity, period, {_round((*NAMED, 'total', 'other'), 2)} FROM wide"),
    "panel_full_history": (panel_full_history, "SELECT o_custkey AS entity FROM orders GROUP BY 1 HAVING count(DISTINCT year(o_orderdate)) >= 7"),
    "clr_features": (clr_features, f"WITH {RAW_SQL} SELECT entity, period, {_round([*(f'share_{c}' for c in _PARTS), *CLR])} FROM raw"),
    "causal_zscore": (causal_zscore, f"WITH {Z_SQL} SELECT entity, period, {_round(CLR)} FROM z WHERE entity IN (SELECT entity FROM full_history)"),
    "causal_mean_gaps": (causal_mean_gaps, f"WITH {EVENT_DAYS_SQL} SELECT entity, period, round(avg(value) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), 4) + 0.0 AS value FROM days"),
    "densified_smoothing": (densified_smoothing, f"""WITH {EVENT_DAYS_SQL}, grid AS (SELECT entity, period FROM (SELECT DISTINCT entity FROM days) CROSS JOIN (SELECT DISTINCT period FROM days)),
        dense AS (SELECT g.entity, g.period, d.value FROM grid g LEFT JOIN days d ON g.entity = d.entity AND g.period = d.period)
        SELECT entity, period, round(avg(value) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), 4) + 0.0 AS value FROM dense"""),
    "log_growth": (log_growth, f"""WITH {WIDE_SQL}, steps AS (SELECT entity, period, CASE WHEN lag(period) OVER o = period - 1 AND total > 0 AND lag(total) OVER o > 0 THEN ln(total) - ln(lag(total) OVER o) END AS change FROM wide WINDOW o AS (PARTITION BY entity ORDER BY period)),
        med AS (SELECT period, median(change) AS m FROM steps WHERE change IS NOT NULL GROUP BY 1)
        SELECT entity, s.period AS period, round(change - m, 6) + 0.0 AS growth FROM steps s JOIN med USING (period) WHERE change IS NOT NULL"""),
    "growth_window": (growth_window, f"""WITH {WIDE_SQL}, steps AS (SELECT entity, period, CASE WHEN lag(period) OVER o = period - 1 AND total > 0 AND lag(total) OVER o > 0 THEN ln(total) - ln(lag(total) OVER o) END AS change FROM wide WINDOW o AS (PARTITION BY entity ORDER BY period)),
        med AS (SELECT period, median(change) AS m FROM steps WHERE change IS NOT NULL GROUP BY 1),
        g AS (SELECT entity, s.period AS period, change - m AS growth FROM steps s JOIN med USING (period) WHERE change IS NOT NULL),
        t AS (SELECT DISTINCT period AS t FROM g)
        SELECT t, count(*) AS n, round(sum(growth), 5) + 0.0 AS total_growth, min(period) AS first_period FROM g JOIN t ON g.period > t.t - 4 AND g.period <= t.t GROUP BY t HAVING count(DISTINCT period) >= 3"""),
    "period_average": (period_average, f"WITH {Z_SQL} SELECT entity, {', '.join(f'round(avg({chr(34)}{c}{chr(34)}), 6) + 0.0 AS {chr(34)}{c}{chr(34)}' for c in CLR)} FROM z WHERE entity IN (SELECT entity FROM full_history) AND period BETWEEN 7989 AND 7992 GROUP BY entity"),
    "metric_summary": (metric_summary, f"WITH {PANEL_SQL} SELECT category, period, round(quantile_cont(value, 0.5), 4) + 0.0 AS median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) + 0.0 AS iqr FROM panel GROUP BY 1, 2"),
    "panel_audit": (panel_audit, f"""WITH {PANEL_SQL}, cells AS (SELECT count(DISTINCT entity) AS e, count(DISTINCT period) AS p FROM panel)
        SELECT category, count(*) AS n_rows, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_repeated, count(DISTINCT period) AS n_periods, count(DISTINCT entity) AS n_entities,
               round(min(value), 4) + 0.0 AS lowest, round(median(value), 4) + 0.0 AS middle, round(max(value), 4) + 0.0 AS highest, round(count(*) / CAST(max(e * p) AS DOUBLE), 4) + 0.0 AS coverage FROM panel, cells GROUP BY category"""),
    "median_change": (median_change, f"""WITH {PANEL_SQL}, m AS (SELECT category, period, median(value) AS middle FROM panel GROUP BY 1, 2)
        SELECT category, period, round(middle, 6) + 0.0 AS middle, round(CASE WHEN lag(middle) OVER w <> 0 THEN middle / lag(middle) OVER w - 1 END, 6) + 0.0 AS change FROM m WINDOW w AS (PARTITION BY category ORDER BY period)"""),
    "pivot_mean": (pivot_mean, "SELECT user_id AS entity, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS period, " + ", ".join(f"round(avg(CASE WHEN event_type = '{c}' THEN value END), 4) + 0.0 AS {c}" for c in EVENT_TYPES) + " FROM events GROUP BY 1, 2"),
}
