"""Queries on label series: the type of a supplier in a quarter is the return flag with the largest price."""

from __future__ import annotations

from pyspark.sql import functions as F

from netpanel.operators import labels as lab
from netpanel.plans.panel_queries import EVENT_DAYS_SQL, rounded
from netpanel.sources import tables

LABELS_SQL = """
flags AS (SELECT l_suppkey AS entity, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) AS BIGINT) AS period, l_returnflag AS flag, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2, 3),
labels AS (SELECT entity, period, CAST(CASE arg_max(flag, v) WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS INTEGER) AS label FROM flags GROUP BY 1, 2)"""

RUNS_SQL = LABELS_SQL + """,
marks AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY entity ORDER BY period) THEN 0 ELSE 1 END AS new FROM labels),
islands AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY period) AS run FROM marks),
runs AS (SELECT entity, run, min(label) AS label, min(period) AS start, count(*) AS length, max(period) AS last FROM islands GROUP BY 1, 2)"""

SURE_SQL = RUNS_SQL + """,
sure AS (SELECT *, lag(label) OVER (PARTITION BY entity ORDER BY start) AS before FROM runs WHERE length >= 3),
ends AS (SELECT r.entity AS entity, arg_max(r.label, r.length * 100000 - r.start) AS longest, arg_max(r.start, r.length * 100000 - r.start) AS longest_start, arg_max(r.label, r.start) AS tail_label, max(r.start) AS tail_start, arg_max(r.length, r.start) AS tail_length FROM runs r GROUP BY 1),
last_sure AS (SELECT entity, arg_max(label, start) AS s, arg_min(label, start) AS f FROM sure GROUP BY 1),
changes AS (SELECT entity, 'confirmed' AS kind, before AS from_label, label AS to_label, start AS period, length AS run_length, start + 2 AS known_at FROM sure WHERE before IS NOT NULL AND before <> label
            UNION ALL SELECT e.entity, 'candidate', coalesce(s, longest), tail_label, tail_start, tail_length, NULL FROM ends e LEFT JOIN last_sure l ON e.entity = l.entity
            WHERE tail_length < 3 AND tail_label <> coalesce(s, longest) AND (s IS NOT NULL OR tail_start > longest_start)),
marked AS (SELECT b.entity AS entity, b.period AS period, b.label AS label, s.label AS here FROM labels b LEFT JOIN sure s ON s.entity = b.entity AND s.start = b.period),
grouped AS (SELECT *, count(here) OVER (PARTITION BY entity ORDER BY period) AS g FROM marked),
series AS (SELECT q.entity AS entity, period, label, coalesce(max(here) OVER (PARTITION BY q.entity, g), f, longest) AS confirmed FROM grouped q JOIN ends e ON e.entity = q.entity LEFT JOIN last_sure l ON l.entity = q.entity)"""

OVERLAP_SQL = LABELS_SQL + """,
sizes AS (SELECT period, label, count(*) AS size FROM labels GROUP BY 1, 2),
common AS (SELECT a.period AS period, a.label AS from_label, b.label AS to_label, count(*) AS n FROM labels a JOIN labels b ON b.entity = a.entity AND b.period = a.period + 1 GROUP BY 1, 2, 3),
pairs AS (SELECT c.*, x.size AS from_size, y.size AS to_size, n / CAST(x.size + y.size - n AS DOUBLE) AS jaccard FROM common c JOIN sizes x ON x.period = c.period AND x.label = from_label JOIN sizes y ON y.period = c.period + 1 AND y.label = to_label)"""


def types(spark, sf_dir):
    """entity, period, label of every supplier and quarter."""
    rows = tables.table(spark, sf_dir, "lineitem")
    period = (F.year("l_shipdate") * 4 + F.quarter("l_shipdate")).cast("long")
    sums = rows.groupBy(F.col("l_suppkey").alias("entity"), period.alias("period"), "l_returnflag").agg(F.sum("l_extendedprice").alias("v"))
    label = F.max_by("l_returnflag", "v")
    return sums.groupBy("entity", "period").agg(label.alias("flag")).select("entity", "period", F.when(F.col("flag") == "A", 0).when(F.col("flag") == "N", 1).otherwise(2).cast("int").alias("label"))


def run_lengths(spark, sf_dir):
    return lab.runs(types(spark, sf_dir)).select("entity", "label", "start", "length", "last")


def event_runs(spark, sf_dir):
    return lab.runs(lab.encoded(tables.event_days(spark, sf_dir).select("entity", "period", "label"))).select("entity", "label", "start", "length", "last")


def remaining_run(spark, sf_dir):
    return lab.remaining(types(spark, sf_dir))


def transition_matrix(spark, sf_dir):
    return rounded(lab.transitions(types(spark, sf_dir)))


def transition_matrix_dense(spark, sf_dir):
    days = lab.encoded(tables.event_days(spark, sf_dir).select("entity", "period", "label"))
    return rounded(lab.densified_transitions(lab.transitions(days, 7), days.select("label").distinct()))


def shorrocks(spark, sf_dir):
    rows = types(spark, sf_dir)
    both = [lab.shorrocks(lab.transitions(rows, lag)).withColumn("lag", F.lit(lag)) for lag in (1, 4)]
    return rounded(both[0].unionByName(both[1]))


def stability_curve(spark, sf_dir):
    return rounded(lab.stability_curve(types(spark, sf_dir)))


def confirmed_changes(spark, sf_dir):
    return lab.confirmed_changes(types(spark, sf_dir))


def confirmed_series(spark, sf_dir):
    return lab.confirmed_series(types(spark, sf_dir))


def change_decomposition(spark, sf_dir):
    return rounded(lab.change_decomposition(types(spark, sf_dir), 3, 4))


def calendar_lift(spark, sf_dir):
    rows = types(spark, sf_dir)
    steps = rows.join(rows.select("entity", (F.col("period") + 1).alias("period")), ["entity", "period"])
    events = lab.confirmed_changes(rows).filter("kind = 'confirmed'")
    return rounded(lab.calendar_lift(events, steps, F.pmod(F.col("period") - 1, F.lit(4)).cast("int") + 1))


def modal_type(spark, sf_dir):
    return rounded(lab.modal_label(types(spark, sf_dir)))


def trajectories(spark, sf_dir):
    return lab.trajectories(types(spark, sf_dir))


def cluster_sizes(spark, sf_dir):
    return lab.sizes_over_time(types(spark, sf_dir))


def jaccard_pairs(spark, sf_dir):
    return rounded(lab.overlaps(types(spark, sf_dir)))


def lifecycle_events(spark, sf_dir):
    rows = lab.lifecycle(types(spark, sf_dir), 0.25)
    return rounded(rows.withColumns({"from_ids": F.array_join(F.transform("from_ids", lambda x: x.cast("string")), ","), "to_ids": F.array_join(F.transform("to_ids", lambda x: x.cast("string")), ",")}))


def renumbered_types(spark, sf_dir):
    return lab.renumbered(types(spark, sf_dir), 7990).groupBy("label", "number").agg(F.count(F.lit(1)).alias("n"))


def type_flows(spark, sf_dir):
    return rounded(lab.flows(types(spark, sf_dir), 7985, 7992))


def recurrent_changes(spark, sf_dir):
    rows = types(spark, sf_dir).withColumn("from_label", F.lag("label").over(lab.series())).withColumnRenamed("label", "to_label")
    return lab.recurrent(rows.filter("from_label != to_label"), 4)


def event_recall(spark, sf_dir):
    """Confirmed changes found with min_run 2 against those with min_run 3."""
    rows = types(spark, sf_dir)
    sure = lambda n: lab.confirmed_changes(rows, n).filter("kind = 'confirmed'")
    return rounded(lab.event_recall(sure(2), sure(3)))


def aligned_types(spark, sf_dir):
    return lab.align_sequence(types(spark, sf_dir)).groupBy("period", "aligned").agg(F.count(F.lit(1)).alias("n"))


def label_contingency(spark, sf_dir):
    rows = types(spark, sf_dir)
    return lab.contingency(rows.join(lab.modal_label(rows).select("entity", F.col("label").alias("modal")), "entity"), "label", "modal")


_SURE2 = SURE_SQL.replace("length >= 3", "length >= 2")

def first_events(spark, sf_dir):
    """The first 200 changes, confirmed or not, as a page lists them."""
    return lab.first_events(lab.confirmed_changes(types(spark, sf_dir)).select("entity", "period", "kind", "from_label", "to_label"), 200)


QUERIES = {
    "first_events": (first_events, f"WITH {SURE_SQL} SELECT entity, period, kind, from_label, to_label FROM changes ORDER BY period, entity, kind, from_label, to_label LIMIT 200"),
    "run_lengths": (run_lengths, f"WITH {RUNS_SQL} SELECT entity, label, start, length, last FROM runs"),
    "event_runs": (event_runs, f"""WITH {EVENT_DAYS_SQL}, codes AS (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT label FROM days)),
        l AS (SELECT entity, period, code AS label FROM days JOIN codes USING (label)),
        m AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY entity ORDER BY period) THEN 0 ELSE 1 END AS new FROM l), i AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY period) AS run FROM m)
        SELECT entity, min(label) AS label, min(period) AS start, count(*) AS length, max(period) AS last FROM i GROUP BY entity, run"""),
    "remaining_run": (remaining_run, f"WITH {RUNS_SQL} SELECT entity, period, label, count(*) OVER (PARTITION BY entity, run) - row_number() OVER (PARTITION BY entity, run ORDER BY period) + 1 AS remaining FROM islands"),
    "transition_matrix": (transition_matrix, f"""WITH {LABELS_SQL}, c AS (SELECT a.label AS from_label, b.label AS to_label, count(*) AS n FROM labels a JOIN labels b ON b.entity = a.entity AND b.period = a.period + 1 GROUP BY 1, 2)
        SELECT from_label, to_label, n, round(n / CAST(sum(n) OVER (PARTITION BY from_label) AS DOUBLE), 6) + 0.0 AS p FROM c"""),
    "transition_matrix_dense": (transition_matrix_dense, f"""WITH {EVENT_DAYS_SQL}, codes AS (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT label FROM days)),
        l AS (SELECT entity, period, code AS label FROM days JOIN codes USING (label)), c AS (SELECT a.label AS f, b.label AS t, count(*) AS n FROM l a JOIN l b ON b.entity = a.entity AND b.period = a.period + 7 GROUP BY 1, 2),
        g AS (SELECT a.code AS from_label, b.code AS to_label FROM codes a CROSS JOIN codes b), d AS (SELECT from_label, to_label, coalesce(n, 0) AS n FROM g LEFT JOIN c ON f = from_label AND t = to_label)
        SELECT from_label, to_label, n, round(CASE WHEN sum(n) OVER (PARTITION BY from_label) > 0 THEN n / CAST(sum(n) OVER (PARTITION BY from_label) AS DOUBLE) END, 6) + 0.0 AS p FROM d"""),
    "shorrocks": (shorrocks, f"""WITH {LABELS_SQL}, c AS (SELECT g.lag AS lag, a.label AS f, b.label AS t, count(*) AS n FROM labels a JOIN (SELECT 1 AS lag UNION ALL SELECT 4) g ON true JOIN labels b ON b.entity = a.entity AND b.period = a.period + g.lag GROUP BY 1, 2, 3),
        p AS (SELECT lag, f, t, n / CAST(sum(n) OVER (PARTITION BY lag, f) AS DOUBLE) AS p FROM c)
        SELECT lag, count(DISTINCT f) AS k, round((count(DISTINCT f) - sum(CASE WHEN f = t THEN p ELSE 0.0 END)) / (count(DISTINCT f) - 1), 6) + 0.0 AS mobility FROM p GROUP BY lag"""),
    "stability_curve": (stability_curve, f"""WITH {LABELS_SQL}, c AS (SELECT *, CASE WHEN label <> lag(label) OVER (PARTITION BY entity ORDER BY period) THEN 1 ELSE 0 END AS c FROM labels), e AS (SELECT *, max(c) OVER (PARTITION BY entity ORDER BY period) AS ever FROM c)
        SELECT period, round(1 - avg(ever), 6) + 0.0 AS unchanged FROM e GROUP BY 1"""),
    "confirmed_changes": (confirmed_changes, f"WITH {SURE_SQL} SELECT entity, kind, from_label, to_label, period, run_length, known_at FROM changes"),
    "confirmed_series": (confirmed_series, f"WITH {SURE_SQL} SELECT entity, period, label, confirmed FROM series"),
    "change_decomposition": (change_decomposition, f"""WITH {SURE_SQL},
        rem AS (SELECT entity, period, count(*) OVER (PARTITION BY entity, run) - row_number() OVER (PARTITION BY entity, run ORDER BY period) + 1 AS remaining FROM islands),
        e AS (SELECT entity, max(period) AS last FROM labels GROUP BY 1),
        b AS (SELECT entity, period, label, confirmed, lag(label) OVER (PARTITION BY entity ORDER BY period) AS prev, lag(confirmed) OVER (PARTITION BY entity ORDER BY period) AS cprev FROM series),
        r AS (SELECT b.entity AS entity, b.period AS period, prev, label, confirmed <> cprev AS sure, remaining, b.period + remaining > last AS touches FROM b JOIN rem ON rem.entity = b.entity AND rem.period = b.period JOIN e ON e.entity = b.entity WHERE prev <> label),
        k AS (SELECT r.*, CASE WHEN sure THEN 1 WHEN remaining < 3 AND touches THEN 4 WHEN remaining < 3 THEN 2 ELSE 3 END AS kind,
              EXISTS (SELECT 1 FROM r o WHERE o.entity = r.entity AND o.prev = r.prev AND o.label = r.label AND (o.period = r.period - 4 OR o.period = r.period + 4)) AS recurs FROM r),
        g AS (SELECT period, count(*) AS n_raw, count(CASE WHEN kind = 1 THEN 1 END) AS n_confirmed, count(CASE WHEN kind = 2 THEN 1 END) AS n_noise_short, count(CASE WHEN kind = 3 THEN 1 END) AS n_noise_return, count(CASE WHEN kind = 4 THEN 1 END) AS n_candidate, count(CASE WHEN recurs THEN 1 END) AS n_recurrent
              FROM k GROUP BY ROLLUP (period))
        SELECT g.*, round(n_raw / CAST((SELECT count(DISTINCT entity) FROM labels) AS DOUBLE), 6) + 0.0 AS share_raw, round((n_noise_short + n_noise_return) / CAST(n_raw AS DOUBLE), 6) + 0.0 AS noise_share, round(n_confirmed / CAST(n_raw AS DOUBLE), 6) + 0.0 AS confirmed_share FROM g"""),
    "calendar_lift": (calendar_lift, f"""WITH {SURE_SQL}, s AS (SELECT CAST((b.period - 1) % 4 AS INTEGER) + 1 AS place, count(*) AS steps FROM labels a JOIN labels b ON b.entity = a.entity AND b.period = a.period + 1 GROUP BY 1),
        v AS (SELECT CAST((period - 1) % 4 AS INTEGER) + 1 AS place, count(*) AS n FROM changes WHERE kind = 'confirmed' GROUP BY 1), j AS (SELECT s.place AS place, coalesce(n, 0) AS n, steps FROM s LEFT JOIN v ON v.place = s.place), t AS (SELECT sum(n) AS an, sum(steps) AS ast FROM j)
        SELECT place, n, round(n / CAST(an AS DOUBLE), 6) + 0.0 AS share, round(steps / CAST(ast AS DOUBLE), 6) + 0.0 AS expected, round(n / CAST(an AS DOUBLE) / (steps / CAST(ast AS DOUBLE)), 6) + 0.0 AS lift FROM j, t"""),
    "modal_type": (modal_type, f"""WITH {LABELS_SQL}, l AS (SELECT entity, arg_max(label, period) AS last, count(*) AS a FROM labels GROUP BY 1), c AS (SELECT entity, label, count(*) AS n FROM labels GROUP BY 1, 2),
        r AS (SELECT c.entity AS entity, label, n, a, row_number() OVER (PARTITION BY c.entity ORDER BY n DESC, CASE WHEN label = last THEN 0 ELSE 1 END, label) AS k FROM c JOIN l ON l.entity = c.entity)
        SELECT entity, label, round(n / CAST(a AS DOUBLE), 6) + 0.0 AS share FROM r WHERE k = 1"""),
    "trajectories": (trajectories, f"""WITH {LABELS_SQL}, c AS (SELECT *, CASE WHEN label <> lag(label) OVER (PARTITION BY entity ORDER BY period) THEN 1 ELSE 0 END AS c FROM labels)
        SELECT entity, string_agg(CAST(label AS VARCHAR), ',' ORDER BY period) AS trajectory, arg_min(label, period) AS first_label, arg_max(label, period) AS last_label, CAST(sum(c) AS BIGINT) AS n_changes, max(CASE WHEN c = 1 THEN period END) AS last_change FROM c GROUP BY 1"""),
    "cluster_sizes": (cluster_sizes, f"""WITH {LABELS_SQL}, g AS (SELECT label, period FROM (SELECT DISTINCT label FROM labels) CROSS JOIN (SELECT DISTINCT period FROM labels)), c AS (SELECT label, period, count(*) AS n FROM labels GROUP BY 1, 2)
        SELECT g.label AS label, g.period AS period, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.label = g.label AND c.period = g.period"""),
    "jaccard_pairs": (jaccard_pairs, f"WITH {OVERLAP_SQL} SELECT period, from_label, to_label, n, from_size, to_size, round(jaccard, 6) + 0.0 AS jaccard FROM pairs"),
    "lifecycle_events": (lifecycle_events, f"""WITH {OVERLAP_SQL}, m AS (SELECT *, count(*) OVER (PARTITION BY period, from_label) AS outs, count(*) OVER (PARTITION BY period, to_label) AS ins FROM pairs WHERE jaccard >= 0.25),
        steps AS (SELECT DISTINCT a.period AS period FROM labels a JOIN labels b ON b.period = a.period + 1),
        v AS (SELECT period + 1 AS period, 'continue' AS kind, CAST(from_label AS VARCHAR) AS from_ids, CAST(to_label AS VARCHAR) AS to_ids, jaccard, from_size AS size_from, to_size AS size_to FROM m WHERE ins = 1 AND outs = 1
          UNION ALL SELECT period + 1, 'merge', string_agg(CAST(from_label AS VARCHAR), ',' ORDER BY from_label), CAST(to_label AS VARCHAR), max(jaccard), CAST(sum(from_size) AS BIGINT), max(to_size) FROM m WHERE ins > 1 GROUP BY period, to_label
          UNION ALL SELECT period + 1, 'split', CAST(from_label AS VARCHAR), string_agg(CAST(to_label AS VARCHAR), ',' ORDER BY to_label), max(jaccard), max(from_size), CAST(sum(to_size) AS BIGINT) FROM m WHERE outs > 1 GROUP BY period, from_label
          UNION ALL SELECT s.period + 1, 'death', CAST(s.label AS VARCHAR), '', coalesce((SELECT max(jaccard) FROM pairs p WHERE p.period = s.period AND p.from_label = s.label), 0.0), s.size, 0 FROM sizes s JOIN steps t ON t.period = s.period
                    WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.period = s.period AND m.from_label = s.label)
          UNION ALL SELECT s.period, 'birth', '', CAST(s.label AS VARCHAR), coalesce((SELECT max(jaccard) FROM pairs p WHERE p.period = s.period - 1 AND p.to_label = s.label), 0.0), 0, s.size FROM sizes s JOIN steps t ON t.period = s.period - 1
                    WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.period = s.period - 1 AND m.to_label = s.label))
        SELECT period, kind, from_ids, to_ids, round(jaccard, 6) + 0.0 AS jaccard, size_from, size_to FROM v"""),
    "renumbered_types": (renumbered_types, f"""WITH {LABELS_SQL}, s AS (SELECT label, count(CASE WHEN period = 7990 THEN 1 END) AS r, count(*) AS n FROM labels GROUP BY 1)
        SELECT label, CAST(row_number() OVER (ORDER BY CASE WHEN r > 0 THEN 0 ELSE 1 END, CASE WHEN r > 0 THEN r ELSE n END DESC, label) - 1 AS INTEGER) AS number, n FROM s"""),
    "type_flows": (type_flows, f"""WITH {LABELS_SQL}, c AS (SELECT a.label AS from_label, b.label AS to_label, count(*) AS n FROM labels a JOIN labels b ON b.entity = a.entity WHERE a.period = 7985 AND b.period = 7992 GROUP BY 1, 2)
        SELECT from_label, to_label, n, round(n / CAST(sum(n) OVER (PARTITION BY from_label) AS DOUBLE), 6) + 0.0 AS share FROM c"""),
    "recurrent_changes": (recurrent_changes, f"""WITH {LABELS_SQL}, c AS (SELECT entity, period, lag(label) OVER (PARTITION BY entity ORDER BY period) AS from_label, label AS to_label FROM labels), d AS (SELECT * FROM c WHERE from_label <> to_label)
        SELECT entity, from_label, to_label, period, EXISTS (SELECT 1 FROM d o WHERE o.entity = d.entity AND o.from_label = d.from_label AND o.to_label = d.to_label AND (o.period = d.period + 4 OR o.period = d.period - 4)) AS recurs FROM d"""),
    "event_recall": (event_recall, f"""WITH {SURE_SQL}, sure2 AS (SELECT *, lag(label) OVER (PARTITION BY entity ORDER BY start) AS before FROM runs WHERE length >= 2),
        t AS (SELECT DISTINCT entity, label AS to_label, start AS period FROM sure WHERE before <> label), f AS (SELECT DISTINCT entity, label AS to_label, start AS period FROM sure2 WHERE before <> label),
        tk AS (SELECT DISTINCT entity, to_label FROM t), fk AS (SELECT DISTINCT entity, to_label FROM f), h AS (SELECT count(*) AS hits FROM tk JOIN fk USING (entity, to_label)), x AS (SELECT count(*) AS exact FROM t JOIN f USING (entity, to_label, period))
        SELECT (SELECT count(*) FROM tk) AS n_truth, (SELECT count(*) FROM fk) AS n_found, round(hits / CAST((SELECT count(*) FROM tk) AS DOUBLE), 6) + 0.0 AS recall, round(hits / CAST((SELECT count(*) FROM fk) AS DOUBLE), 6) + 0.0 AS precision, round(exact / CAST((SELECT count(*) FROM t) AS DOUBLE), 6) + 0.0 AS exact_recall FROM h, x"""),
    # of the six ways to match three types, that of the largest total similarity; names are handed on from quarter to quarter
    "aligned_types": (aligned_types, f"""WITH RECURSIVE {LABELS_SQL}, c AS (SELECT a.period AS period, a.label AS x, b.label AS y, CAST(count(*) AS DOUBLE) AS n FROM labels a JOIN labels b ON b.entity = a.entity AND b.period = a.period + 1 GROUP BY 1, 2, 3),
        j AS (SELECT period, x, y, n / (sum(n) OVER (PARTITION BY period, x) + sum(n) OVER (PARTITION BY period, y) - n) AS s FROM c),
        best AS (SELECT a.period AS period, arg_max([a.y, b.y, d.y], a.s + b.s + d.s) AS y FROM j a JOIN j b ON b.period = a.period AND b.y <> a.y JOIN j d ON d.period = a.period AND d.y <> a.y AND d.y <> b.y WHERE a.x = 0 AND b.x = 1 AND d.x = 2 GROUP BY 1),
        names(period, label, aligned) AS (SELECT DISTINCT period, label, label FROM labels WHERE period = (SELECT min(period) FROM labels) UNION ALL SELECT n.period + 1, y[n.label + 1], aligned FROM names n JOIN best ON best.period = n.period)
        SELECT l.period AS period, aligned, count(*) AS n FROM labels l JOIN names n ON n.period = l.period AND n.label = l.label GROUP BY 1, 2"""),
    "label_contingency": (label_contingency, f"""WITH {LABELS_SQL}, l AS (SELECT entity, arg_max(label, period) AS last FROM labels GROUP BY 1), c AS (SELECT entity, label, count(*) AS n FROM labels GROUP BY 1, 2),
        r AS (SELECT c.entity AS entity, label, row_number() OVER (PARTITION BY c.entity ORDER BY n DESC, CASE WHEN label = last THEN 0 ELSE 1 END, label) AS k FROM c JOIN l ON l.entity = c.entity)
        SELECT b.label AS label, r.label AS modal, count(*) AS n FROM labels b JOIN r ON r.entity = b.entity AND k = 1 GROUP BY 1, 2"""),
}
