"""Queries on statistics, rankings, profiles and names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from netpanel.operators import indices, interpret, stats, vectors
from netpanel.plans import graph_queries
from netpanel.plans.entity_queries import in_sql, relation
from netpanel.plans.label_queries import LABELS_SQL, types
from netpanel.plans.panel_queries import CLR, PANEL_SQL, RAW_SQL, Z_SQL, _PARTS, raw, rounded, zscores
from netpanel.sources import tables

_RATIO = "CAST(count(CASE WHEN {} THEN 1 END) AS DOUBLE) / CAST(count(*) AS DOUBLE)".format
# method, metric, value: figures of each nation's lines under the names of metrics, some with ties.
SCORES = f"""WITH b AS (SELECT 'm' || CAST(s_nationkey AS STRING) AS method, {_RATIO("l_returnflag = 'R'")} AS sw, CAST(count(*) AS DOUBLE) AS ch, CAST(max(l_linenumber) AS DOUBLE) AS sd, {_RATIO("l_linestatus = 'O'")} AS avi, {_RATIO("l_quantity <= 25")} AS avu, CAST(count(DISTINCT l_quantity) AS DOUBLE) AS q
    FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey GROUP BY s_nationkey)
    SELECT method, 'SW' AS metric, sw AS value FROM b UNION ALL SELECT method, 'CH', ch FROM b UNION ALL SELECT method, 'S_Dbw', sd FROM b UNION ALL SELECT method, 'AVI', avi FROM b UNION ALL SELECT method, 'AVU', avu FROM b UNION ALL SELECT method, 'Q', q FROM b"""
# method, k, metric, period, z; and method, k, ari, which the largest k lacks.
Z_ROWS = f"""WITH b AS (SELECT l_returnflag AS method, CAST(3 + l_linenumber AS BIGINT) AS k, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) AS BIGINT) AS period, {_RATIO("l_quantity <= 25")} AS avu, {_RATIO("l_discount <= 0.05")} AS sw FROM {{lineitem}} GROUP BY 1, 2, 3)
    SELECT method, k, 'AVU' AS metric, period, avu AS z FROM b UNION ALL SELECT method, k, 'SW', period, sw FROM b"""
ARI_ROWS = f"SELECT l_returnflag AS method, CAST(3 + l_linenumber AS BIGINT) AS k, {_RATIO('l_tax <= 0.04')} AS ari FROM {{lineitem}} WHERE l_linenumber < 7 GROUP BY l_returnflag, l_linenumber, year(l_shipdate)"
# label, level, food: shares of each nation's customers.
MEANS = f"SELECT c_nationkey AS label, {_RATIO('c_acctbal > 5000')} AS level, {_RATIO("c_mktsegment = 'BUILDING'")} AS food FROM {{customer}} GROUP BY c_nationkey"
RULES = [{"name": "rich", "when": {"level": {"min": "high"}}}, {"name": "poor", "when": {"level": {"max": 0.4}, "food": {"min": 0.2}}}]
THRESHOLDS = {"high": 0.5}
#: The rule that a nation's name came from.
NAMED = {k: k % 2 for k in range(25)}
BOUNDS_SQL = ", ".join(b for k, rule in NAMED.items() for b in ([f"({k}, 'level', 'min', CAST(0.5 AS DOUBLE))"] if rule == 0 else [f"({k}, 'level', 'max', CAST(0.4 AS DOUBLE))", f"({k}, 'food', 'min', CAST(0.2 AS DOUBLE))"]))
DIRECTIONS_SQL = "dir(metric, d) AS (VALUES " + ", ".join(f"('{m}', CAST({d} AS DOUBLE))" for m, d in indices.DIRECTION.items()) + ")"


def _mix_sql(*keys: str) -> str:
    x = "CAST(17 AS BIGINT)"
    for k in keys:
        x = f"(({x} * 31 + {k}) % 2147483648)"
    for _ in range(3):
        x = f"(({x} * 1103515245 + 12345) % 2147483648)"
        x = f"xor({x}, {x} >> 13)"
    return x


def oriented_metrics(spark, sf_dir):
    return rounded(indices.oriented(relation(spark, sf_dir, SCORES)))


def borda(spark, sf_dir):
    return rounded(stats.borda(relation(spark, sf_dir, SCORES)))


def threshold_rank(spark, sf_dir):
    return stats.threshold_rank(relation(spark, sf_dir, SCORES), 3)


def best_by_metric(spark, sf_dir):
    return rounded(interpret.best_by_metric(relation(spark, sf_dir, SCORES)))


def k_selection(spark, sf_dir):
    return rounded(stats.k_selection(relation(spark, sf_dir, Z_ROWS), relation(spark, sf_dir, ARI_ROWS)))


def kruskal_eta(spark, sf_dir):
    return rounded(stats.kruskal(tables.table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority").drop("p"))


def kruskal_ties(spark, sf_dir):
    """Quantities by return flag, for each line status: many equal values."""
    return rounded(stats.kruskal(tables.table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag", ["l_linestatus"]).drop("p"))


def cramers_v(spark, sf_dir):
    return rounded(stats.cramers_v(tables.table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus").drop("p"))


def average_ranks(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    return rows.withColumn("rank", stats.average_rank("p_size", ["p_brand"]))


def permuted_labels(spark, sf_dir):
    """The types of all quarters, dealt anew among suppliers and quarters (one number for both)."""
    rows = types(spark, sf_dir).select((F.col("entity") * 100000 + F.col("period")).alias("entity"), "label")
    return stats.permuted(rows, 20, 7)


def permutation_null(spark, sf_dir):
    edges, rows = graph_queries.graph(spark, sf_dir), graph_queries.points(spark, sf_dir).select("entity", "label")
    return rounded(stats.permutation_null(edges, rows, 100))


def configuration_null(spark, sf_dir):
    edges, rows = graph_queries.graph(spark, sf_dir), graph_queries.points(spark, sf_dir).select("entity", "label")
    return rounded(stats.configuration_null(edges, rows, 50))


def _monthly(spark, sf_dir):
    """row, method, value: the median of each category in each quarter."""
    medians = tables.sales_panel(spark, sf_dir).groupBy("period", "category").agg(F.median("value").alias("value"))
    return medians.select(F.dense_rank().over(Window.orderBy("period")).cast("long").alias("_r"), "category", "value").select((F.col("_r") - 1).alias("row"), F.col("category").alias("method"), "value")  # periods x categories


def paired_bootstrap(spark, sf_dir):
    return rounded(stats.paired_bootstrap(_monthly(spark, sf_dir), 2000, 3), 5)


def win_rate(spark, sf_dir):
    return rounded(stats.win_rate(_monthly(spark, sf_dir), 2000, 3))


def _profiled(spark, sf_dir):
    return zscores(spark, sf_dir).join(types(spark, sf_dir), ["entity", "period"])


def mirkin_profile(spark, sf_dir):
    return rounded(interpret.mirkin_profile(_profiled(spark, sf_dir), CLR), 4)


def spread_totals(spark, sf_dir):
    return rounded(interpret.spread_totals(_profiled(spark, sf_dir), CLR), 4)


def top_features(spark, sf_dir):
    return rounded(interpret.top_features(interpret.mirkin_profile(_profiled(spark, sf_dir), CLR), 3), 4)


def readable_profile(spark, sf_dir):
    rows = raw(spark, sf_dir).join(types(spark, sf_dir), ["entity", "period"])
    return rounded(interpret.readable_profile(rows, [f"share_{c}" for c in _PARTS], ["total"]), 4)


def medians_by_type(spark, sf_dir):
    rows = types(spark, sf_dir).join(tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), "s_acctbal", F.col("s_nationkey").cast("double").alias("nation")), "entity")
    return rounded(interpret.medians_by_type(rows, ["s_acctbal", "nation"]))


def numeric_validation(spark, sf_dir):
    rows = types(spark, sf_dir).join(tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), "s_acctbal", F.col("s_nationkey").cast("double").alias("nation")), "entity")
    return rounded(interpret.numeric_validation(rows, ["s_acctbal", "nation"]).drop("p"))


def categorical_validation(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("label"), "c_nationkey", (F.col("c_acctbal") > 5000).alias("rich"))
    return rounded(interpret.categorical_validation(rows, ["c_nationkey", "rich"], min_size=60).drop("p"))


def rule_names(spark, sf_dir):
    return interpret.rule_names(relation(spark, sf_dir, MEANS), RULES, THRESHOLDS).select("label", "name", "rule")


def rule_violations(spark, sf_dir):
    return interpret.rule_violations(relation(spark, sf_dir, MEANS), {k: RULES[r] for k, r in NAMED.items()}, THRESHOLDS)


def profile_wide(spark, sf_dir):
    """Means of suppliers' numbers, a row for each type."""
    rows = types(spark, sf_dir).join(tables.table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("entity"))
    means = rows.groupBy("label").agg(F.avg("s_acctbal").alias("balance"), F.avg("s_nationkey").alias("nation"))
    return rounded(interpret.profile_wide(means.unpivot(["label"], ["balance", "nation"], "feature", "mean"), ["balance", "nation"]))


def name_search(spark, sf_dir):
    return interpret.name_search(tables.table(spark, sf_dir, "nation"), "NATION_1", "n_name").select("n_name", "place")


def type_summaries(spark, sf_dir):
    """The documents of the types as rows: features in order of contribution, typical and border members (supplier and quarter as one number)."""
    rows = _profiled(spark, sf_dir)
    points = vectors.complete(rows.select((F.col("entity") * 100000 + F.col("period")).alias("entity"), "label", F.array(*CLR).alias("x")))
    margins = vectors.membership_margin(points, vectors.centres(points))
    profile = interpret.mirkin_profile(rows, CLR)
    names = profile.select("label").distinct().withColumn("name", F.concat(F.lit("type "), F.col("label").cast("string")))
    found = interpret.summary_documents(profile, names, vectors.typical_and_border(margins))
    feature = F.transform("features", lambda x, i: F.struct(F.lit("feature").alias("part"), (i + 1).alias("place"), x["feature"].alias("item"), x["mean"].alias("value")))
    member = lambda kind: F.transform(kind, lambda x: F.struct(F.lit(kind).alias("part"), x["place"].cast("int").alias("place"), x["entity"].cast("string").alias("item"), F.lit(None).cast("double").alias("value")))
    return rounded(found.select("label", "n", "name", F.explode(F.concat(feature, member("typical"), member("border"))).alias("row")).select("label", "n", "name", "row.*"), 4)


def surrogate_leaves(spark, sf_dir):
    found = interpret.surrogate_tree(_profiled(spark, sf_dir), CLR, folds=3)
    return spark.createDataFrame([(leaf, n, round(hit, 6), round(found["accuracy"], 6), round(found["cv_accuracy"], 6)) for leaf, n, hit in found["leaves"]], "label int, n long, purity double, accuracy double, cv_accuracy double")


_KW = """c AS (SELECT g, v, count(*) AS c FROM x GROUP BY 1, 2), r AS (SELECT g, v, c, coalesce(sum(c) OVER (PARTITION BY g ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2.0 AS rank FROM c),
t AS (SELECT g, sum(CAST(c AS DOUBLE) * c * c - c) AS t FROM c GROUP BY 1), s AS (SELECT x.g AS g, l, CAST(sum(rank) AS DOUBLE) AS r, CAST(count(*) AS DOUBLE) AS n FROM x JOIN r ON r.g = x.g AND r.v = x.v GROUP BY 1, 2),
w AS (SELECT s.g AS g, CAST(sum(n) AS BIGINT) AS ni, sum(n) AS n, count(*) AS k, sum(r * r / n) AS q, max(t) AS t FROM s JOIN t ON t.g = s.g GROUP BY 1),
h AS (SELECT g, ni, n, k, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h FROM w)"""
_KW_OUT = 'ni AS n, k, round(h, 6) + 0.0 AS "H", round(greatest(0.0, least(1.0, (h - k + 1) / (n - k))), 6) + 0.0 AS eta2'
_MIRKIN = Z_SQL + f""", {LABELS_SQL}, p AS (SELECT z.*, label FROM z JOIN labels l ON l.entity = z.entity AND l.period = z.period WHERE z.entity IN (SELECT entity FROM full_history)),
f AS (""" + " UNION ALL ".join(f"""SELECT label, '{c}' AS feature, "{c}" AS v FROM p""" for c in CLR) + """),
a AS (SELECT feature, avg(v) AS gm, stddev_pop(v) AS sd, var_pop(v) AS vr, count(*) AS an FROM f GROUP BY 1), o AS (SELECT label, feature, count(*) AS n, avg(v) AS m, var_pop(v) AS ov FROM f GROUP BY 1, 2),
j AS (SELECT label, o.feature AS feature, n, n / CAST(an AS DOUBLE) AS share, m, gm, CASE WHEN abs(gm) < 1e-6 * CASE WHEN sd > 0 THEN sd ELSE 1.0 END THEN (m - gm) / CASE WHEN sd > 0 THEN sd ELSE 1.0 END ELSE (m - gm) / abs(gm) END AS rel, n * (m - gm) * (m - gm) AS contrib FROM o JOIN a ON a.feature = o.feature),
tb AS (SELECT (SELECT sum(vr * an) FROM a) AS t, (SELECT sum(contrib) FROM j) AS b)"""
_DRAWS = PANEL_SQL + f""", md AS (SELECT period, category AS method, median(value) AS value FROM panel GROUP BY 1, 2), mo AS (SELECT dense_rank() OVER (ORDER BY period) - 1 AS r, method, value FROM md),
sz AS (SELECT max(r) + 1 AS n FROM mo), dr AS (SELECT rep, {_mix_sql('rep', 'r', '3')} % n AS r FROM (SELECT DISTINCT r FROM mo) CROSS JOIN (SELECT CAST(range AS BIGINT) AS rep FROM range(2000)) CROSS JOIN sz),
bm AS (SELECT rep, method, avg(value) AS m FROM dr JOIN mo ON mo.r = dr.r GROUP BY 1, 2)"""

QUERIES = {
    "oriented_metrics": (oriented_metrics, f"WITH s(method, metric, value) AS ({in_sql(SCORES)}), {DIRECTIONS_SQL} SELECT method, s.metric AS metric, round(value, 6) + 0.0 AS value, round(value * d, 6) + 0.0 AS oriented FROM s JOIN dir ON dir.metric = s.metric"),
    "borda": (borda, f"""WITH s(method, metric, value) AS ({in_sql(SCORES)}), {DIRECTIONS_SQL}, o AS (SELECT method, s.metric AS metric, value * d AS v FROM s JOIN dir ON dir.metric = s.metric),
        r AS (SELECT method, rank() OVER (PARTITION BY metric ORDER BY v DESC) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY metric) AS n FROM o) SELECT method, round(CAST(sum(n - r) AS DOUBLE), 6) + 0.0 AS score FROM r GROUP BY 1"""),
    "threshold_rank": (threshold_rank, f"""WITH s(method, metric, value) AS ({in_sql(SCORES)}), {DIRECTIONS_SQL}, o AS (SELECT method, s.metric AS metric, value * d AS v FROM s JOIN dir ON dir.metric = s.metric),
        r AS (SELECT method, greatest(1, CAST(ceil((row_number() OVER (PARTITION BY metric ORDER BY v, method) - 1) * 3 / CAST(count(*) OVER (PARTITION BY metric) - 1 AS DOUBLE)) AS BIGINT)) AS g FROM o),
        c AS (SELECT method, count(CASE WHEN g = 1 THEN 1 END) AS n1, count(CASE WHEN g = 2 THEN 1 END) AS n2, count(CASE WHEN g = 3 THEN 1 END) AS n3 FROM r GROUP BY 1) SELECT method, n1, n2, n3, CAST(row_number() OVER (ORDER BY n1, n2, method) AS INTEGER) AS rank FROM c"""),
    "best_by_metric": (best_by_metric, f"""WITH s(method, metric, value) AS ({in_sql(SCORES)}), {DIRECTIONS_SQL}, r AS (SELECT s.metric AS metric, method, value, row_number() OVER (PARTITION BY s.metric ORDER BY value * d DESC, method) AS k FROM s JOIN dir ON dir.metric = s.metric)
        SELECT metric, method, round(value, 6) + 0.0 AS value FROM r WHERE k = 1"""),
    "k_selection": (k_selection, f"""WITH z(method, k, metric, period, z) AS ({in_sql(Z_ROWS)}), a(method, k, ari) AS ({in_sql(ARI_ROWS)}), w AS (SELECT method, k, avg(CASE WHEN metric = 'AVU' THEN z END) AS avu, avg(CASE WHEN metric = 'SW' THEN z END) AS sw FROM z GROUP BY 1, 2),
        g AS (SELECT method, k, avg(ari) AS st FROM a GROUP BY 1, 2), j AS (SELECT w.*, st, coalesce(st, min(st) OVER (PARTITION BY w.method)) AS f FROM w LEFT JOIN g ON g.method = w.method AND g.k = w.k),
        m AS (SELECT method, min(avu) AS a0, max(avu) AS a1, min(sw) AS s0, max(sw) AS s1, min(f) AS f0, max(f) AS f1 FROM j GROUP BY 1),
        q AS (SELECT j.method AS method, k, avu, sw, st, CASE WHEN a1 > a0 THEN (avu - a0) / (a1 - a0) ELSE 0.5 END + CASE WHEN s1 > s0 THEN (sw - s0) / (s1 - s0) ELSE 0.5 END + CASE WHEN f1 IS NULL THEN 0.0 WHEN f1 > f0 THEN (f - f0) / (f1 - f0) ELSE 0.5 END AS score FROM j JOIN m ON m.method = j.method)
        SELECT method, k, round(avu, 6) + 0.0 AS "AVU", round(sw, 6) + 0.0 AS "SW", round(st, 6) + 0.0 AS stability, round(score, 6) + 0.0 AS score, row_number() OVER (PARTITION BY method ORDER BY score DESC, k) = 1 AS best FROM q"""),
    "kruskal_eta": (kruskal_eta, f"WITH x AS (SELECT 1 AS g, o_orderpriority AS l, o_totalprice AS v FROM orders), {_KW} SELECT {_KW_OUT} FROM h"),
    "kruskal_ties": (kruskal_ties, f"WITH x AS (SELECT l_linestatus AS g, l_returnflag AS l, l_quantity AS v FROM lineitem), {_KW} SELECT g AS l_linestatus, {_KW_OUT} FROM h"),
    "cramers_v": (cramers_v, """WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, CAST(count(*) AS DOUBLE) AS o FROM orders GROUP BY 1, 2), ra AS (SELECT a, sum(o) AS n FROM c GROUP BY 1), rb AS (SELECT b, sum(o) AS n FROM c GROUP BY 1), t AS (SELECT sum(o) AS n FROM c),
        g AS (SELECT coalesce(o, 0.0) AS o, ra.n * rb.n / t.n AS e FROM ra CROSS JOIN rb CROSS JOIN t LEFT JOIN c ON c.a = ra.a AND c.b = rb.b), s AS (SELECT sum((o - e) * (o - e) / e) AS chi2 FROM g)
        SELECT CAST(n AS BIGINT) AS n, round(chi2, 6) + 0.0 AS chi2, round(sqrt(chi2 / n / (least((SELECT count(*) FROM ra), (SELECT count(*) FROM rb)) - 1)), 6) + 0.0 AS "V" FROM s, t"""),
    "average_ranks": (average_ranks, "SELECT p_partkey, p_size, p_brand, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS DOUBLE) AS rank FROM part"),
    "permuted_labels": (permuted_labels, f"""WITH {LABELS_SQL}, l AS (SELECT entity * 100000 + period AS entity, label FROM labels), s AS (SELECT label, count(*) AS n FROM l GROUP BY 1), u AS (SELECT label, sum(n) OVER (ORDER BY label) AS t, n FROM s),
        d AS (SELECT rep, entity, row_number() OVER (PARTITION BY rep ORDER BY {_mix_sql('entity', 'rep', '7')}, entity) AS k FROM l CROSS JOIN (SELECT CAST(range AS BIGINT) AS rep FROM range(20))) SELECT rep, entity, label FROM d JOIN u ON k <= t AND k > t - n"""),
    "permutation_null": (permutation_null, f"""WITH {graph_queries.NEAR_SQL}, n AS (SELECT label, count(*) AS n FROM points GROUP BY 1), upto AS (SELECT label, n, sum(n) OVER (ORDER BY label) AS t FROM n),
        dealt AS (SELECT rep, entity, row_number() OVER (PARTITION BY rep ORDER BY {_mix_sql('entity', 'rep', '0')}, entity) AS k FROM points CROSS JOIN (SELECT CAST(range AS BIGINT) AS rep FROM range(100))),
        lab AS (SELECT -1 AS rep, entity, label FROM points UNION ALL SELECT rep, entity, label FROM dealt JOIN upto ON k <= t AND k > t - n), e AS (SELECT i, j, w FROM graph UNION ALL SELECT j, i, w FROM graph),
        bl AS (SELECT x.rep AS rep, x.label AS a, y.label AS b, sum(w) AS s FROM e JOIN lab x ON x.entity = i JOIN lab y ON y.entity = j AND y.rep = x.rep GROUP BY 1, 2, 3),
        cl AS (SELECT z.rep AS rep, z.label AS label, coalesce(sum(s), 0.0) AS r, coalesce(sum(CASE WHEN a = b THEN s END), 0.0) AS q FROM (SELECT DISTINCT rep, label FROM lab) z LEFT JOIN bl ON bl.rep = z.rep AND a = z.label GROUP BY 1, 2),
        wh AS (SELECT rep, count(*) AS k, sum(r) AS m FROM cl GROUP BY 1), one AS (SELECT cl.rep AS rep, max(k) AS k, avg(CASE WHEN r > 0 THEN q / r ELSE 0.0 END) AS avi, sum(q / m - (r / m) * (r / m)) AS q FROM cl JOIN wh ON wh.rep = cl.rep GROUP BY 1),
        two AS (SELECT bl.rep AS rep, sum(CASE WHEN (x.r - x.q) + (y.r - y.q) - s > 0 THEN s / ((x.r - x.q) + (y.r - y.q) - s) ELSE 0.0 END) AS u FROM bl JOIN cl x ON x.rep = bl.rep AND x.label = a JOIN cl y ON y.rep = bl.rep AND y.label = b WHERE a <> b GROUP BY 1),
        v AS (SELECT one.rep AS rep, avi, coalesce(u, 0.0) / k AS avu, q FROM one LEFT JOIN two ON two.rep = one.rep),
        x AS (SELECT rep, 'AVI' AS metric, 1 AS d, avi AS v FROM v UNION ALL SELECT rep, 'AVU', -1, avu FROM v UNION ALL SELECT rep, 'ANUI', 1, CASE WHEN avi > 0 THEN 1 / (avu + 1 / avi) ELSE 0.0 END FROM v UNION ALL SELECT rep, 'Q', 1, q FROM v),
        o AS (SELECT metric, v AS observed FROM x WHERE rep = -1)
        SELECT x.metric AS metric, round(any_value(observed), 6) + 0.0 AS observed, round(avg(v), 6) + 0.0 AS mean, round(stddev_samp(v), 6) + 0.0 AS sd, round(any_value(d) * (any_value(observed) - avg(v)) / stddev_samp(v), 6) + 0.0 AS z,
               round(CAST(count(CASE WHEN v * d >= observed * d THEN 1 END) + 1 AS DOUBLE) / CAST(101 AS DOUBLE), 6) + 0.0 AS p FROM x JOIN o ON o.metric = x.metric WHERE rep >= 0 GROUP BY 1"""),
    "configuration_null": (configuration_null, None),
    "paired_bootstrap": (paired_bootstrap, f"""WITH {_DRAWS}, d AS (SELECT a.method AS a, b.method AS b, a.m - b.m AS d FROM bm a JOIN bm b ON a.rep = b.rep AND a.method < b.method), pm AS (SELECT method, avg(value) AS m FROM mo GROUP BY 1),
        q AS (SELECT a, b, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi, avg(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS p FROM d GROUP BY 1, 2)
        SELECT a, b, round(x.m - y.m, 5) + 0.0 AS diff, round(lo, 5) + 0.0 AS ci_low, round(hi, 5) + 0.0 AS ci_high, round(p, 5) + 0.0 AS p_better, lo > 0 OR hi < 0 AS significant FROM q JOIN pm x ON x.method = a JOIN pm y ON y.method = b"""),
    "win_rate": (win_rate, f"""WITH {_DRAWS}, r AS (SELECT method, row_number() OVER (PARTITION BY rep ORDER BY m DESC, method) AS k FROM bm), w AS (SELECT method, count(*) AS n FROM r WHERE k = 1 GROUP BY 1)
        SELECT p.method AS method, round(coalesce(n, 0) / 2000.0, 6) + 0.0 AS win_rate FROM (SELECT DISTINCT method FROM mo) p LEFT JOIN w ON w.method = p.method""".replace("coalesce(n, 0) / 2000.0", "CAST(coalesce(n, 0) AS DOUBLE) / CAST(2000 AS DOUBLE)")),
    "mirkin_profile": (mirkin_profile, f"""WITH {_MIRKIN} SELECT label, feature, n, round(share, 4) + 0.0 AS share, round(m, 4) + 0.0 AS mean, round(gm, 4) + 0.0 AS global_mean, round(rel, 4) + 0.0 AS rel_dev, round(contrib, 4) + 0.0 AS contrib, round(100 * contrib / t, 4) + 0.0 AS "contrib_pct_T", round(100 * contrib / b, 4) + 0.0 AS "contrib_pct_B" FROM j, tb"""),
    "spread_totals": (spread_totals, f"""WITH {_MIRKIN}, w AS (SELECT sum(ov * n) AS w FROM o) SELECT round(t, 4) + 0.0 AS "T", round(w, 4) + 0.0 AS "W", round(t - w, 4) + 0.0 AS "B", round((t - w) / t, 4) + 0.0 AS "B_over_T" FROM tb, w"""),
    "top_features": (top_features, f"""WITH {_MIRKIN}, r AS (SELECT label, feature, rel, 100 * contrib / b AS pct, row_number() OVER (PARTITION BY label ORDER BY contrib DESC, feature) AS place FROM j, tb) SELECT label, CAST(place AS INTEGER) AS place, feature, CASE WHEN rel >= 0 THEN '+' ELSE '-' END AS sign, round(pct, 4) + 0.0 AS "contrib_pct_B" FROM r WHERE place <= 3"""),
    "readable_profile": (readable_profile, f"""WITH {RAW_SQL}, {LABELS_SQL}, p AS (SELECT raw.*, label FROM raw JOIN labels l ON l.entity = raw.entity AND l.period = raw.period)
        SELECT label, count(*) AS n, {', '.join(f'round(median("share_{c}" * 100), 4) + 0.0 AS "share_{c}_pct"' for c in _PARTS)}, round(median(total), 4) + 0.0 AS total, round(100 * median(total) / (SELECT median(total) FROM p), 4) + 0.0 AS total_rel_pct FROM p GROUP BY ROLLUP (label)"""),
    "medians_by_type": (medians_by_type, f"""WITH {LABELS_SQL}, p AS (SELECT label, s_acctbal, CAST(s_nationkey AS DOUBLE) AS nation FROM labels JOIN supplier ON s_suppkey = entity)
        SELECT label, 's_acctbal' AS feature, round(median(s_acctbal), 6) + 0.0 AS median, count(*) AS n FROM p GROUP BY 1 UNION ALL SELECT label, 'nation', round(median(nation), 6) + 0.0, count(*) FROM p GROUP BY 1"""),
    "numeric_validation": (numeric_validation, f"""WITH {LABELS_SQL}, x AS (SELECT 's_acctbal' AS g, label AS l, s_acctbal AS v FROM labels JOIN supplier ON s_suppkey = entity UNION ALL SELECT 'nation', label, CAST(s_nationkey AS DOUBLE) FROM labels JOIN supplier ON s_suppkey = entity), {_KW} SELECT g AS feature, {_KW_OUT} FROM h"""),
    "categorical_validation": (categorical_validation, """WITH p AS (SELECT c_mktsegment AS l, CASE WHEN count(*) OVER (PARTITION BY c_nationkey) < 60 THEN 'other' ELSE CAST(c_nationkey AS VARCHAR) END AS n, CAST(c_acctbal > 5000 AS VARCHAR) AS r FROM customer),
        x AS (SELECT 'c_nationkey' AS f, n AS a, l AS b FROM p UNION ALL SELECT 'rich', r, l FROM p), c AS (SELECT f, a, b, CAST(count(*) AS DOUBLE) AS o FROM x GROUP BY 1, 2, 3), ra AS (SELECT f, a, sum(o) AS n FROM c GROUP BY 1, 2), rb AS (SELECT f, b, sum(o) AS n FROM c GROUP BY 1, 2), t AS (SELECT f, sum(o) AS n FROM c GROUP BY 1),
        g AS (SELECT ra.f AS f, coalesce(o, 0.0) AS o, ra.n * rb.n / t.n AS e FROM ra JOIN rb ON rb.f = ra.f JOIN t ON t.f = ra.f LEFT JOIN c ON c.f = ra.f AND c.a = ra.a AND c.b = rb.b), s AS (SELECT f, sum((o - e) * (o - e) / e) AS chi2 FROM g GROUP BY 1), k AS (SELECT f, least(count(DISTINCT a), count(DISTINCT b)) - 1 AS k FROM c GROUP BY 1)
        SELECT s.f AS feature, CAST(n AS BIGINT) AS n, round(chi2, 6) + 0.0 AS chi2, round(sqrt(chi2 / n / k), 6) + 0.0 AS "V" FROM s JOIN t ON t.f = s.f JOIN k ON k.f = s.f"""),
    "rule_names": (rule_names, f"""WITH m(label, level, food) AS ({in_sql(MEANS)}), r AS (SELECT label, CASE WHEN level >= 0.5 THEN 'rich' WHEN level <= 0.4 AND food >= 0.2 THEN 'poor' END AS r FROM m), n AS (SELECT label, r, row_number() OVER (PARTITION BY r ORDER BY label) AS k FROM r)
        SELECT label, CASE WHEN r IS NULL THEN 'Type ' || label ELSE r || list_extract(['', ' II', ' III', ' IV', ' V', ' VI', ' VII', ' VIII'], least(k, 8)) END AS name, r AS rule FROM n"""),
    "rule_violations": (rule_violations, f"""WITH m(label, level, food) AS ({in_sql(MEANS)}), b(label, feature, side, bound) AS (VALUES {BOUNDS_SQL}),
        v AS (SELECT b.label AS label, feature, side, bound, CASE feature WHEN 'level' THEN level ELSE food END AS value FROM b JOIN m ON m.label = b.label) SELECT * FROM v WHERE (side = 'min' AND value < bound) OR (side = 'max' AND value > bound)"""),
    "name_search": (name_search, """SELECT n_name, CAST(CASE WHEN lower(n_name) LIKE 'nation_1%' THEN 0 WHEN ' ' || lower(n_name) LIKE '% nation_1%' THEN 1 ELSE 2 END AS INTEGER) AS place FROM nation WHERE lower(n_name) LIKE '%nation_1%'"""),
    "profile_wide": (profile_wide, f"WITH {LABELS_SQL} SELECT label, round(avg(s_acctbal), 6) + 0.0 AS balance, round(avg(s_nationkey), 6) + 0.0 AS nation FROM labels JOIN supplier ON s_suppkey = entity GROUP BY 1"),
    "type_summaries": (type_summaries, f"""WITH {_MIRKIN}, pt AS (SELECT entity * 100000 + period AS entity, label, [{", ".join(f'"{c}"' for c in CLR)}] AS x FROM p WHERE {" AND ".join(f'"{c}" IS NOT NULL' for c in CLR)}),
        ds AS (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM pt), ce AS (SELECT label, list(v ORDER BY d) AS c FROM (SELECT label, d, avg(v) AS v FROM ds GROUP BY 1, 2) GROUP BY 1),
        md AS (SELECT pt.entity AS entity, pt.label AS label, min(CASE WHEN ce.label = pt.label THEN list_distance(x, c) END) AS o, min(CASE WHEN ce.label <> pt.label THEN list_distance(x, c) END) AS r FROM pt CROSS JOIN ce GROUP BY 1, 2),
        rk AS (SELECT label, entity, row_number() OVER (PARTITION BY label ORDER BY o, entity) AS t, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN o + r > 0 THEN (r - o) / (r + o) ELSE 1.0 END, entity) AS b FROM md),
        rw AS (SELECT label, 'feature' AS part, row_number() OVER (PARTITION BY label ORDER BY contrib DESC, feature DESC) AS place, feature AS item, m AS value FROM j
               UNION ALL SELECT label, 'typical', t, CAST(entity AS VARCHAR), NULL FROM rk WHERE t <= 3 UNION ALL SELECT label, 'border', b, CAST(entity AS VARCHAR), NULL FROM rk WHERE b <= 3)
        SELECT w.label AS label, n, 'type ' || w.label AS name, part, CAST(place AS INTEGER) AS place, item, round(value, 4) + 0.0 AS value FROM rw w JOIN (SELECT label, any_value(n) AS n FROM j GROUP BY 1) s ON s.label = w.label"""),
    "surrogate_leaves": (surrogate_leaves, None),
}
