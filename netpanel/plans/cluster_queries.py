"""Queries on clusterings and their behaviour over time: the kernels are tested by planted partitions, as SQL can't express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from netpanel.config import Config
from netpanel.operators import clustering, graphs, indices, panel, stats, vectors
from netpanel.operators import kernels as dense
from netpanel.plans.label_queries import LABELS_SQL, types
from netpanel.plans.panel_queries import CLR, TOTAL, WIDE_SQL, Z_SQL, rounded, wide, zscores
from netpanel.session import kept
from netpanel.sources import tables

CONFIG = Config()


def _points(spark, sf_dir):
    rows = zscores(spark, sf_dir)
    return kept(vectors.complete(rows.select("period", "entity", F.array(*CLR).alias("x"))))


def _edges(points):
    return kept(graphs.behaviour_layer(points, 6, 4, mutual=True, by=["period"]))


def cluster_grid(spark, sf_dir):
    points = _points(spark, sf_dir)
    found = clustering.grid(points, _edges(points), ["kmeans", "ward", "spectral", "leiden", "kefrin", "kefrin_balanced"], CONFIG.methods.k_grid)
    return found.drop("seconds")


def grid_metrics(spark, sf_dir):
    points = _points(spark, sf_dir)
    edges = _edges(points)
    found = kept(clustering.grid(points, edges, ["kmeans", "kefrin"], CONFIG.methods.k_grid).withColumnRenamed("k", "asked"))
    table = indices.indices_of_runs(edges, found, ["method", "asked"])  # the indices have a k of their own
    return rounded(table.select("period", "method", "asked", *[c for c in table.columns if c not in ("period", "method", "asked")]))


def comovement_layer(spark, sf_dir):
    growth = panel.growth_window(panel.log_growth(wide(spark, sf_dir), TOTAL), 12, 3)
    return rounded(clustering.comovement_layer(growth, 8, (0, 1)))


def comovement_shrinkage(spark, sf_dir):
    growth = panel.growth_window(panel.log_growth(wide(spark, sf_dir), TOTAL), 12, 3)
    return rounded(clustering.comovement_shrinkage(growth))


def fused_layer(spark, sf_dir):
    one = _edges(_points(spark, sf_dir)).select(F.lit("behaviour").alias("layer"), "period", "i", "j", "w")
    two = comovement_layer(spark, sf_dir).select(F.lit("comovement").alias("layer"), F.col("t").alias("period"), "i", "j", "w")
    return rounded(clustering.fused_layer(kept(one.unionByName(two)), 6, CONFIG.graphs.fusion_rounds))


def temporal_clusters(spark, sf_dir):
    points = _points(spark, sf_dir)
    return clustering.temporal(_edges(points), points.select("period", "entity"), 4)


def subsample_stability(spark, sf_dir):
    """Agreement of all pairs of subsamples of each quarter, and how well its clusters come back in them."""
    points = _points(spark, sf_dir)
    n_init = CONFIG.methods.n_init
    pairs, clusters = stats.stability(points, None, lambda x, a, k, rng: dense.kmeans(x, k, rng, n_init), 4, links=True)  # k-means reads no graph
    return rounded(stats.stability_summary(pairs, clusters))


def bootstrap_confidence(spark, sf_dir):
    """By quarter: how sure the types of suppliers are under resampling, for a clustering that uses features and graph."""
    points = _points(spark, sf_dir)
    edges = _edges(points)
    labels = kept(clustering.grid(points, edges, ["kefrin_balanced"], [4]).select("period", "entity", "label"))
    found = clustering.bootstrap_membership(points, edges, labels, "kefrin_balanced", CONFIG.dynamics.bootstrap, CONFIG.dynamics.bootstrap_share)
    return rounded(clustering.confidence_summary(clustering.confidence(found), CONFIG.dynamics.confidence))


def layer_ablation(spark, sf_dir):
    points = _points(spark, sf_dir)
    edges = _edges(points)
    thin = kept(graphs.behaviour_layer(points, 3, 3, mutual=False, by=["period"]))
    parts = [clustering.grid(points, e, ["leiden", "spectral"], [4]).select(F.lit(name).alias("layer"), "method", "period", "entity", "label") for name, e in (("wide", edges), ("thin", thin))]
    return rounded(clustering.layer_ablation(kept(parts[0].unionByName(parts[1]))))


def _embedded(spark, sf_dir):
    points = vectors.complete(zscores(spark, sf_dir).select("period", "entity", F.array(*CLR).alias("x")))
    return points, types(spark, sf_dir)


#: The first half of all quarters, and the rest.
TRAIN, TEST = (7981, 7994), (7995, 8008)


def out_of_time(spark, sf_dir):
    return rounded(clustering.out_of_time(*_embedded(spark, sf_dir), TRAIN, TEST))


def classified_online(spark, sf_dir):
    return clustering.classified_online(*_embedded(spark, sf_dir), TRAIN, TEST)


def metric_panel(spark, sf_dir):
    """Every index of every quarter's types, as long rows: silhouette, Calinski-Harabasz, Davies-Bouldin, S_Dbw."""
    points, labels = _embedded(spark, sf_dir)
    found = labels.select(F.lit("flag").alias("method"), F.lit(3).alias("k"), "period", "entity", "label")
    return rounded(indices.feature_panel(points, found))


def panel_null(spark, sf_dir):
    """All indices of the types of each quarter against labels dealt at random: z-scores by index."""
    points = _points(spark, sf_dir)
    edges = _edges(points)
    labels = types(spark, sf_dir).join(points.select("period", "entity"), ["period", "entity"], "left_semi")
    return rounded(stats.panel_null(points, edges, labels, CONFIG.compare.permutations))


def outside_panel(spark, sf_dir):
    """Suppliers in debt are the ones outside the panel."""
    points, labels = _embedded(spark, sf_dir)
    debt = tables.table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("entity"))
    return rounded(clustering.outside_panel(points.join(debt, "entity", "left_anti"), labels, points.join(debt, "entity", "left_semi")))


def kmeans_scaled(spark, sf_dir):
    """Spark's own k-means, for points that no task can hold: the clusters of least cost over seeds."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = tables.embedding_space(spark, sf_dir).withColumn("features", array_to_vector("x"))
    best = min((KMeans(k=6, seed=s, maxIter=20).fit(rows) for s in (1, 2, 3)), key=lambda m: m.summary.trainingCost)
    return best.transform(rows).select("entity", F.col("prediction").alias("cluster"))


def type_centres(spark, sf_dir):
    """The centres of the types over all periods, as long rows."""
    points, labels = _embedded(spark, sf_dir)
    centres = vectors.centres(points.join(labels, ["period", "entity"]))
    return rounded(centres.select("label", "n", F.posexplode("centre").alias("dim", "value")))



ROWS_SQL = Z_SQL + f""", {LABELS_SQL},
pts AS (SELECT z.period AS period, z.entity AS entity, [{", ".join(f'"{c}"' for c in CLR)}] AS x FROM z WHERE entity IN (SELECT entity FROM full_history) AND {" AND ".join(f'"{c}" IS NOT NULL' for c in CLR)}),
rows AS (SELECT p.period AS period, p.entity AS entity, label, x FROM pts p JOIN labels l ON l.period = p.period AND l.entity = p.entity),
dims AS (SELECT period, label, entity, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM rows)"""
CENTRES_SQL = ROWS_SQL + """,
means AS (SELECT period, label, d, avg(v) AS v, count(*) AS n FROM dims GROUP BY 1, 2, 3),
centres AS (SELECT period, label, any_value(n) AS n, list(v ORDER BY d) AS c FROM means GROUP BY 1, 2)"""
#: Every row of the test quarters with the centres of the train quarters, nearest first.
ONLINE_SQL = ROWS_SQL + f""",
tm AS (SELECT label, d, avg(v) AS v FROM dims WHERE period BETWEEN {TRAIN[0]} AND {TRAIN[1]} GROUP BY 1, 2), tc AS (SELECT label, list(v ORDER BY d) AS c FROM tm GROUP BY 1),
met AS (SELECT period, entity, r.label AS label, tc.label AS cl, list_distance(x, c) AS dist, row_number() OVER (PARTITION BY period, entity ORDER BY list_distance(x, c), tc.label) AS place FROM rows r CROSS JOIN tc WHERE period BETWEEN {TEST[0]} AND {TEST[1]}),
classed AS (SELECT period, entity, label, max(CASE WHEN place = 1 THEN cl END) AS nearest, max(CASE WHEN place = 1 THEN dist END) AS d1, max(CASE WHEN place = 2 THEN dist END) AS d2 FROM met GROUP BY 1, 2, 3)"""

#: Standardised growth of each window: by lag, columns (side, entity; side 1 is an earlier period) and rows, with the intensity of shrinkage.
GROWTH_SQL = f"""{WIDE_SQL}, steps AS (SELECT entity, period, CASE WHEN lag(period) OVER o = period - 1 AND total > 0 AND lag(total) OVER o > 0 THEN ln(total) - ln(lag(total) OVER o) END AS change FROM wide WINDOW o AS (PARTITION BY entity ORDER BY period)),
med AS (SELECT period, median(change) AS m FROM steps GROUP BY 1), g AS (SELECT entity, s.period AS period, change - m AS growth FROM steps s JOIN med USING (period) WHERE change IS NOT NULL),
ends AS (SELECT DISTINCT period AS t FROM g), win AS (SELECT t, entity, period, growth, dense_rank() OVER (PARTITION BY t ORDER BY period) AS r FROM g JOIN ends ON g.period > t - 12 AND g.period <= t),
size AS (SELECT t, max(r) AS n, count(DISTINCT entity) AS p FROM win GROUP BY 1 HAVING max(r) >= 3),
lags AS (SELECT t, 0 AS lag, n, p FROM size UNION ALL SELECT t, 1, n - 1, 2 * p FROM size WHERE n >= 4),
x AS (SELECT win.t AS t, lag, side, entity, r + side - lag AS r, growth FROM win JOIN lags ON lags.t = win.t CROSS JOIN (SELECT unnest([0, 1]) AS side) WHERE side <= lag AND r + side - lag BETWEEN 1 AND n),
st AS (SELECT t, lag, side, entity, avg(growth) AS m, stddev_pop(growth) AS s FROM x GROUP BY 1, 2, 3, 4),
z AS (SELECT x.t AS t, x.lag AS lag, x.side AS side, x.entity AS entity, r, (growth - m) / CASE WHEN s > 0 THEN s ELSE 1.0 END AS z FROM x JOIN st ON st.t = x.t AND st.lag = x.lag AND st.side = x.side AND st.entity = x.entity),
gram AS (SELECT a.t AS t, a.lag AS lag, a.r AS a, b.r AS b, sum(a.z * b.z) AS v FROM z a JOIN z b ON b.t = a.t AND b.lag = a.lag AND b.side = a.side AND b.entity = a.entity GROUP BY 1, 2, 3, 4),
mom AS (SELECT l.t AS t, l.lag AS lag, any_value(n) AS n, any_value(p) AS p, sum(CASE WHEN a = b THEN v END) / any_value(n) / any_value(p) AS mu, sum(v * v) / any_value(n * n) AS sq, sum(CASE WHEN a = b THEN v * v END) / any_value(n) AS own FROM lags l JOIN gram ON gram.t = l.t AND gram.lag = l.lag GROUP BY 1, 2),
shrunk AS (SELECT t, lag, n, mu, CASE WHEN (sq - p * mu * mu) / p > 1e-15 THEN least(greatest((own - sq) / (p * n), 0.0), (sq - p * mu * mu) / p) / ((sq - p * mu * mu) / p) ELSE 1.0 END AS delta FROM mom)"""
#: The correlation of each pair after shrinkage, the largest over lags and orders.
CORRELATION_SQL = GROWTH_SQL + """,
own AS (SELECT z.t AS t, z.lag AS lag, side, entity, sqrt((1 - any_value(delta)) * sum(z * z) / any_value(n) + any_value(delta * mu)) AS sd FROM z JOIN shrunk q ON q.t = z.t AND q.lag = z.lag GROUP BY 1, 2, 3, 4),
prod AS (SELECT a.t AS t, a.lag AS lag, a.entity AS a, b.entity AS b, sum(a.z * b.z) AS c FROM z a JOIN z b ON b.t = a.t AND b.lag = a.lag AND b.r = a.r AND b.side = a.lag AND a.side = 0 AND b.entity <> a.entity GROUP BY 1, 2, 3, 4),
corr AS (SELECT c.t AS t, least(a, b) AS i, greatest(a, b) AS j, max((1 - delta) * c / n / x.sd / y.sd) AS s FROM prod c JOIN shrunk q ON q.t = c.t AND q.lag = c.lag JOIN own x ON x.t = c.t AND x.lag = c.lag AND x.side = 0 AND x.entity = a
         JOIN own y ON y.t = c.t AND y.lag = c.lag AND y.side = c.lag AND y.entity = b GROUP BY 1, 2, 3),
ranked AS (SELECT t, i, j, s, row_number() OVER (PARTITION BY t, i ORDER BY s DESC, j) AS place FROM (SELECT * FROM corr UNION ALL SELECT t, j, i, s FROM corr) WHERE s >= 1e-12)"""

SQL = {
    "comovement_shrinkage": f"""WITH {GROWTH_SQL} SELECT t, CAST(lag AS INTEGER) AS lag, round(delta, 6) + 0.0 AS delta FROM shrunk""",
    "comovement_layer": f"""WITH {CORRELATION_SQL} SELECT t, least(i, j) AS i, greatest(i, j) AS j, round(least(max(s), 1.0), 6) + 0.0 AS w FROM ranked WHERE place <= 8 GROUP BY t, least(i, j), greatest(i, j) HAVING count(*) = 2""",
    "type_centres": f"""WITH {ROWS_SQL} SELECT label, count(*) AS n, CAST(d - 1 AS INTEGER) AS dim, round(avg(v), 6) + 0.0 AS value FROM dims GROUP BY 1, 3""",
    "classified_online": f"""WITH {ONLINE_SQL} SELECT period, entity, label FROM rows WHERE period BETWEEN {TRAIN[0]} AND {TRAIN[1]} UNION ALL SELECT period, entity, nearest FROM classed""",
    "out_of_time": f"""WITH {ONLINE_SQL}, c AS (SELECT period, label AS a, nearest AS b, CAST(count(*) AS DOUBLE) AS n FROM classed GROUP BY 1, 2, 3), s AS (SELECT period, sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM c GROUP BY 1),
        ra AS (SELECT period, sum(n * (n - 1) / 2) AS s FROM (SELECT period, a, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1), rb AS (SELECT period, sum(n * (n - 1) / 2) AS s FROM (SELECT period, b, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1),
        r AS (SELECT s.period AS period, s.s AS together, ra.s * rb.s / (t * (t - 1) / 2) AS e, (ra.s + rb.s) / 2 AS most FROM s JOIN ra ON ra.period = s.period JOIN rb ON rb.period = s.period),
        g AS (SELECT period, avg(CASE WHEN nearest = label THEN 1.0 ELSE 0.0 END) AS agreement, avg(CASE WHEN d2 IS NULL THEN 1.0 WHEN d1 > 0 THEN least(1.0, (d2 - d1) / d1) WHEN d2 > 0 THEN 1.0 ELSE 0.0 END) AS margin FROM classed GROUP BY 1)
        SELECT r.period AS period, round(CASE WHEN most = e THEN 1.0 ELSE (together - e) / (most - e) END, 6) + 0.0 AS ari, round(agreement, 6) + 0.0 AS agreement, round(margin, 6) + 0.0 AS margin FROM r JOIN g ON g.period = r.period""",
    "outside_panel": f"""WITH {ROWS_SQL}, om AS (SELECT period, label, d, avg(v) AS v FROM dims WHERE entity NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1, 2, 3), oc AS (SELECT period, label, list(v ORDER BY d) AS c FROM om GROUP BY 1, 2),
        met AS (SELECT p.period AS period, entity, label, list_distance(x, c) AS dist, row_number() OVER (PARTITION BY p.period, entity ORDER BY list_distance(x, c), label) AS place FROM pts p JOIN oc ON oc.period = p.period WHERE entity IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)),
        q AS (SELECT period, entity, max(CASE WHEN place = 1 THEN label END) AS nearest, max(CASE WHEN place = 1 THEN dist END) AS d1, max(CASE WHEN place = 2 THEN dist END) AS d2 FROM met GROUP BY 1, 2)
        SELECT period, entity, nearest, round(CASE WHEN d2 IS NULL THEN 1.0 WHEN d1 > 0 THEN least(1.0, (d2 - d1) / d1) WHEN d2 > 0 THEN 1.0 ELSE 0.0 END, 6) + 0.0 AS margin FROM q""",
    "metric_panel": f"""WITH {CENTRES_SQL}, own AS (SELECT r.period AS period, entity, r.label AS label, x, c, list_distance(x, c) AS e FROM rows r JOIN centres c ON c.period = r.period AND c.label = r.label),
        size AS (SELECT period, count(*) AS n, count(DISTINCT label) AS k FROM rows GROUP BY 1),
        gm AS (SELECT period, d, avg(v) AS v, var_pop(v) AS vv FROM dims GROUP BY 1, 2), w AS (SELECT period, sum(e * e) AS w FROM own GROUP BY 1),
        b AS (SELECT m.period AS period, sum(m.n * (m.v - g.v) * (m.v - g.v)) AS b FROM means m JOIN gm g ON g.period = m.period AND g.d = m.d GROUP BY 1),
        ch AS (SELECT w.period AS period, (b / (k - 1)) / (w / (n - k)) AS v, n FROM w JOIN b ON b.period = w.period JOIN size s ON s.period = w.period WHERE k > 1 AND n > k AND w > 0),
        sp AS (SELECT period, label, avg(e) AS s FROM own GROUP BY 1, 2), cs AS (SELECT c.period AS period, c.label AS label, c, s FROM centres c JOIN sp ON sp.period = c.period AND sp.label = c.label),
        db AS (SELECT period, avg(q) AS v FROM (SELECT a.period AS period, a.label AS l, max((a.s + b.s) / list_distance(a.c, b.c)) AS q FROM cs a JOIN cs b ON a.period = b.period AND a.label <> b.label GROUP BY 1, 2) GROUP BY 1),
        near AS (SELECT a.period AS period, a.entity AS entity, a.label AS label, b.label AS other, sum(list_distance(a.x, b.x)) / count(*) AS d FROM rows a JOIN rows b ON a.period = b.period AND a.entity <> b.entity GROUP BY 1, 2, 3, 4),
        sq AS (SELECT period, entity, max(CASE WHEN other = label THEN d END) AS a, min(CASE WHEN other <> label THEN d END) AS b FROM near GROUP BY 1, 2),
        sw AS (SELECT period, avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS v FROM sq GROUP BY 1),
        lv AS (SELECT period, label, sqrt(sum(vv * vv)) AS s FROM (SELECT period, label, d, var_pop(v) AS vv FROM dims GROUP BY 1, 2, 3) GROUP BY 1, 2), av AS (SELECT period, sqrt(sum(vv * vv)) AS s FROM gm GROUP BY 1),
        sc AS (SELECT lv.period AS period, count(*) AS k, avg(lv.s) / max(av.s) AS scatter, sqrt(sum(lv.s)) / count(*) AS radius FROM lv JOIN av ON av.period = lv.period GROUP BY 1),
        mids AS (SELECT a.period AS period, a.label AS a, b.label AS b, list((a.v + b.v) / 2 ORDER BY a.d) AS m FROM means a JOIN means b ON a.period = b.period AND a.d = b.d AND a.label < b.label GROUP BY 1, 2, 3),
        t AS (SELECT mids.period AS period, a, b, sum(CASE WHEN list_distance(x, m) <= radius THEN 1 ELSE 0 END) AS dm, sum(CASE WHEN list_distance(x, ca.c) <= radius THEN 1 ELSE 0 END) AS da, sum(CASE WHEN list_distance(x, cb.c) <= radius THEN 1 ELSE 0 END) AS db
              FROM mids JOIN rows p ON p.period = mids.period AND (p.label = a OR p.label = b) JOIN centres ca ON ca.period = mids.period AND ca.label = a JOIN centres cb ON cb.period = mids.period AND cb.label = b JOIN sc ON sc.period = mids.period GROUP BY 1, 2, 3),
        f AS (SELECT period, sum(CASE WHEN greatest(da, db) > 0 THEN dm / CAST(greatest(da, db) AS DOUBLE) ELSE 0.0 END) AS f FROM t GROUP BY 1),
        m AS (SELECT period, 'CH' AS metric, v AS value FROM ch UNION ALL SELECT period, 'CH_n', v / n FROM ch UNION ALL SELECT period, 'DBI', v FROM db UNION ALL SELECT period, 'SW', v FROM sw
              UNION ALL SELECT sc.period, 'S_Dbw', scatter + CASE WHEN k > 1 THEN f * 2 / (k * (k - 1)) ELSE 0.0 END FROM sc JOIN f ON f.period = sc.period)
        SELECT 'flag' AS method, 3 AS k, s.period AS period, q.metric AS metric, CASE WHEN k > 1 AND k < n THEN round(value, 6) + 0.0 END AS value FROM size s CROSS JOIN (VALUES ('SW'), ('CH'), ('CH_n'), ('DBI'), ('S_Dbw')) q(metric) LEFT JOIN m ON m.period = s.period AND m.metric = q.metric""",
}

QUERIES = {f.__name__: (f, SQL.get(f.__name__)) for f in (cluster_grid, grid_metrics, metric_panel, panel_null, comovement_layer, comovement_shrinkage, fused_layer, temporal_clusters, subsample_stability, bootstrap_confidence, layer_ablation, out_of_time, classified_online, outside_panel, kmeans_scaled, type_centres)}
