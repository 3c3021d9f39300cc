"""Queries on versions, distances, keys and external statistics, all from the star-schema tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from netpanel.operators import entities, external, panel
from netpanel.plans.panel_queries import rounded
from netpanel.sources import tables

# Inputs of the operators, taken from whole tables; both engines read the same text, in which tables stand in braces.
VERSIONS = "SELECT o_custkey AS entity, CAST(year(o_orderdate) AS BIGINT) AS year_from, CAST(year(o_orderdate) + 1 + count(*) % 3 AS BIGINT) AS year_to, min(o_orderpriority) AS name FROM {orders} GROUP BY o_custkey, year(o_orderdate)"
PAIRS = "SELECT l_suppkey AS x, l_orderkey % 97 AS y, l_quantity - 1 AS distance, CASE WHEN l_linestatus = 'O' THEN 'highway' ELSE 'railway' END AS type FROM {lineitem}"
PLACES = "SELECT s_suppkey AS entity, CASE WHEN s_acctbal > 0 THEN 40 + s_acctbal / 1000 END AS lat, CASE WHEN s_acctbal > 0 THEN CAST(30 + s_nationkey AS DOUBLE) END AS lon FROM {supplier}"
POINTS = "SELECT c_custkey AS entity, CAST(50 + c_nationkey AS DOUBLE) AS lat, CAST(c_nationkey AS DOUBLE) AS lon FROM {customer} WHERE c_acctbal > 5000"
CODES = "SELECT c_name AS raw FROM {customer} UNION SELECT s_name FROM {supplier} UNION SELECT p_brand FROM {part} UNION SELECT p_type FROM {part} UNION SELECT o_orderpriority FROM {orders}"
SECTIONS = "SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'Раздел ' WHEN 1 THEN 'РАЗДЕЛ  ' WHEN 2 THEN 'Всего ' ELSE '' END || substr('АВЕКМНОРСТХABCabc', CAST(p_partkey % 17 + 1 AS INT), 1) || ' ' || p_name AS label FROM {part}"
SECTOR_ROWS = "SELECT CAST(l_suppkey AS STRING) AS oktmo8, substr('ABCDEZ', CAST(l_linenumber % 6 + 1 AS INT), 1) AS section, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS employees, CASE WHEN l_discount < 0.09 THEN l_extendedprice END AS wage FROM {lineitem}"
SECTOR_OF = {"A": "farm", "B": "energy", "C": "energy", "D": "estate", "E": "estate"}
KEYED_A = "SELECT CAST(c_custkey * 2 + 1 AS STRING) AS code, CAST(c_custkey - c_custkey % 4 AS STRING) AS stable, c_custkey AS v FROM {customer}"
KEYED_B = "SELECT CAST(s_suppkey AS STRING) AS code FROM {supplier}"
_UNION = "'u' || CAST(s_suppkey - s_suppkey % 10 AS STRING)"
MATCH_DICT = f"SELECT s_suppkey AS entity, 'c' || CAST(s_suppkey AS STRING) AS code, CASE WHEN s_nationkey % 5 = 4 THEN {_UNION} END AS change_from, CASE WHEN s_nationkey % 5 = 1 THEN {_UNION} END AS change_to FROM {{supplier}}"
MATCH_ROWS = "SELECT CASE WHEN c_nationkey < 8 THEN 'c' ELSE 'x' END || CAST(c_custkey AS STRING) AS code, 'c' || CAST(c_custkey - c_custkey % 3 AS STRING) AS stable, CAST(c_nationkey + 1 AS DOUBLE) AS weight, CASE WHEN c_acctbal > -500 THEN CAST(c_nationkey AS DOUBLE) END AS population, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal + 1000 END AS mean_wage FROM {customer}"
DERIVED = "SELECT l_suppkey AS code, sum(l_quantity) AS total, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS farm, sum(CASE WHEN l_returnflag = 'A' AND l_discount > 0.095 AND l_quantity > 45 THEN l_quantity END) AS energy, max(l_extendedprice) AS wage FROM {lineitem} GROUP BY l_suppkey"


def relation(spark, sf_dir, sql: str):
    """The rows of such a text."""
    names = set(re.findall(r"{(\w+)}", sql))
    return spark.sql(sql, **{n: tables.table(spark, sf_dir, n) for n in names})


def in_sql(sql: str) -> str:
    """The text for an engine that has the tables as views."""
    return re.sub(r"{(\w+)}", r"\1", sql)


def asof_version(spark, sf_dir):
    rows = relation(spark, sf_dir, VERSIONS)
    return entities.as_of(rows, 1998).select("entity", "name", "is_current")


def distances(spark, sf_dir):
    located = entities.centres(relation(spark, sf_dir, PLACES), relation(spark, sf_dir, POINTS))
    return rounded(entities.distances(located, relation(spark, sf_dir, PAIRS)), 4)


def code_normalise(spark, sf_dir):
    from netpanel.functions.scalars import code8

    return relation(spark, sf_dir, CODES).select("raw", code8("raw").alias("code"))


def section_code(spark, sf_dir):
    from netpanel.functions.scalars import section_code as code

    return relation(spark, sf_dir, SECTIONS).select("label", code("label").alias("section"))


def sector_aggregate(spark, sf_dir):
    return rounded(external.sector_aggregate(relation(spark, sf_dir, SECTOR_ROWS), SECTOR_OF), 4)


def rekeyed(spark, sf_dir):
    return entities.rekeyed(relation(spark, sf_dir, KEYED_A), relation(spark, sf_dir, KEYED_B), "code", "stable")


def keyed_fallback_match(spark, sf_dir):
    d = relation(spark, sf_dir, MATCH_DICT)
    return rounded(entities.fallback_match(d, relation(spark, sf_dir, MATCH_ROWS), ["population", "mean_wage"]))


def derived_shares(spark, sf_dir):
    return rounded(external.derive(relation(spark, sf_dir, DERIVED), ["farm", "energy"]))


def weighted_wage(spark, sf_dir):
    """Discounts weighted by quantity, by nation of the supplier."""
    items, suppliers = tables.table(spark, sf_dir, "lineitem"), tables.table(spark, sf_dir, "supplier")
    rows = items.select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d")).join(suppliers.select("s_suppkey", "s_nationkey"), "s_suppkey")
    merged = external.merge_sources(rows.withColumn("fine", F.col("d") <= 0.1).withColumn("low", F.col("q")), "s_nationkey", ["q"], [("d", "q")], ["fine"], [], ["low"])
    return rounded(merged.select("s_nationkey", F.col("q").alias("quantity"), F.col("d").alias("discount"), "fine", "low"), 4)


def merged_names(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "nation").join(F.broadcast(tables.table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return external.merge_sources(rows, "r_name", ["n_nationkey"], [], [], ["n_name"]).select("r_name", F.col("n_nationkey").alias("key_sum"), F.col("n_name").alias("names"))


def column_coverage(spark, sf_dir):
    suppliers, items = tables.table(spark, sf_dir, "supplier"), tables.table(spark, sf_dir, "orders")
    rows = tables.table(spark, sf_dir, "customer").join(items.filter("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("largest")), "c_custkey", "left")
    del suppliers
    return external.coverage(rows, ["c_acctbal", "largest"], ["c_mktsegment"])


def rare_categories(spark, sf_dir):
    rows = external.collapse_rare(tables.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("nation")), "nation", 4, "other")
    return rows.groupBy("nation").agg(F.count(F.lit(1)).alias("n"))


def metadata_join(spark, sf_dir):
    suppliers = tables.table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "entity")
    nations = tables.table(spark, sf_dir, "nation").join(F.broadcast(tables.table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    panel = tables.sales_panel(spark, sf_dir).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    rows = entities.with_attributes(panel, suppliers.join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"), "left"))
    return rows.select("entity", "n", "s_name", "n_name", "r_name")


def section_outer(spark, sf_dir):
    """Order counts and customer counts by nation and segment, from either side."""
    customers = tables.table(spark, sf_dir, "customer")
    a = customers.filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("oktmo8"), F.col("c_mktsegment").alias("section")).agg(F.count(F.lit(1)).alias("value"))
    b = customers.filter("c_acctbal < -900").groupBy(F.col("c_nationkey").alias("oktmo8"), F.col("c_mktsegment").alias("section")).agg(F.count(F.lit(1)).alias("value"))
    return external.sections(a, b).select("oktmo8", "section", F.col("employees").alias("rich"), F.col("wage").alias("poor"))


_HAV = "2 * 6371.0 * asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2)))))"

def assembled(spark, sf_dir):
    """Rich customers and suppliers of each nation, whichever there are; the nation's name from the first that has it."""
    nation = tables.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    side = lambda t, c, n, rich: tables.table(spark, sf_dir, t).filter(rich).groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias(n)).join(nation, "key")
    people, firms = side("customer", "c_nationkey", "customers", "c_acctbal > 9500"), side("supplier", "s_nationkey", "suppliers", "s_acctbal > 5000")
    return external.assembled(people, firms, ["n_name"], "key")


def year_events(spark, sf_dir):
    """Orders of the months of one year, by the beginning of the month's name."""
    rows = tables.table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_totalprice")
    return rounded(panel.of_period(rows, "1996").groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)


QUERIES = {
    "assembled": (assembled, """WITH p AS (SELECT c_nationkey AS key, count(*) AS customers FROM customer WHERE c_acctbal > 9500 GROUP BY 1), f AS (SELECT s_nationkey AS key, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
        SELECT coalesce(p.key, f.key) AS key, customers, suppliers, n_name FROM p FULL JOIN f ON p.key = f.key JOIN nation ON n_nationkey = coalesce(p.key, f.key)"""),
    "year_events": (year_events, """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1"""),
    "asof_version": (asof_version, f"""WITH v(entity, year_from, year_to, name) AS ({in_sql(VERSIONS)}),
        f AS (SELECT *, year_from <= 1998 AND 1998 < year_to AS is_current FROM v),
        r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY CASE WHEN is_current THEN 0 ELSE 1 END, year_to DESC, year_from DESC) AS n FROM f)
        SELECT entity, name, is_current FROM r WHERE n = 1"""),
    "distances": (distances, f"""WITH d(entity, lat0, lon0) AS ({in_sql(PLACES)}), p(entity, plat, plon) AS ({in_sql(POINTS)}), e(x, y, distance, type) AS ({in_sql(PAIRS)}),
        l AS (SELECT d.entity AS entity, coalesce(lat0, plat) AS lat, coalesce(lon0, plon) AS lon FROM d LEFT JOIN p ON d.entity = p.entity),
        c AS (SELECT least(x, y) AS i, greatest(x, y) AS j, type, min(distance) AS distance FROM e GROUP BY 1, 2, 3),
        q AS (SELECT a.entity AS i, b.entity AS j, h.distance AS hw, r.distance AS rw, {_HAV} * 1.3 AS gc
              FROM l a JOIN l b ON a.entity < b.entity
              LEFT JOIN c h ON h.i = a.entity AND h.j = b.entity AND h.type = 'highway' LEFT JOIN c r ON r.i = a.entity AND r.j = b.entity AND r.type = 'railway')
        SELECT i, j, round(CASE WHEN coalesce(hw, rw, gc) <= 0 THEN 5.0 ELSE coalesce(hw, rw, gc) END, 4) + 0.0 AS km,
               CASE WHEN hw IS NOT NULL THEN 'highway' WHEN rw IS NOT NULL THEN 'railway' ELSE 'circle' END AS source FROM q WHERE coalesce(hw, rw, gc) IS NOT NULL"""),
    "code_normalise": (code_normalise, f"""WITH c(raw) AS ({in_sql(CODES)}), d AS (SELECT raw, regexp_replace(raw, '[^0-9]', '', 'g') AS x FROM c)
        SELECT raw, CASE WHEN x <> '' THEN lpad(x, 8, '0') END AS code FROM d"""),
    "section_code": (section_code, f"""WITH s(label) AS ({in_sql(SECTIONS)}), x AS (SELECT label, upper(regexp_extract(lower(trim(label)), 'раздел\\s+(\\S)', 1)) AS l FROM s)
        SELECT label, CASE WHEN lower(trim(label)) LIKE 'всего%' THEN '_total' WHEN l <> '' THEN translate(l, 'АВЕКМНОРСТХ', 'ABEKMHOPCTX') END AS section FROM x"""),
    "sector_aggregate": (sector_aggregate, f"""WITH r(oktmo8, section, employees, wage) AS ({in_sql(SECTOR_ROWS)}),
        s AS (SELECT *, CASE section {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SECTOR_OF.items())} END AS sector, CASE WHEN employees IS NOT NULL AND wage IS NOT NULL THEN employees END AS b FROM r)
        SELECT oktmo8, sector, round(sum(employees), 4) + 0.0 AS employees, round(coalesce(sum(b * wage) / nullif(sum(b), 0), avg(wage)), 4) + 0.0 AS wage, count(employees) AS reported FROM s WHERE sector IS NOT NULL GROUP BY 1, 2"""),
    "rekeyed": (rekeyed, f"""WITH a(code, stable, v) AS ({in_sql(KEYED_A)}), b(code) AS ({in_sql(KEYED_B)}),
        m AS (SELECT *, code NOT IN (SELECT code FROM b) AND coalesce(stable IN (SELECT code FROM b), false) AND NOT coalesce(stable IN (SELECT code FROM a), false) AS moved FROM a),
        k AS (SELECT CASE WHEN moved THEN stable ELSE code END AS code, stable, v, row_number() OVER (PARTITION BY CASE WHEN moved THEN stable ELSE code END ORDER BY CASE WHEN moved THEN 1 ELSE 0 END, code) AS n FROM m)
        SELECT code, stable, v FROM k WHERE n = 1"""),
    "keyed_fallback_match": (keyed_fallback_match, f"""WITH d(entity, code, change_from, change_to) AS ({in_sql(MATCH_DICT)}), s(code, stable, weight, population, mean_wage) AS ({in_sql(MATCH_ROWS)}),
        f AS (SELECT entity, 1 AS via, population, mean_wage, weight FROM d JOIN s ON d.code = s.code
              UNION ALL SELECT entity, 2, population, mean_wage, weight FROM d JOIN s ON d.code = s.stable
              UNION ALL SELECT d.entity, 3, population, mean_wage, weight FROM d JOIN d o ON o.change_to = d.change_from JOIN s ON s.code = o.code),
        b AS (SELECT entity, min(via) AS via FROM f GROUP BY 1),
        g AS (SELECT f.entity AS entity, f.via AS via, count(*) AS n_sources, sum(population) AS population,
                     coalesce(sum(CASE WHEN mean_wage IS NOT NULL THEN weight END * mean_wage) / sum(CASE WHEN mean_wage IS NOT NULL THEN weight END), avg(mean_wage)) AS mean_wage
              FROM f JOIN b ON f.entity = b.entity AND f.via = b.via GROUP BY 1, 2)
        SELECT d.entity AS entity, CASE WHEN via = 1 THEN 'exact' WHEN via = 2 AND n_sources = 1 THEN 'stable' WHEN via = 2 THEN 'aggregated' WHEN via = 3 THEN 'union' ELSE 'missing' END AS quality,
               coalesce(n_sources, 0) AS n_sources, round(population, 6) + 0.0 AS population, round(mean_wage, 6) + 0.0 AS mean_wage FROM d LEFT JOIN g ON d.entity = g.entity"""),
    "derived_shares": (derived_shares, f"""WITH w(code, total, farm, energy, wage) AS ({in_sql(DERIVED)}),
        s AS (SELECT *, farm / CASE WHEN total > 0 THEN total END AS share_farm, energy / CASE WHEN total > 0 THEN total END AS share_energy, coalesce(farm, energy) IS NOT NULL AND total > 0 AS known FROM w),
        t AS (SELECT *, CASE WHEN known THEN greatest(0.0, 1 - (coalesce(share_farm, 0.0) + coalesce(share_energy, 0.0))) END AS share_rest FROM s), m AS (SELECT median(wage) AS med FROM w)
        SELECT code, round(total, 6) + 0.0 AS total, round(farm, 6) + 0.0 AS farm, round(energy, 6) + 0.0 AS energy, round(wage, 6) + 0.0 AS wage, round(share_farm, 6) + 0.0 AS share_farm, round(share_energy, 6) + 0.0 AS share_energy, round(share_rest, 6) + 0.0 AS share_rest,
               round(CASE WHEN known THEN coalesce(share_farm, 0.0) * coalesce(share_farm, 0.0) + coalesce(share_energy, 0.0) * coalesce(share_energy, 0.0) + coalesce(share_rest, 0.0) * coalesce(share_rest, 0.0) END, 6) + 0.0 AS hhi,
               CASE WHEN coalesce(farm, energy) IS NOT NULL THEN CASE WHEN coalesce(farm, -1) >= coalesce(energy, -1) THEN 'farm' ELSE 'energy' END END AS top_sector, round(wage / med, 6) + 0.0 AS wage_rel FROM t, m"""),
    "weighted_wage": (weighted_wage, """SELECT s_nationkey, round(sum(l_quantity), 4) + 0.0 AS quantity, round(sum(l_quantity * l_discount) / sum(l_quantity), 4) + 0.0 AS discount, bool_and(l_discount <= 0.1) AS fine, round(min(l_quantity), 4) + 0.0 AS low
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1"""),
    "merged_names": (merged_names, "SELECT r_name, CAST(sum(n_nationkey) AS BIGINT) AS key_sum, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "column_coverage": (column_coverage, """WITH l AS (SELECT o_custkey, max(o_totalprice) AS largest FROM orders WHERE o_totalprice > 300000 GROUP BY 1), j AS (SELECT c_mktsegment, c_acctbal, largest FROM customer LEFT JOIN l ON c_custkey = o_custkey)
        SELECT c_mktsegment, count(*) AS n, 'c_acctbal' AS "column", count(c_acctbal) AS n_known FROM j GROUP BY 1 UNION ALL SELECT c_mktsegment, count(*), 'largest', count(largest) FROM j GROUP BY 1"""),
    "rare_categories": (rare_categories, "WITH n AS (SELECT CAST(s_nationkey AS VARCHAR) AS nation, count(*) OVER (PARTITION BY s_nationkey) AS c FROM supplier) SELECT CASE WHEN c < 4 THEN 'other' ELSE nation END AS nation, count(*) AS n FROM n GROUP BY 1"),
    "metadata_join": (metadata_join, """WITH p AS (SELECT l_suppkey AS entity, year(l_shipdate) * 4 + quarter(l_shipdate) AS period, l_returnflag || l_linestatus AS c FROM lineitem GROUP BY 1, 2, 3), q AS (SELECT entity, count(*) AS n FROM p GROUP BY 1)
        SELECT entity, n, s_name, n_name, r_name FROM q LEFT JOIN supplier ON entity = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""),
    "section_outer": (section_outer, """WITH a AS (SELECT c_nationkey AS oktmo8, c_mktsegment AS section, count(*) AS rich FROM customer WHERE c_acctbal > 9000 GROUP BY 1, 2), b AS (SELECT c_nationkey AS oktmo8, c_mktsegment AS section, count(*) AS poor FROM customer WHERE c_acctbal < -900 GROUP BY 1, 2)
        SELECT coalesce(a.oktmo8, b.oktmo8) AS oktmo8, coalesce(a.section, b.section) AS section, rich, poor FROM a FULL JOIN b ON a.oktmo8 = b.oktmo8 AND a.section = b.section"""),
}
