"""Panel algebra on small tables with known results."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from netpanel.operators import entities, external, panel

TOTAL, REST = "total", "rest"


@pytest.fixture(scope="module")
def long(spark):
    base = {1: (50.0, 20.0, 100.0), 2: (60.0, 10.0, 200.0), 3: (30.0, 30.0, 50.0)}
    rows = [(e, t, c, v * m) for e, vs in base.items() for t, m in enumerate((1.0, 1.1, 1.3)) for c, v in zip(("A", "B", TOTAL), vs, strict=True)]
    rows += [(4, 0, c, v) for c, v in zip(("A", "B", TOTAL), (10.0, 10.0, 40.0), strict=True)]
    return spark.createDataFrame(rows, "entity long, period long, category string, value double")


def test_panel_and_features(long):
    wide = panel.with_residual(panel.pivot(long, ["A", "B", TOTAL]), ["A", "B"], TOTAL, REST)
    assert {r.entity for r in panel.full_history(wide, 3).collect()} == {1, 2, 3}
    assert wide.filter("entity = 3 and period = 0").first()[REST] == -10.0
    rows = panel.raw_features(long.filter("entity < 4"), ["A", "B"], TOTAL, REST).collect()
    names = ["clr_A", "clr_B", f"clr_{REST}"]
    for r in rows:
        assert abs(sum(r[n] for n in names)) < 1e-9 and abs(sum(r[f"share_{c}"] for c in ("A", "B", REST)) - 1) < 1e-12
    first = {r.entity: r for r in rows if r.period == 0}
    last = {r.entity: r for r in rows if r.period == 2}
    assert first[1].log_level_rel == 0 and math.isclose(first[2].log_level_rel, math.log(2))
    for e in first:
        assert all(math.isclose(first[e][n], last[e][n], abs_tol=1e-9) for n in names)


def test_full_history_drops(long, spark):
    wide = panel.pivot(long, ["A"])
    assert {r.entity for r in panel.full_history(wide, 3, spark.createDataFrame([(2,)], "entity long")).collect()} == {1, 3}


def test_causal_mean_sees_no_future(spark):
    series = lambda last: spark.createDataFrame([(1, t, float(t if t < 4 else last)) for t in range(5)], "entity long, period long, x double")
    a, b = ({r.period: r.x for r in panel.causal_mean(series(last), ["x"], 3).collect()} for last in (4, 99))
    assert a == {0: 0.0, 1: 0.5, 2: 1.0, 3: 2.0, 4: 3.0} and all(a[t] == b[t] for t in range(4))


def test_causal_mean_counts_calendar_periods(spark):
    gaps = spark.createDataFrame([(1, 0, 1.0), (1, 5, 3.0)], "entity long, period long, x double")
    assert {r.period: r.x for r in panel.causal_mean(gaps, ["x"], 3).collect()} == {0: 1.0, 5: 3.0}


def test_growth_of_parallel_levels_is_zero(spark):
    levels = [[100.0, 200.0, 300.0], [110.0, 220.0, 330.0], [121.0, 242.0, 363.0]]
    rows = spark.createDataFrame([(e, t, v) for t, row in enumerate(levels) for e, v in enumerate(row)], "entity long, period long, level double")
    found = panel.log_growth(rows, "level").collect()
    assert len(found) == 6 and all(abs(r.growth) < 1e-12 for r in found)


def test_scores_have_mean_0_and_deviation_1(spark):
    rows = spark.createDataFrame([(e, 0, float(e), 5.0) for e in range(10)], "entity long, period long, x double, y double")
    stats = panel.zscore_within(rows, ["x", "y"]).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.max("y").alias("y")).first()
    assert abs(stats.m) < 1e-12 and abs(stats.s - 1) < 1e-12 and stats.y == 0


def test_distances(spark):
    pairs = spark.createDataFrame([(2, 1, 100.0, "highway"), (3, 1, 0.0, "highway"), (3, 2, 50.0, "railway")], "x long, y long, distance double, type string")
    places = spark.createDataFrame([(1, 55.0, 37.0), (2, 55.0, 38.0), (3, 56.0, 37.0)], "entity long, lat double, lon double")
    assert {(r.i, r.j): r.km for r in entities.distances(places, pairs).collect()} == {(1, 2): 100.0, (1, 3): 5.0, (2, 3): 50.0}


def test_fallback_match(spark):
    dictionary = spark.createDataFrame([(1, "a", None, None), (2, "b", None, None), (3, "c", None, None), (4, "d", "u", None), (5, "e", None, "u"), (6, "f", None, "u")], "entity long, code string, change_from string, change_to string")
    source = spark.createDataFrame([("a", "x", 1.0, 50.0, 1.0), ("z", "b", 1.0, 70.0, 2.0), ("e", "y", 10.0, 100.0, 100.0), ("f", "w", 30.0, 300.0, 200.0)], "code string, stable string, weight double, population double, mean_wage double")
    found = {r.entity: (r.quality, r.population, r.mean_wage) for r in entities.fallback_match(dictionary, source, ["population", "mean_wage"]).collect()}
    assert found[1][:2] == ("exact", 50.0) and found[2][:2] == ("stable", 70.0) and found[3][:2] == ("missing", None)
    assert found[4] == ("union", 400.0, (100 * 10 + 200 * 30) / 40)


def test_population_and_sections(spark):
    rows = spark.createDataFrame([("top", "1512000", "1512000", "1000", "все"), ("top", "1512000", "1512000", "1000", "все"), ("top", "1512000", "1512000", "400", "город"), ("top", "02000000", "2000000", "0", "все"), ("low", "3", "3", "5", "все"), ("top", "4000000", "4000000", "ND", "город")], "mun_level string, oktmo string, oktmo_stable string, indicator_value string, mest string")
    top = external.top_level(rows, "top", ["mun_level", "oktmo", "note"])
    assert top.count() == 4 and "note" in top.columns
    found = {r.oktmo8: r for r in external.population(top, {"все": "population", "город": "urban"}, "population").collect()}
    assert (found["01512000"].population, found["01512000"].urban, found["01512000"].urban_share) == (1000.0, 400.0, 0.4)
    assert found["02000000"].population is None


def test_best_period(spark):
    rows = spark.createDataFrame([("1", "_total", "year", 1.0), ("1", "A", "quarter", 2.0), ("1", "A", "year", 3.0), ("2", "A", "quarter", 4.0), ("2", "A", "other", 5.0)], "oktmo8 string, section string, indicator_period string, value double")
    assert sorted(r.value for r in external.best_period(rows, ["quarter", "year"]).collect()) == [1.0, 3.0, 4.0]
