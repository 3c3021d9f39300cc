"""Sources, sinks, configuration, interpretation; and every registered query against its SQL."""

from __future__ import annotations

import importlib
import json
import math
import sys

import duckdb
import pytest

import __spark_entry__
from netpanel import catalog, config, session
from netpanel.operators import interpret
from netpanel.sources import sinks, tables

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(got.columns)
    order = [got.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[k]) for k in order) for r in got.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == want
    spark.catalog.clearCache()


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns[:2] == ["entity", "period"]
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_does_without_the_llm_subpackage(monkeypatch):
    class Absent:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("netpanel.llm"):
                raise ModuleNotFoundError(name)

    kept = {k: v for k, v in sys.modules.items() if k.startswith(("netpanel", "__spark_entry__"))}
    for k in kept:
        monkeypatch.delitem(sys.modules, k)
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, package=None: None)
    monkeypatch.setattr(sys, "meta_path", [Absent(), *sys.meta_path])
    entry = importlib.import_module("__spark_entry__")
    assert not [q for q in entry.queries() if q.startswith("op1")] and "causal_zscore" in entry.queries()
    for k in [k for k in sys.modules if k.startswith(("netpanel", "__spark_entry__"))]:
        del sys.modules[k]
    sys.modules.update(kept)


def test_strings_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code;value\n1;2,5\n2;ND\n3;UD\n4;\n")
    rows = tables.strings_csv(spark, str(tmp_path / "a.csv"), ["code", "value"]).orderBy("code").collect()
    assert [r.value for r in rows] == ["2,5", None, None, None]
    assert tables.indicator(spark, None, {2023: str(tmp_path / "a.csv")}, 2023, ["code", "value"]).count() == 4
    with pytest.raises(FileNotFoundError):
        tables.indicator(spark, None, {}, 2023, ["code"])


def test_sinks(spark, tmp_path):
    edges = spark.createDataFrame([("a", 1, 1, 2, 0.5), ("b", 1, 1, 2, 0.7), ("a", 2, 1, 2, 0.9)], "layer string, period long, i long, j long, w double")
    sinks.save(edges, str(tmp_path), "graphs")
    sinks.save(edges.filter("layer = 'b'").withColumn("w", edges.w * 2), str(tmp_path), "graphs")
    assert {(r.layer, r.period): r.w for r in sinks.load(spark, str(tmp_path), "graphs").collect()} == {("a", 1): 0.5, ("b", 1): 1.4, ("a", 2): 0.9}
    assert sinks.load(spark, str(tmp_path), "graphs", layer="a").count() == 2
    assert json.loads(sinks.dump({"x": float("nan"), 1: (1.5, None)})) == {"x": None, "1": [1.5, None]}
    docs = sinks.as_documents(spark.createDataFrame([(1, None, 2.0)], "k int, a string, b double"), "k").first()
    assert json.loads(docs.document) == {"a": None, "b": 2.0}


def test_file_digests(spark, tmp_path):
    import hashlib

    (tmp_path / "f.bin").write_bytes(b"abc")
    tables.verify(spark, str(tmp_path), {"f.bin": hashlib.sha256(b"abc").hexdigest()})
    with pytest.raises(ValueError):
        tables.verify(spark, str(tmp_path), {"f.bin": "0"})


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("features:\n  min_periods: 3\ngraphs:\n  comovement_lags: [0]\n")
    found = config.from_yaml(str(tmp_path / "c.yaml"))
    assert found.features.min_periods == 3 and found.graphs.comovement_lags == (0,) and found.methods.k == 6
    with pytest.raises(ValueError):
        config.from_dict({"features": {"nonsense": 1}})


def test_nan_becomes_null(spark):
    rows = session.nan_to_null(spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, k int"))
    assert sorted((r.k, r.x) for r in rows.collect()) == [(1, None), (2, 2.0)]


def test_profile_splits_the_spread(spark):
    rows = spark.createDataFrame([(0, 1.0, 10.0)] * 5 + [(1, 3.0, 10.0)] * 5, "label int, a double, b double")
    found = {(r.label, r.feature): r.rel_dev for r in interpret.mirkin_profile(rows, ["a", "b"]).collect()}
    assert found == {(0, "a"): -0.5, (1, "a"): 0.5, (0, "b"): 0.0, (1, "b"): 0.0}
    t = interpret.spread_totals(rows, ["a", "b"]).first()
    assert math.isclose(t["T"], t.B + t.W) and math.isclose(t.B_over_T, 1)


def test_importance_finds_the_telling_feature(spark):
    rows = spark.createDataFrame([(k, k % 2, 10.0 * (k % 2) + k / 100, float(k * 7 % 5)) for k in range(60)], "entity long, label int, a double, b double")
    found = {(r.label, r.feature): r["drop"] for r in interpret.permutation_importance(rows, ["a", "b"]).collect()}
    assert all(found[k, "a"] > 0.2 and abs(found[k, "b"]) < 0.05 for k in (0, 1))


def test_names_as_rules_and_leading_features_give_them(spark):
    means = spark.createDataFrame([(k, 2.0 if k < 10 else 0.1) for k in range(12)], "label int, level double")
    rules = [{"name": "rich", "short": "R", "description": "High level.", "when": {"level": {"min": "high"}}}]
    leading = spark.createDataFrame([(10, 1, "food", "+"), (10, 2, "travel", "-")], "label int, place int, feature string, sign string")
    said = spark.createDataFrame([(0, "Medians: x."), (11, "Medians: y.")], "label int, phrase string")
    rows = {r.label: r for r in interpret.rule_names(means, rules, {"high": 1.0}, leading=leading, phrases=said).collect()}
    assert [rows[k].name for k in (0, 1, 2, 7, 8, 9)] == ["rich", "rich II", "rich III", "rich VIII", "rich VIII", "rich VIII"]
    assert rows[1].short == "R II" and rows[0].description == "High level. Medians: x." and rows[1].description == "High level." and rows[0].rule == "rich"
    assert (rows[10].name, rows[10].short, rows[10].description, rows[10].rule) == ("Type 10: food +, travel -", "Type 10", "Leading features: food +, travel -.", None)
    assert (rows[11].name, rows[11].description) == ("Type 11", "Medians: y.")
    names = interpret.rule_names(means, rules, {"high": 1.0})
    settled = spark.createDataFrame([("ward", 6, "2024-12", 1, "agreed", None, None), ("ward", 5, "2024-12", 2, "other", "o", "o")], "method string, k int, period string, label int, name string, short string, description string")
    got = {r.label: r for r in interpret.with_locked(names, settled, "ward", 6, "2024-12").collect()}
    assert (got[1].name, got[1].short, got[2].name) == ("agreed", "R II", "rich III")


def test_readable_names_and_phrases(spark):
    raw = ["share_food", "share_cafe", "total"]
    assert interpret.split_names(raw) == (["share_food", "share_cafe"], ["total"]) and interpret.split_names(raw, ["share_cafe"])[1] == ["share_cafe"]
    assert interpret.display_names(raw, unit="EUR") == ["Share of food, %", "Share of cafe, %", "Total per head, EUR"]
    rows = [(k % 2, 0.2 + 0.2 * (k % 2), 0.1, 100.0 + 100 * (k % 2)) for k in range(10)]
    df = spark.createDataFrame(rows, "label int, food double, cafe double, total double")
    said = {r.label: r.phrase for r in interpret.phrases(interpret.readable_profile(df, ["food", "cafe"], ["total"]), ["food", "cafe"], ["total"]).collect()}
    assert said[1] == "Medians: total 133 % of the overall median; share of food 40.0 % (above the overall by 10.0 points)."
    assert interpret.inconsistent_totals(spark.createDataFrame([(3.0, 1.0, 2.0), (5.0, 1.0, None)], "t double, a double, b double"), "t", ["a", "b"]).count() == 1


def test_kept_tables_need_a_shared_folder(spark):
    assert session.kept(spark.range(5)).count() == 5 and session.shared_folder(spark)
