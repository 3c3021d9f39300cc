"""Polygons."""

from __future__ import annotations

import json

from netpanel.operators import geo

ACROSS = [(170.0, 62.0), (-170.0, 62.0), (-170.0, 68.0), (170.0, 68.0)]


def test_split_at_the_antimeridian():
    parts = geo.split_antimeridian(ACROSS)
    assert len(parts) == 2 and abs(sum(abs(geo.ring_area(p)) for p in parts) - 120) < 1e-9
    assert all(-180 <= x <= 180 for p in parts for x, _ in p)
    plain = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)]
    assert geo.split_antimeridian(plain) == [plain]


def test_small_parts_and_rounding():
    large, small = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], [(9.0, 9.0), (9.0001, 9.0), (9.0, 9.0001)]
    assert geo.kept_parts([small, large], 1.0) == [large] and geo.kept_parts([small], 1.0) == [small]
    assert geo.rounded_ring(small, 3) == []


def test_geojson(spark):
    rows = spark.createDataFrame([(7, [[{"lon": x, "lat": y} for x, y in ACROSS]])], "entity long, rings array<array<struct<lon:double,lat:double>>>")
    doc = json.loads(geo.geojson(rows).first().feature)
    assert doc["id"] == 7 and len(doc["geometry"]["coordinates"]) == 2
    p = geo.representative_points(rows).first()
    assert p.lat == 65.0


def test_reads_what_it_writes(spark, tmp_path):
    from netpanel.sources import tables

    rows = spark.createDataFrame([(7, [[{"lon": x, "lat": y} for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 1.0))]])], "entity long, rings array<array<struct<lon:double,lat:double>>>")
    geo.geojson(rows).select("feature").write.text(str(tmp_path / "g"))
    assert tables.polygons(spark, str(tmp_path / "g")).collect() == rows.collect()
