"""Streams give what the batch operators give, as far as the watermark lets them."""

from __future__ import annotations

from pyspark.sql import functions as F

from netpanel.operators import vectors
from netpanel.sources import tables
from netpanel.streaming import events


def collected(spark, stream, name, mode="append"):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def event_folder(tmp_path, sf_dir):
    folder = tmp_path / "events"
    folder.mkdir()
    (folder / "part.parquet").symlink_to(f"{sf_dir}/events.parquet")
    return str(folder)


def test_daily_counts(spark, sf_dir, tmp_path):
    stream = events.daily(events.read_events(spark, event_folder(tmp_path, sf_dir)))
    got = {(r.entity, r.period, r.event_type): r.n for r in collected(spark, stream, "daily").collect()}
    rows = tables.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("entity"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("period"), "event_type").count()
    want = {(r.entity, r.period, r.event_type): r["count"] for r in rows.collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) > 0.8 * len(want)


def test_classification_equals_the_batch(spark, tmp_path):
    points = spark.createDataFrame([(k, 0, [float(k), 1.0]) for k in range(20)], "entity long, period long, x array<double>")
    points.write.parquet(str(tmp_path / "p"))
    centres = spark.createDataFrame([(0, [2.0, 1.0]), (1, [12.0, 1.0])], "label int, centre array<double>")
    stream = events.classified(spark.readStream.schema(points.schema).parquet(str(tmp_path / "p")), centres)
    got = {r.entity: (r.label, round(r.margin, 9)) for r in collected(spark, stream, "classes").collect()}
    want = {r.entity: (r.nearest, round(r.margin, 9)) for r in vectors.nearest_centre(points, centres).collect()}
    assert got == want


def test_changes_become_known_once(spark, tmp_path):
    series = {1: [0, 0, 0, 1, 0, 0, 2, 2, 2, 2], 2: [5, 5, 6, 6, 6, 6, 5, 5, 5, 5]}
    for half in (0, 1):
        rows = [(e, t, v) for e, s in series.items() for t, v in enumerate(s) if t // 5 == half]
        spark.createDataFrame(rows, "entity long, period long, label int").coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
    stream = spark.readStream.schema("entity long, period long, label int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "l"))
    got = sorted(tuple(r) for r in collected(spark, events.confirmed_changes(stream), "changes").collect())
    assert got == [(1, 0, 2, 6, 8), (2, 6, 5, 6, 8)]
