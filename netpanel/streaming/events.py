"""Structured Streaming over events (ts, user_id, event_type, value)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from netpanel.operators import vectors


def read_events(spark: SparkSession, path: str, schema: StructType | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of parquet files; timestamps without a zone become UTC ones, as watermarks need."""
    schema = schema or spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """period (day number from 2024-01-01), entity, event_type, n, value: tumbling days, closed once the watermark has passed."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), F.col("user_id").alias("entity"), "event_type")
    out = days.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return out.select(F.datediff(F.to_date("window.start"), F.lit("2024-01-01").cast("date")).cast("long").alias("period"), "entity", "event_type", "n", "value")


def sliding(events: DataFrame, width: str = "3 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """Mean value by entity over sliding windows: the causal smoothing."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width, step), F.col("user_id").alias("entity")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.end").alias("until"), "entity", "value", "n")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), F.col("user_id").alias("entity")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return out.select("entity", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("until"), "n", "value")


def classified(points: DataFrame, centres: DataFrame) -> DataFrame:
    """Each arriving point (entity, period, x) with its nearest centre and margin: a map against a static table of K centres, no state."""
    ordered = F.broadcast(centres.select("label", "centre").agg(F.array_sort(F.collect_list(F.struct("label", "centre"))).alias("_c")))
    rows = points.crossJoin(ordered)  # one row
    met = F.array_sort(F.transform("_c", lambda c: F.struct(vectors.distance(F.col("x"), c["centre"]).alias("d"), c["label"].alias("label"))))
    rows = rows.withColumn("_m", met)
    second = F.when(F.size("_m") > 1, F.element_at("_m", 2)["d"])
    first = F.col("_m")[0]["d"]
    margin = F.when(second.isNull(), 1.0).when(first > 0, F.least(F.lit(1.0), (second - first) / first)).when(second > 0, 1.0).otherwise(0.0)
    return rows.select("entity", "period", F.col("_m")[0]["label"].alias("label"), margin.alias("margin"))


CHANGES = "entity long, from_label int, to_label int, period long, known_at long"
_STATE = "current int, run int, start long, length long, last long"


def confirmed_changes(labels: DataFrame, min_run: int = 3) -> DataFrame:
    """Changes as they become known: a label that has held for ``min_run`` periods in a row and differs from the confirmed one.

    The state of an entity is its confirmed label and the run it is in. Rows of one batch are taken in the order of
    period; a row that is not later than what was seen is ignored. Unlike the batch operator the first label
    is not known before its run is long enough, and no earlier period is filled with it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, run, start, length, last = state.get if state.exists else (None, None, 0, 0, -(1 << 62))
        rows = pd.concat(list(batches)).sort_values("period")
        out = []
        for period, label in zip(rows["period"].tolist(), rows["label"].tolist(), strict=True):
            if period <= last:
                continue
            last = period
            if run is not None and label == run:
                length += 1
            else:
                run, start, length = label, period, 1
            if length == min_run and run != current:
                if current is not None:
                    out.append((key[0], current, run, start, period))
                current = run
        state.update((current, run, start, length, last))
        yield pd.DataFrame(out, columns=["entity", "from_label", "to_label", "period", "known_at"])

    return labels.groupBy("entity").applyInPandasWithState(step, CHANGES, _STATE, "append", GroupStateTimeout.NoTimeout)


def write_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Appends to a parquet table, exactly once: the file sink with its checkpoint."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
