"""Sources: the star-schema tables, and the panels, label series and spaces that queries take from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six cells of return flag and line status, in order; the last one is the residual.
CATEGORIES = ("AF", "AO", "NF", "NO", "RF", "RO")
EVENTS = ("click", "purchase")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity (supplier), period (quarter number), category (return flag and line status), value (extended price)."""
    rows = table(spark, sf_dir, "lineitem")
    period = (F.year("l_shipdate") * 4 + F.quarter("l_shipdate")).cast("long")
    return rows.groupBy(F.col("l_suppkey").alias("entity"), period.alias("period"), F.concat("l_returnflag", "l_linestatus").alias("category")).agg(F.sum("l_extendedprice").alias("value"))


def order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity (customer), period (year), category (order priority), value (total price): histories with gaps."""
    rows = table(spark, sf_dir, "orders")
    return rows.groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").cast("long").alias("period"), F.col("o_orderpriority").alias("category")).agg(F.sum("o_totalprice").alias("value"))


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity (user), period (day number from 2024-01-01), value (sum), label (type of the last event)."""
    rows = table(spark, sf_dir, "events").withColumn("period", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long"))
    return rows.groupBy(F.col("user_id").alias("entity"), "period").agg(F.sum("value").alias("value"), F.max_by("event_type", "ts").alias("label"))


def embedding_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, x (array of doubles), label."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("entity"), F.col("embedding").cast("array<double>").alias("x"), "label")


def strings_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ";", missing: tuple[str, ...] = ("ND", "UD", "")) -> DataFrame:
    """A CSV of which every column is a string; the given markers are NULL."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.option("sep", sep).option("header", True).schema(schema).csv(path)
    return rows.select(*[F.when(F.trim(F.col(c)).isin(*missing), None).otherwise(F.col(c)).alias(c) for c in columns])


def indicator(spark: SparkSession, parquet: str | None, csv_by_year: dict[int, str], year: int, columns: list[str]) -> DataFrame:
    """An indicator's rows of a year: the parquet if there is one, else the year's CSV; an error if neither has rows."""
    if parquet:
        rows = spark.read.parquet(parquet).filter(F.col("year").cast("int") == year).select(*[F.col(c).cast("string").alias(c) for c in columns])
    elif year in csv_by_year:
        rows = strings_csv(spark, csv_by_year[year], columns)
    else:
        raise FileNotFoundError(f"no source for {year}")
    if rows.isEmpty():
        raise ValueError(f"the source has no rows for {year}")
    return rows


def connections(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Pairs with distances; the filter on the kind reaches the scan."""
    rows = spark.read.parquet(path)
    return rows.filter(F.col("type") == kind) if kind else rows


def polygons(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """entity, rings (outer ones, open) of GeoJSON features, one for each line; points count once, holes are left out."""

    def rings(batches):
        import json

        import pandas as pd

        for batch in batches:
            out = []
            for line in batch["value"]:
                if not line.strip():
                    continue
                feature = json.loads(line)
                shape = feature["geometry"] or {"type": "MultiPolygon", "coordinates": []}
                parts = [shape["coordinates"]] if shape["type"] == "Polygon" else shape["coordinates"]
                entity = feature[key] if key in feature else feature["properties"][key]
                out.append((entity, [[{"lon": float(x), "lat": float(y)} for x, y, *_ in (part[0][:-1] if part[0][0] == part[0][-1] else part[0])] for part in parts if part]))
            yield pd.DataFrame(out, columns=["entity", "rings"])

    return spark.read.text(path).mapInPandas(rings, "entity long, rings array<array<struct<lon:double,lat:double>>>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, path: str, wanted: dict[str, str]) -> None:
    """Raises ValueError unless files (by the last part of their names) have the SHA-256 given."""
    found = {r["path"].rsplit("/", 1)[1]: r.sha256 for r in digests(spark, path).collect()}
    if wrong := [name for name, value in wanted.items() if found.get(name) != value]:
        raise ValueError(f"files that differ or are missing: {', '.join(sorted(wrong))}")
