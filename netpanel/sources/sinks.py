"""Sinks: partitioned tables of features, graphs, labels and metrics, and small JSON and GeoJSON documents."""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How each kind of table is partitioned, so that readers prune by what they ask for.
PARTITIONED = {"features": ("period",), "graphs": ("layer", "period"), "labels": ("method", "k", "layer"), "metrics": ("layer",)}


def save(df: DataFrame, root: str, kind: str, mode: str = "overwrite") -> None:
    """Writes a table of a kind; only the partitions that ``df`` has are replaced."""
    keys = [c for c in PARTITIONED.get(kind, ()) if c in df.columns]
    writer = df.repartition(*keys).write.mode(mode).option("partitionOverwriteMode", "dynamic") if keys else df.write.mode(mode)
    (writer.partitionBy(*keys) if keys else writer).parquet(f"{root.rstrip('/')}/{kind}")


def load(spark: SparkSession, root: str, kind: str, **where: Any) -> DataFrame:
    rows = spark.read.parquet(f"{root.rstrip('/')}/{kind}")
    for column, value in where.items():
        rows = rows.filter(F.col(column) == value)
    return rows


def as_documents(df: DataFrame, key: str | None = None) -> DataFrame:
    """A compact JSON document for each row; NULL stays as null."""
    body = [c for c in df.columns if c != key]
    text = F.to_json(F.struct(*body), {"ignoreNullFields": "false"}).alias("document")
    return df.select(*([key] if key else []), text)


def plain(value: Any) -> Any:
    """Rows, tuples and numbers as JSON knows them; NaN and infinities become null."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if hasattr(value, "asDict"):
        return plain(value.asDict(recursive=True))
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    return value.item() if hasattr(value, "item") else value


def dump(value: Any) -> str:
    """A small document as compact JSON."""
    return json.dumps(plain(value), ensure_ascii=False, separators=(",", ":"), allow_nan=False)
