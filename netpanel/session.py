"""Sessions with the settings that the engine relies on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "netpanel", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings given win over these."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return builder.config(map=defaults | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL throughout: NaN in double and float columns becomes NULL on the way in."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(t)) for c, t in df.dtypes if t in ("double", "float")})


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else the context's checkpoint folder; a new one only on one machine."""
    context, base = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not base and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="netpanel-"))
    return base or context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and plans built on it begin with a scan, however long its own is."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/netpanel/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to tasks by key for work that is dear and data that are small: adaptive execution, which goes by bytes, would make one task of many keys."""
    context = df.sparkSession.sparkContext
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * context.defaultParallelism), *keys)


def executors(spark: SparkSession) -> int:
    """How many executors there are; one at least, which is the driver of a local session."""
    return max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)


def alone(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Rows dealt by ranges of a key to as many tasks as there are executors, for groups that need an executor's memory; and the cores of each task."""
    n = executors(df.sparkSession)
    return df.repartitionByRange(n, key), max(1, df.sparkSession.sparkContext.defaultParallelism // n)
