"""Shared folders, tables and skew-safe joins that the operators of this subpackage use.

Everything an operator hands from one task to another, or from one job to the next, lies in the
folder that ``spark.checkpoint.dir`` names, which all executors share. Without it and without a checkpoint folder of the
context there is none, unless Spark runs on one machine (a local master): then a new folder there serves.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch of rows that Python gets; beside it a task holds a few copies and what it makes of them.
BATCH_BYTES = 8 << 20
#: Short rows of a file of a small table.
FILE_ROWS = 100_000
#: Keys that own at least this share of all rows are broadcast; there can be at most 1 / HOT_SHARE of them.
HOT_SHARE = 1e-3
#: No key with fewer rows than this counts as hot.
HOT_ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, else the context's checkpoint folder, else, only with a local master, a new one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if base:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(base)
        return base
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="netpanel-"))
    return context.getCheckpointDir()


def bound_batches(df: DataFrame) -> None:
    """Lets no batch of rows on its way to Python hold more than BATCH_BYTES (a setting of the session), however long its texts are."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) != str(BATCH_BYTES):
        conf.set(name, str(BATCH_BYTES))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/netpanel/{name}-{uuid.uuid4().hex}"


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """Lets Spark delete the shuffle files of a write when it ends: its rows lie in a table, so the disk holds the shuffles of one step at a time."""
    conf, name = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        yield
    finally:
        conf.set(name, before) if before is not None else conf.unset(name)


def written(df: DataFrame, name: str, rows: int | None = None, parts: str | None = None) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: cuts lineage and survives lost executors; the write's shuffles go.

    ``rows``: about how many short rows of a light last step there are; the table then has a file for every FILE_ROWS of
    them, not one for each task, however many partitions shuffles have. ``parts``: a column with a folder for each of its few values.
    """
    path = scratch(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    with _cleaning(df.sparkSession):
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(parts) if parts else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more: what was made of them lies in tables too."""
    for df in tables:
        delete(df.sparkSession, df._scratch)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI in the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join on ``key``, whatever share of the left rows one key has; ``right`` has a key once.

    ``weight`` is the right column that counts the left rows of the key, ``total`` the number of left
    rows. The keys of at least HOT_SHARE of the rows, of which there are at most 1 / HOT_SHARE, are
    broadcast; their rows then take part in the shuffle join under a random key that matches nothing,
    so they spread evenly. The order of magnitude of every other key is bounded by HOT_SHARE.
    Null keys find nothing.
    """
    least = max(HOT_ROWS, total * HOT_SHARE)
    values = [c for c in right.columns if c not in (key, weight)]
    right = right.withColumn("_hit", F.lit(True))
    hot = right.filter(F.col(weight) >= least).select(F.col(key).alias("_hot_key"), F.struct(*values, "_hit").alias("_hot"))
    cold = right.filter(F.col(weight) < least).select(F.col(key).alias("_cold_key"), F.struct(*values, "_hit").alias("_cold"))
    kind = right.schema[key].dataType
    off = F.concat(F.lit("~"), F.rand(7).cast("string")) if kind.simpleString() == "string" else F.lit(None)
    spread = F.xxhash64(F.rand(7))
    out = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    is_hot: Column = F.col("_hot_key").isNotNull()
    if kind.simpleString() == "string":
        out = out.withColumn("_key", F.when(is_hot | F.col(key).isNull(), off).otherwise(F.col(key)))
        out = out.join(cold, F.col("_key") == F.col("_cold_key"), "left")
    else:
        # the second part of the key keeps a random number of a hot row from matching a real key
        out = out.withColumn("_key", F.when(is_hot | F.col(key).isNull(), spread).otherwise(F.col(key).cast("long")))
        out = out.withColumn("_side", F.when(is_hot | F.col(key).isNull(), F.lit(1)).otherwise(F.lit(0)))
        cold = cold.withColumn("_cold_key", F.col("_cold_key").cast("long")).withColumn("_cold_side", F.lit(0))
        out = out.join(cold, (F.col("_key") == F.col("_cold_key")) & (F.col("_side") == F.col("_cold_side")), "left")
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    return out.select(*left.columns, *[found[c].alias(c) for c in values])
