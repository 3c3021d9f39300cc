"""Connected components of a link table, by alternating large-star and small-star contraction.

Each round links the neighbours of every node to the smallest node among them (large-star: those above
the node; small-star: those below), until nothing changes: a number of rounds that grows with the logarithm of the
longest chain. Rounds are tables in the shared folder, so lost executors cost no more than a round. Minima
are aggregated before the shuffle; a node with very many neighbours is looked up by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netpanel.llm import shared


def _star(links: DataFrame, large: bool, total: int) -> DataFrame:
    """``links`` (a > b). Large: a node's neighbours above it link to the smallest of all; small: those below it."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links
    lowest = both.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("degree"))
    lowest = lowest.select("a", F.least("a", "low").alias("low"), "degree")
    met = shared.lookup(both, lowest, "a", "degree", total)
    if large:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = met.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("x")).select("x.a", "x.b")
    return out.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b: long); root is the component's smallest node, and has no row of its own."""
    now = shared.written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "links")  # as many tasks as found them
    state = None
    while True:
        count, mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not count or state == (count, mark):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state, before = (count, mark), now
        now = shared.written(_star(_star(now, True, 2 * count), False, count), "links", rows=count)
        shared.drop(before)
