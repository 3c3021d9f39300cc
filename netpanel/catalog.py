"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netpanel.plans import cluster_queries, entity_queries, graph_queries, label_queries, panel_queries, serving_queries, stat_queries

MODULES = (panel_queries, entity_queries, label_queries, graph_queries, stat_queries, cluster_queries, serving_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
