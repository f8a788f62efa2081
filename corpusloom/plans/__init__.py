"""The library's own queries, bound to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpusloom.plans import bindings_assembly, bindings_graph, bindings_indexing, bindings_platform, bindings_retrieval, bindings_scan

    return bindings_retrieval.Q | bindings_scan.Q | bindings_graph.Q | bindings_platform.Q | bindings_assembly.Q | bindings_indexing.Q


def oracle_sql() -> dict[str, str]:
    from corpusloom.plans import bindings_assembly, bindings_graph, bindings_indexing, bindings_platform, bindings_retrieval, bindings_scan

    return bindings_retrieval.SQL | bindings_scan.SQL | bindings_graph.SQL | bindings_platform.SQL | bindings_assembly.SQL | bindings_indexing.SQL
