"""All queries of the core library by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import analyses, clonesets, groups, ingest, lookups, problems, searches

_MODULES = [problems, lookups, analyses, searches, clonesets, groups, ingest]


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}


def flagship(spark: SparkSession, directory: str) -> DataFrame:
    return problems.edge_target_stats(spark, directory)
