"""Evaluation suites: a manifest, search queries and impact scenarios in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_MANIFEST = "suite struct<name:string,description:string>, repos array<struct<name:string,url:string,revision:string,languages:array<string>>>"
_QUERIES = "queries array<struct<repo:string,query:string,expected:array<string>,category:string>>"
_SCENARIOS = (
    "scenarios array<struct<repo:string,description:string,target:string,depth:bigint,confidence:string,expected_affected:array<string>>>"
)


def _rows(spark: SparkSession, paths: str | list[str], shape: str, field: str) -> DataFrame:
    found = spark.read.schema(shape).option("multiLine", True).option("mode", "FAILFAST").json(paths)
    return found.select(F.inline(field))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``name, url, revision, languages`` of the suite's repositories."""
    return _rows(spark, path, _MANIFEST, "repos")


def read_queries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``query_id, repo, query, expected, category``; the id is a hash of repository and query."""
    found = _rows(spark, paths, _QUERIES, "queries").fillna("uncategorized", ["category"])
    return found.select(F.xxhash64("repo", "query").alias("query_id"), "*")


def read_scenarios(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``scenario, repo, description, target, depth, confidence, expected_affected``."""
    found = _rows(spark, paths, _SCENARIOS, "scenarios")
    return found.select(F.concat_ws(" ", "repo", "target", F.col("depth").cast("string"), "confidence").alias("scenario"), "*")
