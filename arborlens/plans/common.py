"""The current graph as DataFrames, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.symbolgraph import current_edges, current_files, current_symbols
from ..sources.tables import read_table


def files(spark: SparkSession, sf: str) -> DataFrame:
    return current_files(read_table(spark, sf, "files"))


def symbols(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return current_symbols(read_table(spark, sf, "symbols"), list(columns) or None)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return current_edges(read_table(spark, sf, "edges"))


SECONDS = "CASE WHEN abs(updated_at) >= 100000000000 THEN updated_at // 1000 ELSE updated_at END"
PLAIN = "regexp_replace(replace(trim({0}), '\\', '/'), '^\\./', '')"
_FILES = f"""fil AS (
  SELECT path, language, lower(trim(regexp_replace(trim(lower(hash)), '^sha-?_?256\\s*[:=\\-_ ]\\s*', ''))) AS hash, s AS updated_at
  FROM (SELECT *, {SECONDS} AS s, row_number() OVER (PARTITION BY path ORDER BY {SECONDS} DESC NULLS LAST, load_id DESC NULLS LAST,
    lower(hash) DESC NULLS LAST, language DESC NULLS LAST) AS rn FROM files WHERE path IS NOT NULL) WHERE rn = 1)"""
_SYMBOLS = f"""sym AS (
  SELECT qualified_name, name, kind, {PLAIN.format("file_path")} AS file_path, line_start, line_end, visibility, is_exported, is_async,
    is_test, decorators, signature
  FROM (SELECT *, row_number() OVER (PARTITION BY qualified_name ORDER BY {SECONDS} DESC NULLS LAST, symbol_id DESC) AS rn
        FROM symbols WHERE qualified_name IS NOT NULL) WHERE rn = 1)"""
_EDGES = f"""edg AS (
  SELECT min(edge_id) AS edge_id, k AS kind, s AS source, t AS target FROM (
    SELECT edge_id, lower(regexp_replace(kind, '([a-z])([A-Z])', '\\1_\\2', 'g')) AS k, {PLAIN.format("source")} AS s,
      {PLAIN.format("target")} AS t FROM edges) WHERE k IS NOT NULL AND s IS NOT NULL AND t IS NOT NULL GROUP BY k, s, t)"""
_PARTS = {"fil": _FILES, "sym": _SYMBOLS, "edg": _EDGES}


def with_graph(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause that defines the wanted parts of the current graph (fil, sym, edg)."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(_PARTS[n] for n in names)


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
