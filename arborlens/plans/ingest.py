"""Extraction, resolution and incremental upkeep over the sources and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.incremental import KeyedState, replay_runs
from ..operators.resolve import resolve_all
from ..runtime import materialize, new_path
from ..sources.extract import extract, part
from ..sources.store import upsert, without_files
from ..sources.tables import read_table
from ..streaming.maintain import dependents
from .common import SECONDS, edges, symbols, with_graph
from .problems import file_deliveries, run_log

GO_MODULE = "marrowfield.example"


def _found(spark, sf):
    return materialize(extract(read_table(spark, sf, "sources")), "extracted")[0]


def extracted_symbols(spark, sf):
    return part(_found(spark, sf), "symbols").drop("path", "decorators")


def extracted_imports(spark, sf):
    rows = part(_found(spark, sf), "imports")
    return rows.select("path", "line", "specifier", F.size("names").alias("n_names"), "is_type_only", "is_namespace", "is_side_effect")


def resolved_edges(spark, sf):
    return resolve_all(_found(spark, sf), read_table(spark, sf, "sources").select("path"), GO_MODULE)


def _changed(spark, sf):
    """Files that were delivered with another content in the last run that delivered any."""
    state = KeyedState(spark, new_path(spark, "changed-state"))
    runs = replay_runs(state, run_log(spark, sf), file_deliveries(spark, sf), new_path(spark, "changed-deliveries"))
    for _, rows in reversed(runs):
        changed = rows.where(F.col("change") == "changed").select(F.col("record_key").alias("path"))
        if not changed.isEmpty():
            return changed
    return spark.createDataFrame([], "path string")


def _dependents(spark, sf, changed):
    return dependents(symbols(spark, sf, "file_path"), edges(spark, sf), changed)


def _edges_without(spark, sf, gone):
    _, left = without_files(symbols(spark, sf, "file_path"), edges(spark, sf), gone)
    return left


def incremental_dependents(spark, sf):
    """Files that depend on what the last run changed."""
    return _dependents(spark, sf, _changed(spark, sf))


def removed_file_edges(spark, sf):
    """Edges that stay when what the last run changed is taken out."""
    return _edges_without(spark, sf, _changed(spark, sf))


def upserted_files(spark, sf):
    """The files feed of the first loads, with all later rows upserted in order of load."""
    feed = read_table(spark, sf, "files").where(F.col("path").isNotNull()).select("path", "load_id", "language", "updated_at", "hash")
    order = F.struct("load_id", "updated_at", "hash", "language")
    first = feed.where(F.col("load_id") <= 5)
    old = upsert(first.limit(0), first, ["path"], order)
    return upsert(old, feed.where(F.col("load_id") > 5), ["path"], order).select("path", "load_id")


QUERIES = {
    f.__name__: f
    for f in (
        extracted_symbols, extracted_imports, resolved_edges, incremental_dependents, removed_file_edges, upserted_files,
    )
}
_LIBS = f"""good AS (SELECT run_id, lag(run_id) OVER (ORDER BY run_id) AS before FROM index_runs WHERE status = 'succeeded'),
feed AS (SELECT path, {SECONDS} AS s, regexp_extract(lower(hash), '([0-9a-f]{{64}})', 1) AS h, load_id FROM files WHERE hash IS NOT NULL AND updated_at IS NOT NULL AND path IS NOT NULL),
sta AS (SELECT g.run_id, f.path, arg_max(f.h, (f.s, f.h)) AS h FROM good g JOIN feed f ON f.load_id <= g.run_id GROUP BY ALL),
chg AS (SELECT n.run_id, n.path FROM sta n JOIN good g ON g.run_id = n.run_id JOIN sta o ON o.run_id = g.before AND o.path = n.path WHERE o.h <> n.h),
lib AS (SELECT path FROM chg WHERE run_id = (SELECT max(run_id) FROM chg)), own AS (SELECT qualified_name FROM sym WHERE file_path IN (SELECT path FROM lib))"""
ORACLE = {
    "incremental_dependents": with_graph("fil", "sym", "edg")
    + f""", {_LIBS} SELECT DISTINCT s.file_path AS path FROM edg e JOIN sym s ON s.qualified_name = e.source
WHERE e.target IN (SELECT qualified_name FROM own) AND s.file_path IS NOT NULL AND s.file_path NOT IN (SELECT path FROM lib)""",
    "removed_file_edges": with_graph("fil", "sym", "edg")
    + f""", {_LIBS}, gone AS (SELECT path AS g FROM lib UNION SELECT qualified_name FROM own)
SELECT * FROM edg WHERE source NOT IN (SELECT g FROM gone) AND target NOT IN (SELECT g FROM gone)""",
    "upserted_files": "SELECT path, coalesce(max(load_id) FILTER (load_id > 5), max(load_id)) AS load_id FROM files WHERE path IS NOT NULL GROUP BY path",
}
