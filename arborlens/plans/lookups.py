"""Scans, lookups, filters and traversals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.names import extension, file_stem, language_of, name_file, name_symbol, segments, short_name
from ..model import CONFIDENCE_NAMES, EDGE_KIND_TIERS, confidence_rank
from ..operators.analysis import entry_points
from ..operators.symbolgraph import (
    at_least,
    changed_symbols,
    find_by_name,
    find_cards,
    references_from,
    references_to,
    symbols_of_files,
    table_counts,
)
from ..operators.traversal import bfs, bfs_last, dfs_order, nodes_within, reachable
from ..runtime import materialize
from .common import edges, files, sql_list, symbols, with_graph

#: A symbol of the shared libraries that exists at every scale.
TARGET = "libs/text/slug.py::slugify"
STARTS = ["libs/text/slug.py::slugify", "libs/geo/point.go::Point", "libs/flags/src/lib.rs::FLAGS"]


def _starts(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "start string")


def all_files(spark, sf):
    return files(spark, sf)


def all_symbols(spark, sf):
    return symbols(spark, sf, "name", "kind", "file_path", "line_start", "line_end", "visibility", "is_exported", "is_async", "is_test", "signature")


def all_edges(spark, sf):
    return edges(spark, sf)


def graph_stats(spark, sf):
    return table_counts(files=files(spark, sf), symbols=symbols(spark, sf, "name"), edges=edges(spark, sf))


def degree_by_kind(spark, sf):
    counted = edges(spark, sf).groupBy("kind")
    return counted.agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("source").alias("n_sources"), F.count_distinct("target").alias("n_targets"))


def edges_by_confidence(spark, sf):
    rank = confidence_rank(F.col("kind"))
    label = F.element_at(F.array(*[F.lit(n) for n in CONFIDENCE_NAMES]), rank + 1)
    return edges(spark, sf).groupBy(label.alias("confidence")).agg(F.count(F.lit(1)).alias("n_edges"))


def edges_medium_up(spark, sf):
    return at_least(edges(spark, sf), 2)


def find_exact(spark, sf):
    return find_by_name(symbols(spark, sf, "name", "kind", "file_path"), "slugify")


def find_prefix(spark, sf):
    return find_by_name(symbols(spark, sf, "name", "kind", "file_path"), "Get_")


def find_card(spark, sf):
    return find_cards(symbols(spark, sf, "name", "kind", "file_path"), edges(spark, sf), "slugify")


def refs(spark, sf):
    return references_to(edges(spark, sf), TARGET).select("edge_id", "kind", "source")


def callers(spark, sf):
    return references_to(edges(spark, sf), TARGET, "calls").select("edge_id", "source")


def callees(spark, sf):
    """What the first caller of the target calls."""
    links = edges(spark, sf)
    first = references_to(links, TARGET, "calls").agg(F.min("source")).first()[0]
    return references_from(links, first, "calls").select("edge_id", "target")


def get_file(spark, sf):
    return files(spark, sf).where(F.col("path") == "libs/text/slug.py")


def get_symbol(spark, sf):
    return symbols(spark, sf, "name", "kind", "file_path", "line_start").where(F.col("qualified_name") == TARGET)


def symbols_for_files(spark, sf):
    paths = files(spark, sf).where(F.col("language") == "Go").select("path")
    return symbols_of_files(symbols(spark, sf, "name", "kind", "file_path"), paths).select("qualified_name", "file_path", "kind")


def file_languages(spark, sf):
    found = files(spark, sf).select("path", "language", language_of(F.col("path")).alias("by_extension"), extension(F.col("path")).alias("extension"))
    return found.select("path", "language", "extension", "by_extension", file_stem(F.col("path")).alias("stem"))


def name_parts(spark, sf):
    q = F.col("qualified_name")
    parts = symbols(spark, sf, "name").select("qualified_name", name_file(q).alias("file"), name_symbol(q).alias("symbol"), short_name(q).alias("short"))
    return parts.withColumn("segments", F.array_join(segments(q), " "))


def diff_hunks(spark, sf) -> DataFrame:
    """Hunks made from every symbol's span: its file, its first line and half its lines; none for spans of one line."""
    spans = symbols(spark, sf, "file_path", "line_start", "line_end").where(F.col("line_end") > F.col("line_start"))
    half = F.floor((F.col("line_end") - F.col("line_start") + 1) / 2)
    return spans.select(F.col("file_path").alias("file"), F.col("line_start").alias("new_start"), half.alias("new_count"))


def _touched(spark, sf, hunks):
    return changed_symbols(symbols(spark, sf, "file_path", "line_start", "line_end"), hunks).select("qualified_name", "file_path")


def diff_changed_symbols(spark, sf):
    return _touched(spark, sf, diff_hunks(spark, sf))


def _every_symbol(spark, sf) -> DataFrame:
    """All current symbols, as starts of the forward searches."""
    return symbols(spark, sf, "name").select(F.col("qualified_name").alias("start"))


def _graph(spark, sf, rank=0) -> DataFrame:
    """Edges of at least a rank, written once for all hops."""
    return materialize(at_least(edges(spark, sf), rank), "edges")[0]


def _walk(spark, sf, direction, depth, starts, rank=0):
    found = bfs(_graph(spark, sf, rank), starts, direction, depth)
    return found.select("start", "node", "depth", "edge_kind", F.concat_ws(" > ", "path").alias("path"))


def bfs_forward_d3(spark, sf):
    return _walk(spark, sf, "forward", 3, _every_symbol(spark, sf))


def bfs_backward_d2(spark, sf):
    return _walk(spark, sf, "backward", 2, _starts(spark, STARTS))


def bfs_high_conf(spark, sf):
    return _walk(spark, sf, "backward", 2, _every_symbol(spark, sf), 3)


def bfs_zero_depth(spark, sf):
    return _walk(spark, sf, "forward", 0, _every_symbol(spark, sf))


def blast_radius(spark, sf):
    """Everything within four edges of every symbol, with the strength of the last edge."""
    found = bfs_last(_graph(spark, sf), _every_symbol(spark, sf), "forward", 4, confidence_rank(F.col("kind")))
    return found.select(F.col("start").alias("target"), "node", "depth", F.col("tag").alias("confidence_rank"))


def diff_impact(spark, sf):
    """Blast radius of all symbols that a diff touches."""
    touched = _touched(spark, sf, diff_hunks(spark, sf)).select(F.col("qualified_name").alias("start"))
    return nodes_within(_graph(spark, sf, 1), touched, "forward", 2).select(F.col("start").alias("target"), "node", "depth")


def dfs_reachable(spark, sf):
    return reachable(_graph(spark, sf, 3), _every_symbol(spark, sf), "forward")


def dfs_preorder(spark, sf):
    """Depth-first order over high-confidence edges from every entry point."""
    own = symbols(spark, sf, "name", "kind", "file_path", "line_start", "visibility", "is_exported", "is_test", "decorators")
    starts = entry_points(own, edges(spark, sf)).select(F.col("qualified_name").alias("start"))
    return dfs_order(_graph(spark, sf, 3), starts, "forward")


QUERIES = {
    f.__name__: f
    for f in (
        all_files, all_symbols, all_edges, graph_stats, degree_by_kind, edges_by_confidence, edges_medium_up, find_exact, find_prefix,
        find_card, refs, callers, callees, get_file, get_symbol, symbols_for_files, file_languages, name_parts, diff_changed_symbols,
        bfs_forward_d3, bfs_backward_d2, bfs_high_conf, bfs_zero_depth, blast_radius, diff_impact, dfs_reachable, dfs_preorder,
    )
}

_RANK = "CASE " + " ".join(f"WHEN {{0}} IN ({sql_list(k)}) THEN {t}" for t, k in EDGE_KIND_TIERS.items()) + " END"
_HUNKS = """hunks AS (SELECT file_path AS file, line_start AS new_start, (line_end - line_start + 1) // 2 AS new_count FROM sym WHERE line_end > line_start)"""
_TOUCHED = """touched AS (SELECT s.qualified_name, s.file_path FROM sym s WHERE EXISTS (SELECT 1 FROM {0} h WHERE h.file = s.file_path
  AND s.line_start <= h.new_start + greatest(h.new_count, 1) - 1 AND h.new_start <= s.line_end))"""


_EVERY = "SELECT qualified_name AS start FROM sym"
_NAMED = f"SELECT unnest([{sql_list(STARTS)}]) AS start"


def _walk_sql(direction: str, depth: int, rank: int = 0, starts: str = _EVERY, extra: str = "", parts=("sym", "edg")) -> str:
    a, b = ("source", "target") if direction == "forward" else ("target", "source")
    return f"""{with_graph(*parts, recursive=True)}{extra},
st AS ({starts}),
step AS (SELECT edge_id, kind, {a} AS a, {b} AS b FROM edg WHERE {_RANK.format("kind")} >= {rank}),
walk(start, node, depth, kind, ids, way) AS (
  SELECT start, start, 0, NULL::VARCHAR, []::BIGINT[], [start] FROM st
  UNION ALL
  SELECT w.start, s.b, w.depth + 1, s.kind, list_append(w.ids, s.edge_id), list_append(w.way, s.b)
  FROM walk w JOIN step s ON s.a = w.node WHERE w.depth < {max(1, depth)}),
best AS (SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY depth, ids) AS rn FROM walk),
found AS (SELECT start, node, CAST(depth AS BIGINT) AS depth, kind AS edge_kind, array_to_string(way, ' > ') AS path FROM best WHERE rn = 1 AND depth > 0)
"""


_FOUND = "SELECT start, node, depth, edge_kind, path FROM found"
ORACLE = {
    "all_files": with_graph("fil") + " SELECT * FROM fil",
    "all_symbols": with_graph("sym") + " SELECT qualified_name, name, kind, file_path, line_start, line_end, visibility, is_exported, is_async, is_test, signature FROM sym",
    "all_edges": with_graph("edg") + " SELECT * FROM edg",
    "graph_stats": with_graph("fil", "sym", "edg")
    + " SELECT 'files' AS table_name, count(*) AS n FROM fil UNION ALL SELECT 'symbols', count(*) FROM sym UNION ALL SELECT 'edges', count(*) FROM edg",
    "degree_by_kind": with_graph("edg")
    + " SELECT kind, count(*) AS n_edges, count(DISTINCT source) AS n_sources, count(DISTINCT target) AS n_targets FROM edg GROUP BY kind",
    "edges_by_confidence": with_graph("edg")
    + f" SELECT (['structural', 'low', 'medium', 'high'])[{_RANK.format('kind')} + 1] AS confidence, count(*) AS n_edges FROM edg GROUP BY 1",
    "edges_medium_up": with_graph("edg") + f" SELECT * FROM edg WHERE {_RANK.format('kind')} >= 2",
    "find_exact": with_graph("sym") + " SELECT qualified_name, name, kind, file_path FROM sym WHERE name = 'slugify'",
    "find_prefix": with_graph("sym")
    + """, hit AS (SELECT *, CASE WHEN name = 'Get_' THEN 0 ELSE 1 END AS p FROM sym WHERE starts_with(lower(name), 'get_'))
SELECT qualified_name, name, kind, file_path FROM hit WHERE p = (SELECT min(p) FROM hit)""",
    "find_card": with_graph("sym", "edg")
    + """, hit AS (SELECT qualified_name, kind, file_path FROM sym WHERE name = 'slugify'),
side AS (SELECT target AS q, 'callers' AS l, source AS o, edge_id FROM edg WHERE kind = 'calls'
  UNION ALL SELECT source, 'callees', target, edge_id FROM edg WHERE kind = 'calls'
  UNION ALL SELECT target, 'tests', source, edge_id FROM edg WHERE kind = 'tested_by'),
num AS (SELECT *, row_number() OVER (PARTITION BY q, l ORDER BY edge_id) AS rn FROM side)
SELECT h.*, count(*) FILTER (n.l = 'callers') AS n_callers, coalesce(string_agg(n.o, ', ' ORDER BY rn) FILTER (n.l = 'callers' AND rn <= 3), '') AS callers,
  count(*) FILTER (n.l = 'callees') AS n_callees, coalesce(string_agg(n.o, ', ' ORDER BY rn) FILTER (n.l = 'callees' AND rn <= 3), '') AS callees,
  count(*) FILTER (n.l = 'tests') AS n_tests, coalesce(string_agg(n.o, ', ' ORDER BY rn) FILTER (n.l = 'tests' AND rn <= 3), '') AS tests
FROM hit h LEFT JOIN num n ON n.q = h.qualified_name GROUP BY ALL""",
    "refs": with_graph("edg") + f" SELECT edge_id, kind, source FROM edg WHERE target = '{TARGET}'",
    "callers": with_graph("edg") + f" SELECT edge_id, source FROM edg WHERE target = '{TARGET}' AND kind = 'calls'",
    "callees": with_graph("edg") + f" SELECT edge_id, target FROM edg WHERE source = (SELECT min(source) FROM edg WHERE target = '{TARGET}' AND kind = 'calls') AND kind = 'calls'",
    "get_file": with_graph("fil") + " SELECT * FROM fil WHERE path = 'libs/text/slug.py'",
    "get_symbol": with_graph("sym") + f" SELECT qualified_name, name, kind, file_path, line_start FROM sym WHERE qualified_name = '{TARGET}'",
    "symbols_for_files": with_graph("fil", "sym")
    + " SELECT qualified_name, file_path, kind FROM sym WHERE file_path IN (SELECT path FROM fil WHERE language = 'Go')",
    "file_languages": with_graph("fil")
    + """, e AS (SELECT *, regexp_extract(path, '[^/]\\.([^./]*)$', 1) AS extension FROM fil)
SELECT path, language, extension, CASE WHEN extension IN ('ts', 'tsx') THEN 'TypeScript' WHEN extension IN ('js', 'jsx', 'mjs', 'cjs') THEN 'JavaScript'
  WHEN extension = 'py' THEN 'Python' WHEN extension = 'go' THEN 'Go' ELSE 'Rust' END AS by_extension,
  regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS stem FROM e""",
    "name_parts": with_graph("sym")
    + """ SELECT qualified_name, split_part(qualified_name, '::', 1) AS file, substr(qualified_name, instr(qualified_name, '::') + 2) AS symbol,
  split_part(qualified_name, '::', -1) AS short,
  array_to_string(list_filter(string_split_regex(regexp_replace(qualified_name, '(\\p{Ll})(\\p{Lu})', '\\1/\\2', 'g'), '[:./_]'), lambda x: x <> ''), ' ').lower() AS segments
FROM sym""",
    "diff_changed_symbols": with_graph("sym") + f", {_HUNKS}, {_TOUCHED.format('hunks')} SELECT * FROM touched",
    "bfs_forward_d3": _walk_sql("forward", 3) + _FOUND,
    "bfs_backward_d2": _walk_sql("backward", 2, starts=_NAMED) + _FOUND,
    "bfs_high_conf": _walk_sql("backward", 2, 3) + _FOUND,
    "bfs_zero_depth": _walk_sql("forward", 0) + _FOUND,
    "blast_radius": _walk_sql("forward", 4) + f"SELECT start AS target, node, depth, {_RANK.format('edge_kind')} AS confidence_rank FROM found",
    "diff_impact": _walk_sql(
        "forward", 2, 1, "SELECT qualified_name AS start FROM touched",
        f", {_HUNKS}, {_TOUCHED.format('hunks')}", ("sym", "edg"),
    ) + "SELECT start AS target, node, depth FROM found",
    "dfs_reachable": with_graph("sym", "edg", recursive=True)
    + f""", f AS ({_EVERY}), r(node) AS (SELECT start FROM f UNION SELECT e.target FROM r JOIN edg e ON e.source = r.node AND {_RANK.format("e.kind")} >= 3)
SELECT node FROM r""",
}
