"""Queries of the general problems 1, 2, 4 and 5, over the whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import plain_key, snake_kind
from ..operators.hierarchy import descendants, hierarchy, parent_links
from ..operators.incremental import KeyedState, digest, epoch_seconds, replay_runs
from ..operators.orphans import orphan_rows
from ..operators.skew import balanced_join, balanced_stats, plan_load
from ..runtime import new_path
from ..sources.tables import read_table


def _short_digest(spelled):
    """The first 128 bits of a hexadecimal digest; of any other text those of its own."""
    return F.unhex(F.when(spelled.rlike("^[0-9a-f]{64}$"), F.substring(spelled, 1, 32)).otherwise(F.md5(spelled)))


def file_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """The files feed as deliveries of ``replay_runs``."""
    files = read_table(spark, sf, "files").where(F.col("hash").isNotNull() & F.col("updated_at").isNotNull())
    return files.select(
        F.lit("files").alias("table_name"),
        F.col("path").alias("record_key"),
        epoch_seconds(F.col("updated_at")).alias("stamp"),
        _short_digest(digest(F.col("hash"))).alias("content_hash"),
        "load_id",
    )


def run_log(spark: SparkSession, sf: str) -> list[tuple[int, bool]]:
    """Index runs and whether they succeeded."""
    return [(r["run_id"], r["status"] == "succeeded") for r in read_table(spark, sf, "index_runs").collect()]


def changed_by_run(spark: SparkSession, sf: str) -> DataFrame:
    files = file_deliveries(spark, sf)
    symbols = read_table(spark, sf, "symbols").where(F.col("updated_at").isNotNull())
    stamp = epoch_seconds(F.col("updated_at"))
    symbols = symbols.select(
        F.lit("symbols").alias("table_name"),
        F.col("qualified_name").alias("record_key"),
        stamp.alias("stamp"),
        F.unhex(F.md5(stamp.cast("string"))).alias("content_hash"),
        "load_id",
    )
    state = KeyedState(spark, new_path(spark, "index-state"))
    found = replay_runs(state, run_log(spark, sf), files.unionByName(symbols), new_path(spark, "deliveries"))
    result = spark.createDataFrame([], "table_name string, run_id bigint, record_key string")
    for run, rows in found[1:]:
        result = result.unionByName(rows.select("table_name", F.lit(run).cast("long").alias("run_id"), "record_key"))
    return result


def _links(spark: SparkSession, sf: str) -> DataFrame:
    edges = read_table(spark, sf, "edges")
    return parent_links(edges.withColumn("kind", snake_kind(F.col("kind"))), ["child_of"], ["contains"])


def forest(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy(_links(spark, sf)).select("node", "root_node", "depth")


def forest_paths(spark: SparkSession, sf: str) -> DataFrame:
    rows = hierarchy(_links(spark, sf), with_paths=True)
    return rows.select("node", "root_node", "depth", F.concat_ws(" > ", "path").alias("path"))


def forest_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return descendants(hierarchy(_links(spark, sf), with_paths=True))


def _split(key: str) -> list:
    """Path and symbol of a reference in plain spelling; without ``::`` the symbol is null."""
    plain = plain_key(F.col(key))
    file = F.substring_index(plain, "::", 1)
    symbol = F.when(F.contains(plain, F.lit("::")), F.substr(plain, F.length(file) + 3))
    return [file.alias("ref_file"), symbol.alias("ref_symbol")]


def orphans(spark: SparkSession, sf: str) -> DataFrame:
    """References without a record; keys are (file, symbol), a path having no symbol, matched exactly."""
    removed = read_table(spark, sf, "removals").groupBy(F.col("path").alias("removed_path"))
    removed = removed.agg(F.max("load_id").alias("removed_in"))

    def alive(table: str, key: str) -> DataFrame:
        newest = read_table(spark, sf, table).where(F.col(key).isNotNull()).groupBy(key)
        newest = newest.agg(F.max(F.coalesce("load_id", F.lit(-1))).alias("load_id"))
        home = newest.withColumn("home", F.substring_index(key, "::", 1))
        kept = home.join(removed, F.col("home") == F.col("removed_path"), "left")
        kept = kept.where(F.col("removed_in").isNull() | (F.col("load_id") > F.col("removed_in")))
        return kept.select(*_split(key))

    paths, names = alive("files", "path"), alive("symbols", "qualified_name")
    edges = read_table(spark, sf, "edges")
    ends = edges.select(
        F.lit("edges").alias("table_name"),
        F.inline(
            F.array(
                F.struct(F.lit("target").alias("field_name"), F.col("target").alias("key")),
                F.struct(F.lit("source").alias("field_name"), F.col("source").alias("key")),
            )
        ),
        F.col("edge_id").alias("row_id"),
        "load_id",
    )
    places = read_table(spark, sf, "symbols").select(
        F.lit("symbols").alias("table_name"),
        F.lit("file_path").alias("field_name"),
        F.col("file_path").alias("key"),
        F.col("symbol_id").alias("row_id"),
        "load_id",
    )
    keep, key = ["table_name", "field_name", "row_id", "load_id"], ["ref_file", "ref_symbol"]

    def missing(references: DataFrame, parents: DataFrame) -> DataFrame:
        keyed = references.where(F.col("key").isNotNull()).select(*keep, *_split("key"))
        return orphan_rows(keyed, parents.where(F.col("ref_file") != ""), key, keep, match="exact")

    found = missing(ends, paths.unionByName(names)).unionByName(missing(places, paths))
    runs = read_table(spark, sf, "index_runs").select(
        F.col("run_id").alias("load_id"), F.date_format("started_at", "yyyy-MM").alias("period")
    )
    return found.join(F.broadcast(runs), "load_id", "left").select("table_name", "field_name", "row_id", "period")


def orphan_report(spark: SparkSession, sf: str) -> DataFrame:
    by = ["table_name", "field_name", "period"]
    return orphans(spark, sf).groupBy(*by).agg(F.count(F.lit(1)).alias("n_orphans"))


def edge_target_stats(spark: SparkSession, sf: str) -> DataFrame:
    return balanced_stats(read_table(spark, sf, "edges"), "target", "load_id", "edge_id", "source")


def symbol_name_stats(spark: SparkSession, sf: str) -> DataFrame:
    symbols = read_table(spark, sf, "symbols").withColumn("updated_at", epoch_seconds(F.col("updated_at")))
    return balanced_stats(symbols, "qualified_name", "updated_at", "symbol_id", "file_path")


def edge_target_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Every edge with what is known of its target: number of symbol rows of that name and the newest of them."""
    edges = read_table(spark, sf, "edges").select("edge_id", "target")
    known = symbol_name_stats(spark, sf).select(
        F.col("record_key").alias("target"), F.col("n_rows").alias("n_symbol_rows"), F.col("newest_id").alias("newest_symbol_id")
    )
    return balanced_join(edges, known, "target").select("edge_id", "target", "n_symbol_rows", "newest_symbol_id")


def heavy_keys(spark: SparkSession, sf: str, share: float = 0.02) -> DataFrame:
    parts = []
    for table, key, stamp, row_id, distinct in (
        ("edges", "target", "load_id", "edge_id", "source"),
        ("symbols", "qualified_name", "updated_at", "symbol_id", "file_path"),
    ):
        rows = read_table(spark, sf, table)
        plan = plan_load(rows, key)
        stats = balanced_stats(rows, key, stamp, row_id, distinct, plan)
        heavy = stats.where(F.col("n_rows") >= F.lit(share * plan.total))
        parts.append(heavy.select(F.lit(table).alias("table_name"), "record_key"))
    return parts[0].unionByName(parts[1])


QUERIES = {
    "p1_found": changed_by_run,
    "p2_found": forest,
    "p2_paths": forest_paths,
    "p2_descendants": forest_descendants,
    "p4_found": orphans,
    "p4_report": orphan_report,
    "p5_found": heavy_keys,
    "p5_edge_targets": edge_target_stats,
    "p5_symbol_names": symbol_name_stats,
    "p5_edge_symbols": edge_target_symbols,
}

_SECONDS = "CASE WHEN abs(updated_at) >= 100000000000 THEN updated_at // 1000 ELSE updated_at END"
_NORM = "regexp_replace(replace(trim({0}), '\\', '/'), '^\\./', '')"
_FOREST = """
WITH RECURSIVE kinds AS (
  SELECT CASE WHEN kind IN ('child_of', 'ChildOf') THEN source ELSE target END AS node,
         CASE WHEN kind IN ('child_of', 'ChildOf') THEN target ELSE source END AS up,
         kind IN ('child_of', 'ChildOf') AS own
  FROM edges WHERE kind IN ('child_of', 'ChildOf', 'contains', 'Contains') AND source IS NOT NULL AND target IS NOT NULL),
par AS (SELECT node, coalesce(min(up) FILTER (own), min(up) FILTER (NOT own)) AS parent FROM kinds GROUP BY node),
reach(node, anc) AS (
  SELECT node, parent FROM par
  UNION
  SELECT r.node, p.parent FROM reach r JOIN par p ON p.node = r.anc),
looped AS (SELECT node FROM reach WHERE node = anc),
f AS (
  SELECT r.node,
         coalesce(min(r.anc) FILTER (l.node IS NOT NULL), min(r.anc) FILTER (p.node IS NULL)) AS root_node,
         CASE WHEN count(l.node) > 0 THEN -1 ELSE count(*) END AS depth
  FROM reach r LEFT JOIN looped l ON l.node = r.anc LEFT JOIN par p ON p.node = r.anc GROUP BY r.node)
"""
_ORPHANS = f"""
WITH gone AS (SELECT path, max(load_id) AS removed_in FROM removals GROUP BY path),
paths AS (
  SELECT f.path AS k FROM (SELECT path, max(coalesce(load_id, -1)) AS load_id FROM files GROUP BY path) f
  LEFT JOIN gone g ON g.path = f.path WHERE g.path IS NULL OR f.load_id > g.removed_in),
names AS (
  SELECT s.k FROM (SELECT qualified_name AS k, max(coalesce(load_id, -1)) AS load_id FROM symbols GROUP BY 1) s
  LEFT JOIN gone g ON g.path = split_part(s.k, '::', 1) WHERE g.path IS NULL OR s.load_id > g.removed_in),
refs AS (
  SELECT 'edges' AS table_name, 'target' AS field_name, edge_id AS row_id, load_id, {_NORM.format("target")} AS k FROM edges
  UNION ALL SELECT 'edges', 'source', edge_id, load_id, {_NORM.format("source")} FROM edges
  UNION ALL SELECT 'symbols', 'file_path', symbol_id, load_id, {_NORM.format("file_path")} FROM symbols),
o AS (
  SELECT r.table_name, r.field_name, r.row_id, strftime(i.started_at, '%Y-%m') AS period
  FROM refs r LEFT JOIN index_runs i ON i.run_id = r.load_id
  WHERE r.k IS NOT NULL AND (r.k = '' OR (r.k NOT IN (SELECT k FROM paths WHERE k IS NOT NULL)
    AND (r.table_name = 'symbols' OR r.k NOT IN (SELECT k FROM names WHERE k IS NOT NULL)))))
"""


def _stats_sql(table: str, key: str, stamp: str, row_id: str, distinct: str) -> str:
    return f"""
WITH r AS (SELECT {key} AS record_key, {stamp} AS s, {row_id} AS i, {distinct} AS v FROM {table} WHERE {key} IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY record_key ORDER BY s DESC NULLS LAST, i DESC NULLS LAST) AS n FROM r)
SELECT record_key, count(*) AS n_rows, max(s) FILTER (n = 1) AS newest_stamp, max(i) FILTER (n = 1) AS newest_id,
       count(DISTINCT v) AS n_distinct FROM t GROUP BY record_key"""


ORACLE = {
    "p1_found": f"""
WITH feed AS (
  SELECT 'files' AS table_name, path AS record_key, {_SECONDS} AS s, regexp_extract(lower(hash), '([0-9a-f]{{64}})', 1) AS h, load_id
  FROM files WHERE hash IS NOT NULL AND updated_at IS NOT NULL AND path IS NOT NULL
  UNION ALL SELECT 'symbols', qualified_name, {_SECONDS}, CAST({_SECONDS} AS VARCHAR), load_id
  FROM symbols WHERE updated_at IS NOT NULL AND qualified_name IS NOT NULL),
good AS (SELECT run_id, lag(run_id) OVER (ORDER BY run_id) AS before FROM index_runs WHERE status = 'succeeded'),
state AS (
  SELECT g.run_id, f.table_name, f.record_key, arg_max(f.h, (f.s, f.h)) AS h
  FROM good g JOIN feed f ON f.load_id <= g.run_id GROUP BY ALL)
SELECT n.table_name, n.run_id, n.record_key FROM state n JOIN good g ON g.run_id = n.run_id
LEFT JOIN state o ON o.run_id = g.before AND o.table_name = n.table_name AND o.record_key = n.record_key
WHERE g.before IS NOT NULL AND (o.h IS NULL OR o.h <> n.h)""",
    "p2_found": _FOREST + "SELECT node, root_node, depth FROM f",
    "p2_paths": _FOREST
    + """SELECT a.node, f.root_node, f.depth, CASE WHEN f.depth < 0 THEN '' ELSE string_agg(a.anc, ' > ' ORDER BY coalesce(u.depth, 0)) || ' > ' || a.node END AS path
FROM reach a JOIN f ON f.node = a.node LEFT JOIN f u ON u.node = a.anc GROUP BY a.node, f.root_node, f.depth""",
    "p2_descendants": _FOREST
    + """SELECT a.anc AS ancestor, a.node AS descendant, d.depth - coalesce(u.depth, 0) AS distance
FROM reach a JOIN f d ON d.node = a.node AND d.depth >= 0 LEFT JOIN f u ON u.node = a.anc""",
    "p4_found": _ORPHANS + "SELECT * FROM o",
    "p4_report": _ORPHANS + "SELECT table_name, field_name, period, count(*) AS n_orphans FROM o GROUP BY ALL",
    "p5_found": """
SELECT 'edges' AS table_name, target AS record_key FROM edges WHERE target IS NOT NULL GROUP BY target
HAVING count(*) >= 0.02 * (SELECT count(*) FROM edges)
UNION ALL SELECT 'symbols', qualified_name FROM symbols WHERE qualified_name IS NOT NULL GROUP BY qualified_name
HAVING count(*) >= 0.02 * (SELECT count(*) FROM symbols)""",
    "p5_edge_targets": _stats_sql("edges", "target", "load_id", "edge_id", "source"),
    "p5_symbol_names": _stats_sql("symbols", "qualified_name", _SECONDS, "symbol_id", "file_path"),
    "p5_edge_symbols": f"""
WITH s AS (SELECT qualified_name AS k, count(*) AS n_symbol_rows,
  arg_max(symbol_id, (coalesce({_SECONDS}, -1), symbol_id)) AS newest_symbol_id FROM symbols WHERE qualified_name IS NOT NULL GROUP BY 1)
SELECT e.edge_id, e.target, s.n_symbol_rows, s.newest_symbol_id FROM edges e LEFT JOIN s ON s.k = e.target""",
}
