"""Entry points, dead code, flows, centrality and risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import HIGH_KINDS, USAGE_KINDS, RiskConfig
from ..operators.analysis import (
    CALLABLE_KINDS,
    CLI_MARKS,
    HTTP_MARKS,
    coupling,
    dead_code,
    dead_layers,
    dead_summary,
    entry_points,
    risk_files,
    risk_scores,
    risk_stats,
    sensitivity,
    test_gaps,
)
from ..operators.flows import betweenness, capped_flows, criticality, flow_counts, flow_paths, flow_stats, flows_through
from ..runtime import materialize
from .common import edges, sql_list, symbols, with_graph

_COLUMNS = ("name", "kind", "file_path", "line_start", "visibility", "is_exported", "is_test", "decorators")
TARGET = "libs/text/slug.py::slugify"


def _graph(spark, sf):
    own, _ = materialize(symbols(spark, sf, *_COLUMNS), "symbols")
    links, _ = materialize(edges(spark, sf), "edges")
    return own, links


def entries(spark, sf):
    return entry_points(*_graph(spark, sf)).select("qualified_name", "entry_kind", "confidence")


def entry_point_counts(spark, sf):
    return entry_points(*_graph(spark, sf)).groupBy("entry_kind").agg(F.count(F.lit(1)).alias("n"))


def dead_layer_counts(spark, sf):
    return dead_layers(*_graph(spark, sf)).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


def dead_symbols(spark, sf):
    return dead_code(dead_layers(*_graph(spark, sf)))


def dead_by_kind(spark, sf):
    return dead_code(dead_layers(*_graph(spark, sf))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def dead_by_file(spark, sf):
    return dead_code(dead_layers(*_graph(spark, sf))).groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))


def dead_totals(spark, sf):
    return dead_summary(dead_layers(*_graph(spark, sf)))


def coupling_scores(spark, sf):
    return coupling(*_graph(spark, sf)).select("qualified_name", "degree", F.round("coupling", 6).alias("coupling"))


def test_gap(spark, sf):
    return test_gaps(*_graph(spark, sf))


def sensitive_names(spark, sf):
    return sensitivity(symbols(spark, sf, "decorators"), (*RiskConfig.patterns, "ledger", "cache"))


def _rounded(scores):
    return scores.select("qualified_name", "file_path", F.round("coupling", 6).alias("coupling"), "test_gap", "sensitivity", F.round("composite", 6).alias("composite"))


def risk_symbols(spark, sf):
    return _rounded(risk_scores(*_graph(spark, sf)))


def risk_by_file(spark, sf):
    return risk_files(_rounded(risk_scores(*_graph(spark, sf))))


def risk_summary(spark, sf):
    return risk_stats(_rounded(risk_scores(*_graph(spark, sf))))


def _entry_flows(spark, sf):
    own, links = _graph(spark, sf)
    return flow_paths(entry_points(own, links), links, 4)


def flow_paths_d4(spark, sf):
    return _entry_flows(spark, sf).select("entry", F.concat_ws(" > ", "path").alias("path"), "depth")


def flow_totals_d4(spark, sf):
    return flow_stats(_entry_flows(spark, sf))


def flow_node_counts_d4(spark, sf):
    return flow_counts(_entry_flows(spark, sf))


def flows_through_target_d4(spark, sf):
    own, links = _graph(spark, sf)
    found = flows_through(TARGET, entry_points(own, links), links, 4)
    return found.select("entry", F.concat_ws(" > ", "path").alias("path"), "depth")


def flows_capped(spark, sf):
    own, links = _graph(spark, sf)
    return capped_flows(entry_points(own, links), links).select("entry", F.concat_ws(" > ", "path").alias("path"), "depth")


def betweenness_all(spark, sf):
    return betweenness(*_graph(spark, sf))


def criticality_rank(spark, sf):
    own, links = _graph(spark, sf)
    starts = entry_points(own, links)
    return criticality(own, links, capped_flows(starts, links), starts)


def risk_full(spark, sf):
    own, links = _graph(spark, sf)
    between = betweenness(own, links)
    top = between.agg(F.max("betweenness").alias("top")).withColumn("one", F.lit(1))
    scaled = between.withColumn("one", F.lit(1)).join(F.broadcast(top), "one")
    scaled = scaled.select("qualified_name", F.coalesce(F.try_divide("betweenness", "top"), F.lit(0.0)).alias("criticality"))
    return risk_scores(own, links, scaled).select("qualified_name", "file_path", F.round("composite", 6).alias("composite"))


QUERIES = {
    "entry_points": entries,
    **{
        f.__name__: f
        for f in (
            entry_point_counts, dead_layer_counts, dead_symbols, dead_by_kind, dead_by_file, dead_totals, coupling_scores, test_gap,
            sensitive_names, risk_symbols, risk_by_file, risk_summary, flow_paths_d4, flow_totals_d4, flow_node_counts_d4,
            flows_through_target_d4, flows_capped, betweenness_all, criticality_rank, risk_full,
        )
    },
}


def _any(marks, fold=True):
    text = "lower(d)" if fold else "d"
    return "len(list_filter(coalesce(decorators, []), lambda d: " + " OR ".join(f"contains({text}, '{m}')" for m in marks) + ")) > 0"


_ENTRIES = f"""cal AS (SELECT DISTINCT target AS q FROM edg WHERE kind = 'calls'),
outs AS (SELECT source AS q, count(*) AS n_out FROM edg WHERE kind IN ({sql_list(HIGH_KINDS)}) GROUP BY 1),
ek AS (SELECT s.*, coalesce(o.n_out, 0) AS n_out, CASE
  WHEN lower(name) = 'main' OR {_any(["tokio::main"], False)} THEN 'main'
  WHEN coalesce(is_test, false) OR kind = 'test' OR starts_with(lower(name), 'test_') THEN 'test'
  WHEN {_any(HTTP_MARKS)} THEN 'http_handler' WHEN {_any(CLI_MARKS)} THEN 'cli_command'
  WHEN coalesce(is_exported, false) AND coalesce(visibility = 'public', false) AND kind IN ({sql_list(CALLABLE_KINDS)}) AND c.q IS NULL THEN 'public_root' END AS entry_kind
  FROM sym s LEFT JOIN cal c ON c.q = s.qualified_name LEFT JOIN outs o ON o.q = s.qualified_name),
ent AS (SELECT qualified_name, entry_kind, CASE WHEN entry_kind = 'public_root' THEN 0.7::DOUBLE
  WHEN entry_kind = 'test' AND NOT (coalesce(is_test, false) OR kind = 'test') THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS confidence
  FROM ek WHERE entry_kind IS NOT NULL AND (entry_kind <> 'public_root' OR qualified_name IN
    (SELECT qualified_name FROM ek WHERE entry_kind = 'public_root' ORDER BY n_out DESC, qualified_name LIMIT 50)))"""
_LAYERS = f"""lay AS (SELECT s.*, CASE WHEN u.q IS NOT NULL THEN 'alive' WHEN e.qualified_name IS NOT NULL THEN 'entry_point'
  WHEN coalesce(is_exported, false) THEN 'exported' WHEN coalesce(is_test, false) THEN 'test'
  WHEN coalesce(regexp_matches(file_path, '^(.*/)?(migrations|migrate|alembic|diesel/migrations)/.*$'), false) THEN 'migration' ELSE 'dead' END AS layer
  FROM sym s LEFT JOIN (SELECT DISTINCT target AS q FROM edg WHERE kind IN ({sql_list(USAGE_KINDS)})) u ON u.q = s.qualified_name
  LEFT JOIN ent e ON e.qualified_name = s.qualified_name AND e.entry_kind <> 'test')"""
_BASE = with_graph("sym", "edg")
_DEAD = f"{_BASE}, {_ENTRIES}, {_LAYERS} "
_STRUCTURAL = "('contains', 'child_of', 'has_decorator', 'tested_by')"
_RISK = f"""{_BASE}, inn AS (SELECT * FROM edg WHERE kind NOT IN {_STRUCTURAL} AND source IN (SELECT qualified_name FROM sym)
  AND target IN (SELECT qualified_name FROM sym)),
deg AS (SELECT q, count(*) AS degree FROM (SELECT source AS q FROM inn UNION ALL SELECT target FROM inn) GROUP BY q),
cou AS (SELECT s.qualified_name, coalesce(d.degree, 0) AS degree, coalesce(d.degree, 0) / (SELECT max(degree) FROM deg) AS coupling
  FROM sym s LEFT JOIN deg d ON d.q = s.qualified_name),
gap AS (SELECT qualified_name, CASE WHEN qualified_name IN (SELECT target FROM edg WHERE kind = 'tested_by') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS test_gap FROM sym),
seg AS (SELECT qualified_name, string_split_regex(regexp_replace(qualified_name || '/' || array_to_string(coalesce(decorators, []), '/'), '(\\p{{Ll}})(\\p{{Lu}})', '\\1/\\2', 'g'), '[:./_]') AS parts FROM sym),
sen AS (SELECT qualified_name, CASE WHEN len(list_filter(parts, lambda p: regexp_matches(lower(p), '^({{0}})'))) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sensitivity FROM seg),
ris AS (SELECT s.qualified_name, s.file_path, round(coupling, 6) AS coupling, test_gap, sensitivity,
  round(least(greatest(0.25 * coupling + 0.25 * test_gap + 0.2 * sensitivity, 0), 1), 6) AS composite
  FROM sym s JOIN cou USING (qualified_name) JOIN gap USING (qualified_name) JOIN sen USING (qualified_name))"""
_SCORES = _RISK.replace("{0}", "|".join(RiskConfig.patterns))
_FLOWS = f"""{with_graph("sym", "edg", recursive=True)}, {_ENTRIES},
hi AS (SELECT source AS a, target AS b FROM edg WHERE kind IN ({sql_list(HIGH_KINDS)})),
grow(entry, path) AS (SELECT qualified_name, [qualified_name] FROM ent
  UNION ALL SELECT g.entry, list_append(g.path, h.b) FROM grow g JOIN hi h ON h.a = g.path[-1] AND NOT list_contains(g.path, h.b) WHERE len(g.path) < 4),
flo AS (SELECT entry, path, len(path) AS depth FROM grow g WHERE len(path) = 4 OR NOT EXISTS (SELECT 1 FROM hi h WHERE h.a = g.path[-1] AND NOT list_contains(g.path, h.b)))"""
ORACLE = {
    "entry_points": f"{_BASE}, {_ENTRIES} SELECT * FROM ent",
    "entry_point_counts": f"{_BASE}, {_ENTRIES} SELECT entry_kind, count(*) AS n FROM ent GROUP BY 1",
    "dead_layer_counts": _DEAD + "SELECT layer, count(*) AS n FROM lay GROUP BY 1",
    "dead_symbols": _DEAD + "SELECT qualified_name, kind, file_path, line_start, visibility FROM lay WHERE layer = 'dead'",
    "dead_by_kind": _DEAD + "SELECT kind, count(*) AS n FROM lay WHERE layer = 'dead' GROUP BY 1",
    "dead_by_file": _DEAD + "SELECT file_path, count(*) AS n FROM lay WHERE layer = 'dead' GROUP BY 1",
    "dead_totals": _DEAD
    + """SELECT count(*) AS total_symbols, count(*) FILTER (layer = 'dead') AS dead_count, count(*) FILTER (layer NOT IN ('dead', 'alive')) AS excluded_count,
  round(count(*) FILTER (layer = 'dead') / count(*) * 100, 6) AS dead_percentage FROM lay""",
    "coupling_scores": _SCORES + " SELECT qualified_name, degree, round(coupling, 6) AS coupling FROM cou",
    "test_gap": _SCORES + " SELECT * FROM gap",
    "sensitive_names": _RISK.replace("{0}", "|".join((*RiskConfig.patterns, "ledger", "cache"))) + " SELECT * FROM sen",
    "risk_symbols": _SCORES + " SELECT * FROM ris",
    "risk_by_file": _SCORES
    + """ SELECT file_path, max(composite) AS max_risk, count(*) AS n_symbols,
  CASE WHEN max(composite) > 0 THEN first(qualified_name ORDER BY composite DESC, qualified_name) ELSE '' END AS driver FROM ris GROUP BY file_path""",
    "risk_summary": _SCORES
    + """, o AS (SELECT composite, row_number() OVER (ORDER BY composite) - 1 AS i, count(*) OVER () AS n FROM ris)
SELECT max(n) AS symbols_scored, (SELECT count(DISTINCT file_path) FROM ris) AS files_scored, round(avg(composite), 6) AS avg_risk,
  round(median(composite), 6) AS median_risk, round(max(composite) FILTER (i = least(CAST(ceil(n * 0.9) AS BIGINT), n - 1)), 6) AS p90_risk FROM o""",
    "flow_paths_d4": _FLOWS + " SELECT entry, array_to_string(path, ' > ') AS path, depth FROM flo",
    "flow_totals_d4": _FLOWS
    + " SELECT count(*) AS n_flows, count(DISTINCT entry) AS n_entries, max(depth) AS max_depth, round(avg(depth), 6) AS avg_depth FROM flo",
    "flow_node_counts_d4": _FLOWS + " SELECT node, count(*) AS n_flows FROM (SELECT unnest(path) AS node FROM flo) GROUP BY 1",
    "flows_through_target_d4": _FLOWS + f" SELECT entry, array_to_string(path, ' > ') AS path, depth FROM flo WHERE list_contains(path, '{TARGET}')",
}
