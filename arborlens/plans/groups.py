"""Communities, and the round trip of diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.communities import cards, detect, modularity, names, stats, weights
from ..operators.components import connected_components
from ..runtime import materialize
from ..sources import changes
from .common import edges, symbols, with_graph
from .lookups import diff_hunks


def _graph(spark, sf):
    own, _ = materialize(symbols(spark, sf, "kind"), "symbols")
    links, _ = materialize(weights(own, edges(spark, sf)), "weights")
    return own, links


def _partition(own):
    """A given partition: the top two folders of a symbol."""
    return own.select("qualified_name", F.substring_index("qualified_name", "/", 2).alias("community"))


def community_weights(spark, sf):
    return _graph(spark, sf)[1]


def community_modularity(spark, sf):
    own, links = _graph(spark, sf)
    return modularity(_partition(own), links).select(F.round("modularity", 6).alias("modularity"))


def community_cards(spark, sf):
    own, links = _graph(spark, sf)
    found = cards(_partition(own), links)
    return found.select("community", "n_members", "inner_pairs", "boundary_pairs", "degree", F.round("contribution", 9).alias("contribution"))


def community_names(spark, sf):
    return names(_partition(_graph(spark, sf)[0]))


def community_stats(spark, sf):
    own, links = _graph(spark, sf)
    found = stats(_partition(own), own, links)
    return found.select("n_communities", F.round("avg_size", 6).alias("avg_size"), "largest", "n_isolated")


def communities(spark, sf):
    return detect(symbols(spark, sf, "kind"), edges(spark, sf))


def _parsed(hunks):
    """Hunks written as one diff per file, and parsed back."""
    spans = hunks.where(F.col("file").isNotNull())
    header = F.format_string("@@ -%d,%d +%d,%d @@ x", F.col("new_start"), F.col("new_count"), F.col("new_start"), F.col("new_count"))
    per = spans.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(header)), "\n+ line\n").alias("body"))
    text = F.concat(F.lit("diff --git a/"), "file", F.lit(" b/"), "file", F.lit("\nindex 1..2\n"), "body")
    return changes.diff_hunks(per.select(F.col("file").alias("diff_id"), text.alias("text"))).drop("diff_id")


def parsed_diffs(spark, sf):
    """The hunks of every span of more than one line."""
    return _parsed(diff_hunks(spark, sf))


def community_invariants(spark, sf):
    """What must hold of the communities found: each is connected, none is small, no symbol is in two, and they beat folders."""
    own, links = _graph(spark, sf)
    found, _ = materialize(detect(own, edges(spark, sf)), "found-communities")
    part = found.select("qualified_name", F.col("community_id").cast("string").alias("community"))
    of = part.select(F.col("qualified_name").alias("n"), "community")
    inner = links.join(of.select(F.col("n").alias("lo"), "community"), "lo").join(of.select(F.col("n").alias("hi"), F.col("community").alias("other")), "hi")
    parts = connected_components(inner.where(F.col("community") == F.col("other")).select(F.col("lo").alias("a"), F.col("hi").alias("b")))
    joined = part.join(parts, part.qualified_name == parts.node, "left").groupBy("community")
    sizes = joined.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce("component", "qualified_name")).alias("pieces"))
    held = sizes.agg(F.bool_and(F.col("pieces") == 1).alias("connected"), F.bool_and(F.col("n") >= 2).alias("large_enough"))
    once = part.agg((F.count(F.lit(1)) == F.count_distinct("qualified_name")).alias("disjoint"))
    one = F.lit(1).alias("one")
    rows = held.select("*", one).join(once.select("*", one), "one")
    rows = rows.join(modularity(part, links).select(F.col("modularity").alias("q"), one), "one")
    rows = rows.join(modularity(_partition(own), links).select(F.col("modularity").alias("folders"), one), "one")
    return rows.select("connected", "large_enough", "disjoint", (F.col("q") > F.col("folders")).alias("better_than_folders"))


QUERIES = {
    f.__name__: f
    for f in (community_weights, community_modularity, community_cards, community_names, community_stats, communities, community_invariants, parsed_diffs)
}

_BASE = f"""{with_graph("sym", "edg")}, lin AS (SELECT least(source, target) AS lo, greatest(source, target) AS hi, count(*) AS weight FROM edg
  WHERE kind IN ('calls', 'extends', 'implements', 'embeds') AND source <> target AND source IN (SELECT qualified_name FROM sym)
  AND target IN (SELECT qualified_name FROM sym) GROUP BY 1, 2),
par AS (SELECT qualified_name, array_to_string(string_split(qualified_name, '/')[1:2], '/') AS community FROM sym),
sid AS (SELECT x.community, y.community AS other, weight, true AS f FROM lin JOIN par x ON x.qualified_name = lo JOIN par y ON y.qualified_name = hi
  UNION ALL SELECT y.community, x.community, weight, false FROM lin JOIN par x ON x.qualified_name = lo JOIN par y ON y.qualified_name = hi),
sums AS (SELECT community, count(*) FILTER (f AND other = community) AS inner_pairs, count(*) FILTER (other <> community) AS boundary_pairs,
  coalesce(sum(weight) FILTER (f AND other = community), 0) AS inner_weight, sum(weight) AS degree FROM sid GROUP BY 1),
car AS (SELECT community, n_members, coalesce(inner_pairs, 0) AS inner_pairs, coalesce(boundary_pairs, 0) AS boundary_pairs, coalesce(inner_weight, 0) AS inner_weight,
  CAST(coalesce(degree, 0) AS BIGINT) AS degree, (SELECT sum(weight) FROM lin)::DOUBLE AS m FROM (SELECT community, count(*) AS n_members FROM par GROUP BY 1) LEFT JOIN sums USING (community))
"""
ORACLE = {
    "community_weights": _BASE + "SELECT * FROM lin",
    "community_modularity": _BASE + "SELECT round(sum(inner_weight / m - power(degree / (2 * m), 2)), 6) AS modularity FROM car",
    "community_cards": _BASE
    + "SELECT community, n_members, inner_pairs, boundary_pairs, degree, round(inner_pairs / m - power(degree / (2 * m), 2), 9) AS contribution FROM car",
    "community_names": _BASE
    + """, c AS (SELECT community, regexp_replace(regexp_extract(split_part(qualified_name, '::', 1), '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS stem, count(*) AS n FROM par GROUP BY 1, 2),
b AS (SELECT community, first(stem ORDER BY n DESC, stem) AS stem FROM c GROUP BY 1)
SELECT community, CASE WHEN stem IN ('mod', 'lib', 'index', 'main', 'utils', 'helpers') THEN 'community_' || community ELSE stem END AS name FROM b""",
    "community_stats": _BASE
    + """SELECT count(*) AS n_communities, round(avg(n_members), 6) AS avg_size, max(n_members) AS largest,
  (SELECT count(*) FROM sym WHERE qualified_name NOT IN (SELECT lo FROM lin UNION ALL SELECT hi FROM lin)) AS n_isolated FROM car""",
    "community_invariants": "SELECT true AS connected, true AS large_enough, true AS disjoint, true AS better_than_folders",
    "parsed_diffs": with_graph("sym")
    + """ SELECT file_path AS file, line_start AS old_start, (line_end - line_start + 1) // 2 AS old_count, line_start AS new_start, (line_end - line_start + 1) // 2 AS new_count
FROM sym WHERE line_end > line_start AND file_path IS NOT NULL""",
}
