"""Execution flows from entry points, betweenness and criticality.

Flows are simple paths over high-confidence edges. Paths are extended level by
level; each path leads to at least one flow, so with a cap on flows only that
many first paths (in depth-first order) are kept on each level. This gives just
the flows a depth-first search with the cap gives, and bounds every level.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..model import HIGH_KINDS, FlowConfig
from ..runtime import materialize, new_path
from .traversal import reachable
from .workgraph import dependency_sums, work_graph

def high_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("kind").isin(HIGH_KINDS))


def flow_paths(entries: DataFrame, edges: DataFrame, max_depth: int = 20) -> DataFrame:
    """All flows without a cap: ``entry, path, depth``; for shallow depths (their number grows exponentially).

    A flow ends at a node without unvisited neighbours, or at ``max_depth`` nodes.
    ``entries``: qualified_name; parallel edges give parallel flows.
    """
    return _flows(entries.select("qualified_name", F.lit(0).alias("position")), edges, max_depth, None).drop("way", "position")


def capped_flows(entries: DataFrame, edges: DataFrame, config: FlowConfig = FlowConfig()) -> DataFrame:
    """The first ``max_flows`` flows: entries in their order (public roots last), each depth-first, later edges first."""
    kinds = F.when(F.col("entry_kind") == "public_root", 1).otherwise(0)
    order = F.struct(kinds, F.when(kinds == 1, -F.col("n_out")).otherwise(0), F.col("qualified_name"))
    first = entries.orderBy(order).limit(config.max_flows)
    numbered = first.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)))
    found = _flows(numbered.select("qualified_name", "position"), edges, config.max_depth, config.max_flows)
    return found.orderBy("position", "way").limit(config.max_flows).drop("way", "position")


def _flows(entries: DataFrame, edges: DataFrame, max_depth: int, cap: int | None) -> DataFrame:
    steps = high_edges(edges).select(F.col("source").alias("a"), F.col("target").alias("b"), "edge_id")
    if cap is None:
        steps, _ = materialize(steps, "flow-steps")
    paths = entries.select(
        F.col("qualified_name").alias("entry"), "position", F.array("qualified_name").alias("path"), F.array().cast("array<bigint>").alias("way")
    )
    done: list[DataFrame] = []
    for _ in range(max_depth - 1):
        level, _ = materialize(paths.withColumn("at", F.element_at("path", -1)), "flow-level")
        if level.isEmpty():
            break
        near = level.join(steps, (F.col("at") == F.col("a")) & ~F.array_contains("path", F.col("b")))
        grown = near.select("entry", "position", F.array_append("path", F.col("b")).alias("path"), F.array_append("way", -F.col("edge_id")).alias("way"))
        grown, _ = materialize(grown, "flow-grown")
        went = grown.select(F.col("position").alias("p"), F.col("entry").alias("e"), F.slice("way", 1, F.size("way") - 1).alias("w")).distinct()
        still = (F.col("position") == F.col("p")) & (F.col("entry") == F.col("e")) & (F.col("way") == F.col("w"))
        done.append(level.drop("at").join(went, still, "left_anti"))
        if cap is None:
            paths = grown
        else:
            ended = reduce(DataFrame.unionByName, done).select("position", "way", F.lit(None).cast("string").alias("entry"), F.lit(None).cast("array<string>").alias("path"))
            first = ended.unionByName(grown).orderBy("position", "way").limit(cap)
            paths = first.where(F.col("path").isNotNull())
    done.append(paths)
    flows = reduce(DataFrame.unionByName, done)
    return flows.select("entry", "path", F.size("path").cast("long").alias("depth"), "position", "way")


def flow_counts(flows: DataFrame) -> DataFrame:
    """``node, n_flows``: flows through each node, once per flow."""
    return flows.select(F.explode("path").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_flows"))


def flow_stats(flows: DataFrame) -> DataFrame:
    return flows.agg(
        F.count(F.lit(1)).alias("n_flows"),
        F.count_distinct("entry").alias("n_entries"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
        F.coalesce(F.round(F.avg("depth"), 6), F.lit(0.0)).alias("avg_depth"),
    )


def flows_through(name: str, entries: DataFrame, edges: DataFrame, max_depth: int = 20) -> DataFrame:
    """Flows that pass ``name``; only entries from which it can be reached are followed."""
    target = edges.sparkSession.createDataFrame([(name,)], "start string")
    near = reachable(high_edges(edges), target, "backward").withColumnRenamed("node", "qualified_name")
    return flow_paths(entries.join(near, "qualified_name", "left_semi"), edges, max_depth).where(F.array_contains("path", F.lit(name)))


def flows_truncated(entries: DataFrame, edges: DataFrame, config: FlowConfig = FlowConfig()) -> bool:
    """Whether there are more flows than ``capped_flows`` gives."""
    return capped_flows(entries, edges, replace(config, max_flows=config.max_flows + 1)).count() > config.max_flows


def betweenness(symbols: DataFrame, edges: DataFrame, method: str = "source") -> DataFrame:
    """``qualified_name, betweenness`` of every symbol: directed, unweighted, over high-confidence edges between symbols.

    Parallel edges count as separate paths; the sum is divided by (n-1)(n-2) for
    n symbols (three or more). By ``source``, workers read the edges as numbers
    from the shared folder and take whole sources each, several at once; by ``level``, all sources advance together in DataFrames keyed by (source,
    node), for edges beyond a worker's memory. Both are exact.
    """
    if method not in ("source", "level"):
        raise ValueError("method must be source or level")
    names = symbols.select("qualified_name")
    links = high_edges(edges).select("source", "target")
    for end in ("source", "target"):
        links = links.join(names.select(F.col("qualified_name").alias(end)), end, "left_semi")
    path = new_path(edges.sparkSession, "between-edges")
    links.select("source", "target").write.parquet(path)
    links = edges.sparkSession.read.parquet(path)
    n = names.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    sums = _by_source(links) if method == "source" else _by_level(links)
    rows = names.join(sums.groupBy("qualified_name").agg(F.sum("dependency").alias("d")), "qualified_name", "left")
    return rows.select("qualified_name", F.round(F.coalesce("d", F.lit(0.0)) * scale, 12).alias("betweenness"))


def _by_source(links: DataFrame) -> DataFrame:
    steps = links.select(F.col("source").alias("from_node"), F.col("target").alias("to_node"), F.lit(0).alias("edge_id"), F.lit(0).alias("tag"))
    graph = work_graph(steps)
    return dependency_sums(graph, graph.starts(links, "source"))


def _by_level(links: DataFrame) -> DataFrame:
    """The same sums with all sources at once: path counts forward, dependencies backward, a join per level."""
    steps = links.groupBy("source", "target").agg(F.count(F.lit(1)).cast("double").alias("m"))
    steps, _ = materialize(steps, "between-steps")
    frontier = steps.select(F.col("source").alias("s"), F.col("source").alias("node"), F.lit(1.0).alias("paths")).distinct()
    frontier, _ = materialize(frontier, "between-0")
    levels, seen = [frontier], frontier.select("s", "node")
    while True:
        near = frontier.join(steps, F.col("node") == F.col("source")).groupBy("s", F.col("target").alias("node"))
        fresh = near.agg(F.sum(F.col("paths") * F.col("m")).alias("paths")).join(seen, ["s", "node"], "left_anti")
        fresh, _ = materialize(fresh, f"between-{len(levels)}")
        if fresh.isEmpty():
            break
        levels.append(fresh)
        seen, frontier = seen.unionByName(fresh.select("s", "node")), fresh
    owed = levels[-1].select("s", "node", "paths", F.lit(0.0).alias("owed"))
    parts = []
    for level in reversed(levels[:-1]):
        below = owed.select("s", F.col("node").alias("target"), ((1.0 + F.col("owed")) / F.col("paths")).alias("share"))
        near = level.join(steps, F.col("node") == F.col("source")).join(below, ["s", "target"])
        sums = near.groupBy("s", "node").agg(F.sum(F.col("paths") * F.col("m") * F.col("share")).alias("owed"))
        owed, _ = materialize(level.join(sums, ["s", "node"], "left").fillna(0.0, ["owed"]), "between-owed")
        parts.append(owed.where(F.col("s") != F.col("node")).select(F.col("node").alias("qualified_name"), F.col("owed").alias("dependency")))
    if not parts:
        return levels[0].select(F.col("node").alias("qualified_name"), F.lit(0.0).alias("dependency")).limit(0)
    return reduce(DataFrame.unionByName, parts)


def criticality(symbols: DataFrame, edges: DataFrame, flows: DataFrame, entries: DataFrame) -> DataFrame:
    """Every symbol with betweenness, number of flows and whether it is an entry point."""
    rows = betweenness(symbols, edges).join(flow_counts(flows).withColumnRenamed("node", "qualified_name"), "qualified_name", "left")
    marked = entries.select("qualified_name").distinct().withColumn("is_entry", F.lit(True))
    return rows.join(marked, "qualified_name", "left").fillna(0, ["n_flows"]).fillna(False, ["is_entry"])
