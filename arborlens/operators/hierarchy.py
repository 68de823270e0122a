"""Parent-child links to full hierarchies, by tree contraction.

Each round reduces the forest of unresolved nodes:

* rake: every leaf is taken off and recorded with its parent;
* compress: of the nodes with one child, an independent set (those whose hash
  is below their parent's and their child's) is spliced out; the child is
  re-pointed to the grandparent with the summed distance.

Trees vanish in O(log n) rounds, whatever their depth. A cycle has no leaf, so
it can only shrink, until one node points at itself: such a core exposes the
cycle and carries its smallest key. Then the recorded rounds are undone from
last to first: a node's root and distance follow from the node it was recorded
with, which is resolved by then.

A round is one job with three shuffles on node keys. Child counts are summed
before they are shuffled. When rounds are undone, nodes meet their parent; no
splice gives a parent more children than it had, so parents of many are known
from the start: their few rows are sent to where their children are, and no task
gets all children of one parent.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..runtime import materialize, remove_path, task_count

_RECORD = "node string, parent string, dist bigint, low string, via array<string>, only string, action string"


def parent_links(edges: DataFrame, child_of: list[str], contains: list[str]) -> DataFrame:
    """One ``(node, parent)`` per node: by its child_of edge or, without one, by its contains edge.

    ``edges`` has kind, source, target. Edges with a null end do not count. Of
    several parents of the same kind the smallest key is taken.
    """
    up = F.col("kind").isin(child_of)
    rows = edges.where((up | F.col("kind").isin(contains)) & F.col("source").isNotNull() & F.col("target").isNotNull())
    rows = rows.select(
        F.when(up, F.col("source")).otherwise(F.col("target")).alias("node"),
        F.when(up, F.col("target")).alias("above"),
        F.when(~up, F.col("source")).alias("container"),
    )
    picked = rows.groupBy("node").agg(F.min("above").alias("above"), F.min("container").alias("container"))
    return picked.select("node", F.coalesce("above", "container").alias("parent"))


@dataclass
class Contraction:
    """Recorded rounds (paths of raked and spliced nodes) and the self-pointing cores of the cycles."""

    rounds: list[str] = field(default_factory=list)
    cores: list[str] = field(default_factory=list)


def _round(links: DataFrame, number: int) -> DataFrame:
    """Classify the links of one round: action rake, splice, keep or core; ``only`` is a spliced node's child."""
    told = links.where(F.col("node") != F.col("parent")).select(F.col("parent").alias("key"), F.col("node").alias("child"))
    children = told.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("child").alias("only"))
    rows = links.join(children, links.node == children.key, "left").drop("key")

    def rank(key: str):
        return F.struct(F.xxhash64(F.lit(number), F.col(key)), F.col(key))

    chain = (F.col("n") == 1) & (F.col("node") != F.col("parent"))
    lowest = (rank("node") < rank("parent")) & (rank("node") < rank("only"))
    action = (
        F.when(F.col("node") == F.col("parent"), F.when(F.col("n").isNull(), "core").otherwise("keep"))
        .when(F.col("n").isNull(), "rake")
        .when(chain & lowest, "splice")
        .otherwise("keep")
    )
    return rows.withColumn("action", action).drop("n")


def contract(links: DataFrame, with_paths: bool = False, max_rounds: int = 400) -> Contraction:
    """Contract ``links`` (node, parent; one row per node) until only cores of cycles remain."""
    spark = links.sparkSession
    empty = F.array().cast("array<string>") if with_paths else F.lit(None).cast("array<string>")
    active = links.select(
        "node", "parent", F.lit(1).cast("long").alias("dist"), F.lit(None).cast("string").alias("low"), empty.alias("via")
    )
    done = Contraction()
    for number in range(max_rounds):
        _, path = materialize(_round(active, number), f"contract-{number}", partition_by=["action"])
        rows = spark.read.schema(_RECORD).parquet(path)
        done.rounds.append(path)
        counts = {r["action"]: r["count"] for r in rows.groupBy("action").count().collect()}
        if counts.get("core"):
            done.cores.append(path)
        if not counts.get("keep"):
            break
        kept = rows.where(F.col("action") == "keep").select("node", "parent", "dist", "low", "via")
        if counts.get("splice"):
            cut = rows.where(F.col("action") == "splice").select(
                F.col("only").alias("cut_key"),
                F.col("parent").alias("cut_parent"),
                F.col("dist").alias("cut_dist"),
                F.least(F.col("node"), F.col("low")).alias("cut_low"),
                F.concat(F.col("via"), F.array("node")).alias("cut_via"),
            )
            kept = kept.join(cut, kept.node == cut.cut_key, "left").select(
                "node",
                F.coalesce("cut_parent", "parent").alias("parent"),
                (F.col("dist") + F.coalesce("cut_dist", F.lit(0))).alias("dist"),
                F.least("low", "cut_low").alias("low"),
                F.when(F.col("cut_key").isNull(), F.col("via")).otherwise(F.concat("cut_via", "via")).alias("via"),
            )
        active = kept
    else:
        raise RuntimeError(f"{max_rounds} rounds did not contract the forest")
    return done


def hierarchy(links: DataFrame, with_paths: bool = False) -> DataFrame:
    """Root, depth and optionally the path of every node that has a parent.

    ``links``: one ``(node, parent)`` per node; rows with a null end and further
    columns are ignored, of repeated nodes the smallest parent counts. Result:
    ``node, root_node, depth`` and, with paths, ``path`` (keys from the root to
    the node, both included). A node on a cycle, or below one, has depth -1, the
    smallest key of the cycle as root and a null path. Roots have no row. An
    empty table gives no rows.
    """
    spark = links.sparkSession
    links = links.where(F.col("node").isNotNull() & F.col("parent").isNotNull())
    links = links.groupBy("node").agg(F.min("parent").alias("parent"))
    links, links_path = materialize(links, "hierarchy-links")
    busy = busy_parents(links)
    done = contract(links, with_paths)
    remove_path(spark, links_path)
    out = "node string, root_node string, depth bigint, path array<string>"
    parts: list[str] = []
    if done.cores:
        cores = reduce(DataFrame.unionByName, [spark.read.schema(_RECORD).parquet(path) for path in done.cores])
        cores = cores.where(F.col("action") == "core")
        ready = cores.select(
            "node",
            F.least("node", "low").alias("root_node"),
            F.lit(-1).cast("long").alias("depth"),
            F.lit(None).cast("array<string>").alias("path"),
        )
        parts.append(materialize(ready, "cores")[1])
    for number in range(len(done.rounds) - 1, -1, -1):
        rows = spark.read.schema(_RECORD).parquet(done.rounds[number])
        known = spark.read.schema(out).parquet(*parts) if parts else spark.createDataFrame([], out)
        spliced = _resolve(rows.where(F.col("action") == "splice"), known, busy)
        raked = _resolve(rows.where(F.col("action") == "rake"), known.unionByName(spliced), busy)
        parts.append(materialize(spliced.unionByName(raked), f"expand-{number}")[1])
        remove_path(spark, done.rounds[number])
    result = spark.read.schema(out).parquet(*parts)
    return result if with_paths else result.drop("path")


def busy_parents(links: DataFrame, per_task: int = 4) -> list[str]:
    """Parents of more than a ``per_task``-th of a task's fair share of ``links``: at most ``per_task`` times the tasks."""
    tasks = task_count(links.sparkSession)
    counted = links.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    share = links.count() / (tasks * per_task)
    return [r["parent"] for r in counted.where(F.col("n") > share).collect()]


def _resolve(records: DataFrame, known: DataFrame, busy: list[str]) -> DataFrame:
    """Records (node, parent, dist, via) against resolved nodes; a parent that is not resolved is a root.

    Children of ``busy`` parents stay where they are: the parents' rows are broadcast, one for each.
    """
    above = known.select(
        F.col("node").alias("k"), F.col("root_node").alias("k_root"), F.col("depth").alias("k_depth"), F.col("path").alias("k_path")
    )
    rows = records.select("node", "parent", "dist", "via")
    if busy:
        crowd, rest = F.col("parent").isin(busy), ~F.col("parent").isin(busy)
        near = rows.where(crowd).join(F.broadcast(above.where(F.col("k").isin(busy))), F.col("parent") == F.col("k"), "left")
        both = near.unionByName(rows.where(rest).join(above.where(~F.col("k").isin(busy)), F.col("parent") == F.col("k"), "left"))
    else:
        both = rows.join(above, F.col("parent") == F.col("k"), "left")
    cyclic = F.col("k_depth") == -1
    head = F.when(F.col("k").isNull(), F.array("parent")).otherwise(F.col("k_path"))
    return both.select(
        "node",
        F.coalesce("k_root", "parent").alias("root_node"),
        F.when(cyclic, F.lit(-1)).otherwise(F.coalesce("k_depth", F.lit(0)) + F.col("dist")).cast("long").alias("depth"),
        F.when(~F.coalesce(cyclic, F.lit(False)), F.concat(head, F.col("via"), F.array("node"))).alias("path"),
    )


def descendants(resolved: DataFrame) -> DataFrame:
    """Every ``(ancestor, descendant, distance)`` of ``hierarchy(..., with_paths=True)``; nodes of cycles have none."""
    steps = resolved.where(F.col("path").isNotNull()).select(
        F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor")
    )
    return steps.where(F.col("at") < F.col("depth")).select(
        "ancestor", "descendant", (F.col("depth") - F.col("at")).cast("long").alias("distance")
    )
