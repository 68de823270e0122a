"""Communities of the call graph by modularity: the Leiden method.

Nodes move to the neighbouring community of greatest gain until none moves;
communities are refined from singletons inside each; the parts become nodes
and the next level begins. The moves depend on each other, so links that fit
a worker, as numbers, are one task (``leiden``).

Beyond that, all nodes move at once in DataFrames. A sweep is two half-sweeps:
first the nodes of one random half (a hash of name and sweep) move, then the
others, so two neighbours rarely swap places. At the end, members of a
community that are not connected inside it are split apart.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.names import file_stem
from ..model import HIGH_KINDS, CommunityConfig
from ..runtime import materialize, numbered
from .components import connected_components
from .leiden import leiden
from .skew import LoadPlan, balanced_join, plan_load

# File stems too common to name a community.
GENERIC_STEMS = ["mod", "lib", "index", "main", "utils", "helpers"]
_EPSILON = 1e-12


def weights(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``lo, hi, weight``: undirected high-confidence edges between known symbols, weight = multiplicity, no loops."""
    names = symbols.select("qualified_name")
    inner = edges.where(F.col("kind").isin(HIGH_KINDS) & (F.col("source") != F.col("target")))
    for end in ("source", "target"):
        inner = inner.join(names.select(F.col("qualified_name").alias(end)), end, "left_semi")
    ends = inner.groupBy(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi"))
    return ends.agg(F.count(F.lit(1)).alias("weight"))


def _both_ways(links: DataFrame) -> DataFrame:
    there = links.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "weight")
    return there.unionByName(links.where(F.col("lo") != F.col("hi")).select(F.col("hi").alias("a"), F.col("lo").alias("b"), "weight"))


def _sweep(adjacent: DataFrame, plan: LoadPlan, labels: DataFrame, total: float, resolution: float, number: int, alone: bool = False) -> DataFrame:
    """One half-sweep over ``labels`` (node, degree, community); marks what moved. ``plan`` spreads the links of hubs.

    With ``alone`` only nodes move that are their community's only member.
    """
    sums = labels.groupBy("community").agg(F.sum("degree").alias("k"), F.count(F.lit(1)).alias("n"))
    near = balanced_join(adjacent, labels.select(F.col("node").alias("b"), "community"), "b", how="inner", plan=plan, if_large=True).where(F.col("a") != F.col("b"))
    ties = near.groupBy(F.col("a").alias("node"), F.col("community").alias("to")).agg(F.sum("weight").alias("w"))
    own = labels.select("node", F.col("community").alias("to"), F.lit(0).cast("double").alias("w"))
    options = ties.select("node", "to", F.col("w").cast("double").alias("w")).unionByName(own).groupBy("node", "to").agg(F.sum("w").alias("w"))
    rated = options.join(labels, "node").join(sums.select(F.col("community").alias("to"), "k", "n"), "to")
    stays = F.col("to") == F.col("community")
    others = F.col("k") - F.when(stays, F.col("degree")).otherwise(0)
    gain = F.col("w") - F.lit(resolution) * F.col("degree") * others / F.lit(2 * total)
    rated = rated.withColumn("gain", gain)
    best = rated.groupBy("node", "degree", "community").agg(
        F.max_by("to", F.struct("gain", "to")).alias("best"), F.max("gain").alias("top"), F.max(F.when(stays, F.col("gain"))).alias("now"), F.max(F.when(stays, F.col("n"))).alias("n")
    )
    turn = F.pmod(F.xxhash64("node", F.lit(number // 2)), F.lit(2)) == number % 2
    moves = turn & (F.col("top") > F.col("now") + _EPSILON)
    if alone:
        moves &= F.col("n") == 1
    return best.select("node", "degree", F.when(moves, F.col("best")).otherwise(F.col("community")).alias("community"), moves.alias("moved"))


def detect(symbols: DataFrame, edges: DataFrame, config: CommunityConfig = CommunityConfig(), max_sweeps: int = 400, task_links: int = 8_000_000) -> DataFrame:
    """``qualified_name, community_id, n_members``; ids from 0 by size, then smallest name.

    Up to ``task_links`` linked pairs are one task (an estimated 100 bytes a pair
    in memory); more are moved in DataFrames, where a level that does not settle in
    ``max_sweeps`` half-sweeps is an error, not a result. Communities below
    ``min_size`` and symbols without edges have no row.
    """
    base, _ = materialize(weights(symbols, edges), "community-weights")
    size = base.agg(F.sum("weight"), F.count(F.lit(1))).first()
    if not size[0]:
        return edges.sparkSession.createDataFrame([], "qualified_name string, community_id bigint, n_members bigint")
    if size[1] <= task_links:
        return _numbered(_in_one_task(base, config), config.min_size)
    return _numbered(_connected(base, _in_sweeps(base, float(size[0]), config, max_sweeps)), config.min_size)


def _in_one_task(links: DataFrame, config: CommunityConfig) -> DataFrame:
    """``node, community`` by ``leiden``; the community is its smallest node."""
    ends = links.select(F.explode(F.array("lo", "hi")).alias("node")).distinct()
    nodes, _ = materialize(numbered(ends, ["node"], "i", first=0), "community-nodes")
    n = nodes.count()
    coded = links.join(nodes.select(F.col("node").alias("lo"), F.col("i").alias("x")), "lo").join(nodes.select(F.col("node").alias("hi"), F.col("i").alias("y")), "hi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in batch.columns] for batch in batches]
        lo, hi, weight = (np.concatenate(c) for c in zip(*parts))
        found = leiden(lo.astype(np.int32), hi.astype(np.int32), weight, n, config.resolution, config.max_rounds)
        first = np.full(n, n)
        np.minimum.at(first, found, np.arange(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(first[found])], ["i", "c"])

    member = coded.select("x", "y", "weight").coalesce(1).mapInArrow(run, "i bigint, c bigint")
    names = nodes.select(F.col("node").alias("community"), F.col("i").alias("c"))
    member, _ = materialize(member.join(nodes, "i").join(names, "c").select("node", "community"), "community-members")
    return member


def _settled(adjacent: DataFrame, labels: DataFrame, total: float, resolution: float, number: int, max_sweeps: int, alone: bool = False) -> tuple[DataFrame, bool]:
    """Half-sweeps until a whole sweep moves nothing: the labels, and whether any node moved."""
    plan, changed, n_moved = plan_load(adjacent, "b"), False, 0
    for k in range(max_sweeps):
        moved, _ = materialize(_sweep(adjacent, plan, labels, total, resolution, number + k, alone), "community-sweep")
        labels = moved.drop("moved")
        n_moved = moved.where("moved").count() + (n_moved if k % 2 else 0)
        changed |= n_moved > 0
        if k % 2 == 1 and not n_moved:
            return labels, changed
    raise RuntimeError(f"a level did not settle in {max_sweeps} half-sweeps")


def _in_sweeps(links: DataFrame, total: float, config: CommunityConfig, max_sweeps: int) -> DataFrame:
    """``node, community``: the same levels with all nodes at once, for links beyond a worker's memory."""
    member = None
    for level in range(config.max_rounds):
        adjacent, _ = materialize(_both_ways(links), f"community-level-{level}")
        degree = adjacent.groupBy(F.col("a").alias("node")).agg(F.sum(F.when(F.col("a") == F.col("b"), 2 * F.col("weight")).otherwise(F.col("weight"))).cast("double").alias("degree"))
        single, _ = materialize(degree.select("node", "degree", F.col("node").alias("community")), "community-single")
        labels, changed = _settled(adjacent, single, total, config.resolution, 2 * level * max_sweeps, max_sweeps)
        if changed:
            of = labels.select(F.col("node").alias("n"), "community")
            inner = adjacent.join(of.select(F.col("n").alias("a"), F.col("community").alias("x")), "a").join(of.select(F.col("n").alias("b"), F.col("community").alias("y")), "b")
            inner, _ = materialize(inner.where(F.col("x") == F.col("y")).select("a", "b", "weight"), f"community-inner-{level}")
            labels, changed = _settled(inner, single, total, config.resolution, (2 * level + 1) * max_sweeps, max_sweeps, alone=True)
        step = labels.select("node", "community")
        member = step if member is None else member.join(step.select(F.col("node").alias("community"), F.col("community").alias("next")), "community").select("node", F.col("next").alias("community"))
        member, _ = materialize(member, f"community-members-{level}")
        if not changed:
            break
        to = step.select(F.col("node").alias("n"), "community")
        merged = links.join(to.select(F.col("n").alias("lo"), F.col("community").alias("x")), "lo").join(to.select(F.col("n").alias("hi"), F.col("community").alias("y")), "hi")
        links = merged.groupBy(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(F.sum("weight").alias("weight"))
    return member


def _connected(links: DataFrame, member: DataFrame) -> DataFrame:
    of = member.select(F.col("node").alias("n"), "community")
    inner = links.join(of.select(F.col("n").alias("lo"), F.col("community").alias("x")), "lo").join(of.select(F.col("n").alias("hi"), F.col("community").alias("y")), "hi")
    parts = connected_components(inner.where(F.col("x") == F.col("y")).select(F.col("lo").alias("a"), F.col("hi").alias("b")))
    return member.select("node").join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("community"))


def _numbered(member: DataFrame, min_size: int) -> DataFrame:
    sizes = member.groupBy("community").agg(F.count(F.lit(1)).alias("n_members")).where(F.col("n_members") >= min_size)
    placed = numbered(sizes, [F.desc("n_members"), "community"], "community_id", first=0)
    return member.join(placed, "community").select(F.col("node").alias("qualified_name"), "community_id", "n_members")


def cards(partition: DataFrame, links: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Per community: members, inner and boundary neighbour pairs, degree, and its share of the modularity.

    ``partition``: qualified_name, community; ``links`` as of ``weights``. The
    contribution counts inner pairs once each, whatever their weight.
    """
    totals = links.agg(F.sum("weight").cast("double").alias("m")).withColumn("one", F.lit(1))
    of = partition.select(F.col("qualified_name").alias("n"), "community")
    placed = links.join(of.select(F.col("n").alias("lo"), F.col("community").alias("x")), "lo", "left").join(of.select(F.col("n").alias("hi"), F.col("community").alias("y")), "hi", "left")
    sides = placed.select(F.inline(F.array(F.struct(F.col("x").alias("community"), F.col("y").alias("other"), "weight", F.lit(True).alias("first")), F.struct(F.col("y").alias("community"), F.col("x").alias("other"), "weight", F.lit(False).alias("first")))))
    inside = F.col("other").eqNullSafe(F.col("community"))
    sums = sides.where(F.col("community").isNotNull()).groupBy("community").agg(
        F.count_if(inside & F.col("first")).alias("inner_pairs"),
        F.count_if(~inside).alias("boundary_pairs"),
        F.sum(F.when(inside & F.col("first"), F.col("weight")).otherwise(0)).alias("inner_weight"),
        F.sum("weight").alias("degree"),
    )
    sizes = partition.groupBy("community").agg(F.count(F.lit(1)).alias("n_members"))
    both = sizes.join(sums, "community", "left").fillna(0, ["inner_pairs", "boundary_pairs", "inner_weight", "degree"])
    both = both.withColumn("one", F.lit(1)).join(F.broadcast(totals), "one").drop("one")
    expected = F.lit(resolution) * F.pow(F.try_divide("degree", 2 * F.col("m")), F.lit(2))
    return both.withColumns(
        {
            "contribution": F.coalesce(F.try_divide("inner_pairs", "m") - expected, F.lit(0.0)),
            "quality": F.coalesce(F.try_divide("inner_weight", "m") - expected, F.lit(0.0)),
        }
    ).drop("m")


def modularity(partition: DataFrame, links: DataFrame, resolution: float = 1.0) -> DataFrame:
    return cards(partition, links, resolution).agg(F.coalesce(F.sum("quality"), F.lit(0.0)).alias("modularity"))


def names(partition: DataFrame) -> DataFrame:
    """``community, name``: its most frequent file stem (ties alphabetical), or ``community_<id>`` if that is generic."""
    stem = file_stem(F.substring_index("qualified_name", "::", 1))
    counted = partition.groupBy("community", stem.alias("stem")).agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("stem")))["stem"].alias("stem"))
    generic = F.col("stem").isin(GENERIC_STEMS)
    return best.select("community", F.when(generic, F.concat(F.lit("community_"), F.col("community").cast("string"))).otherwise(F.col("stem")).alias("name"))


def stats(partition: DataFrame, symbols: DataFrame, links: DataFrame) -> DataFrame:
    """Number, mean and largest size of communities, and symbols without edges."""
    sizes = partition.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    head = sizes.agg(F.count(F.lit(1)).alias("n_communities"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_size"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    ends = links.select(F.explode(F.array("lo", "hi")).alias("qualified_name")).distinct()
    alone = symbols.select("qualified_name").join(ends, "qualified_name", "left_anti").agg(F.count(F.lit(1)).alias("n_isolated"))
    return head.withColumn("one", F.lit(1)).join(alone.withColumn("one", F.lit(1)), "one").drop("one")
