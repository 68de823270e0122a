"""Per-key results although a few keys hold most records: fragment and replicate by estimated load.

A load plan is made in two narrow counts. Rows are first counted by key hash
into a bounded number of groups; only in groups heavy enough to hide a large
key are keys counted themselves. Keys above one task's share are split into
proportionate shards, and shards and groups are bin-packed to tasks, the
heaviest first to the least loaded task. The plan has at most ``groups_per_task``
entries per task, whatever the data, which is what may be broadcast.

Rows are then sent to their task by number. The matching side of a join is sent
to the task of its key, and for a large key to each task that holds one of its
shards, and nowhere else.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..runtime import task_count


@dataclass
class LoadPlan:
    """``tasks``; the task of each hash group; the tasks of each large key's shards; all rows and null keys counted."""

    tasks: int
    groups: int
    group_task: list[int]
    large: dict[str, list[int]]
    total: int
    null_keys: int
    loads: list[float]


def _group(key: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")


def plan_load(rows: DataFrame, key: str, tasks: int | None = None, groups_per_task: int = 16) -> LoadPlan:
    """Estimate the load by key and bin-pack it to ``tasks`` (default: the session's shuffle partitions)."""
    tasks = tasks or task_count(rows.sparkSession)
    groups = tasks * groups_per_task
    keyed = rows.select(F.col(key).cast("string").alias("k"))
    grp = F.when(F.col("k").isNotNull(), _group(F.col("k"), groups))
    counted = {r["g"]: r["n"] for r in keyed.groupBy(grp.alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()}
    null_keys = counted.pop(None, 0)
    present = sum(counted.values())
    share = max(1.0, present / tasks)
    heavy = [g for g, n in counted.items() if n > share]
    large: dict[str, int] = {}
    if heavy:
        inside = keyed.where(F.col("k").isNotNull() & _group(F.col("k"), groups).isin(heavy))
        big = inside.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share)
        for row in big.withColumn("g", _group(F.col("k"), groups)).collect():
            large[row["k"]] = row["n"]
            counted[row["g"]] -= row["n"]
    pieces: list[tuple[float, str | int]] = [(float(n), g) for g, n in counted.items()]
    for k, n in large.items():
        shards = math.ceil(n / share)
        pieces += [(n / shards, k)] * shards
    pieces.sort(key=lambda p: (-p[0], str(p[1])))
    heap = [(0.0, t) for t in range(tasks)]
    group_task, large_tasks = [g % tasks for g in range(groups)], {k: [] for k in large}
    for load, what in pieces:
        lowest, task = heapq.heappop(heap)
        heapq.heappush(heap, (lowest + load, task))
        if isinstance(what, str):
            large_tasks[what].append(task)
        else:
            group_task[what] = task
    return LoadPlan(tasks, groups, group_task, large_tasks, present + null_keys, null_keys, [x for x, _ in sorted(heap, key=lambda h: h[1])])


def _plan_tables(spark: SparkSession, plan: LoadPlan) -> tuple[DataFrame, DataFrame]:
    groups = spark.createDataFrame(list(enumerate(plan.group_task)), "plan_group int, group_task int")
    large = spark.createDataFrame(list(plan.large.items()), "plan_key string, shard_tasks array<int>")
    return groups, large


def fragment(rows: DataFrame, key: str, plan: LoadPlan) -> DataFrame:
    """``rows`` with a non-null key, sent to the tasks of the plan; adds ``task`` and ``is_large``.

    Rows of a large key go to its shards by a hash of the whole row and of the
    partition it lies in, so neither a hot second column nor repeated rows pile
    up, and a task that is repeated sends each row where it sent it before,
    whatever order its input comes in. Columns named like these two are replaced.
    """
    spark = rows.sparkSession
    groups, large = _plan_tables(spark, plan)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns], F.spark_partition_id()), F.size("shard_tasks"))
    placed = (
        rows.where(F.col(key).isNotNull())
        .withColumn("plan_group", _group(F.col(key).cast("string"), plan.groups))
        .join(F.broadcast(groups), "plan_group", "left")
        .join(F.broadcast(large), F.col(key).cast("string") == F.col("plan_key"), "left")
    )
    is_large = F.col("plan_key").isNotNull()
    task = F.when(is_large, F.get("shard_tasks", spread.cast("int"))).otherwise(F.col("group_task"))
    placed = placed.withColumns({"task": task.cast("int"), "is_large": is_large})
    return placed.drop("plan_group", "group_task", "plan_key", "shard_tasks").repartitionById(plan.tasks, "task")


def replicate(rows: DataFrame, key: str, plan: LoadPlan) -> DataFrame:
    """The matching side: each row to the task of its key, a large key's rows to each of its shards' tasks."""
    groups, large = _plan_tables(rows.sparkSession, plan)
    placed = (
        rows.where(F.col(key).isNotNull())
        .withColumn("plan_group", _group(F.col(key).cast("string"), plan.groups))
        .join(F.broadcast(groups), "plan_group", "left")
        .join(F.broadcast(large), F.col(key).cast("string") == F.col("plan_key"), "left")
        .withColumn("task", F.explode(F.coalesce(F.array_distinct("shard_tasks"), F.array("group_task"))))
    )
    return placed.drop("plan_group", "group_task", "plan_key", "shard_tasks").repartitionById(plan.tasks, "task")


def balanced_join(
    rows: DataFrame, matching: DataFrame, key: str, tasks: int | None = None, how: str = "left", plan: LoadPlan | None = None, if_large: bool = False
) -> DataFrame:
    """``rows`` joined to ``matching`` on ``key`` (same name on both sides) without an overloaded task.

    Null keys match nothing; with ``how="left"`` such rows stay. Columns of
    ``matching`` must not clash with those of ``rows``. A ``plan`` of the same
    rows can be used for several joins. With ``if_large`` rows without any large
    key are joined as Spark likes, which gives the same result.
    """
    plan = plan or plan_load(rows, key, tasks)
    if if_large and not plan.large:
        return rows.join(matching, key, how)
    left = fragment(rows, key, plan).drop("is_large")
    right = replicate(matching, key, plan)
    joined = left.join(right, ["task", key], how).drop("task")
    if how == "left":
        blank = rows.where(F.col(key).isNull())
        for name in joined.columns:
            if name not in rows.columns:
                blank = blank.withColumn(name, F.lit(None).cast(joined.schema[name].dataType))
        joined = joined.unionByName(blank.select(*joined.columns))
    return joined


def balanced_stats(rows: DataFrame, key: str, stamp: str, row_id: str, distinct: str, plan: LoadPlan | None = None) -> DataFrame:
    """Per key: ``n_rows``, newest row (greatest ``stamp``, then ``row_id``) and ``n_distinct`` of a column.

    Result: ``record_key, n_rows, newest_stamp, newest_id, n_distinct``. Null
    keys have no result; null ids and stamps rank below all others; null
    values of ``distinct`` do not count; repeated rows count as often as they
    come. An empty table gives no rows.

    Small keys are finished in the task the plan gave them. Shards of a large
    key are reduced to one row per value of ``distinct`` and joined by a second
    aggregation on (key, value), so its distinct count is exact and spread out.
    """
    plan = plan or plan_load(rows, key)
    base = rows.select(
        F.col(key).alias("record_key"), F.col(stamp).cast("long").alias("s"), F.col(row_id).cast("long").alias("i"), F.col(distinct).alias("v")
    )
    sharded = fragment(base, "record_key", plan)
    newest = F.max(F.struct("s", "i")).alias("top")
    inner = sharded.groupBy("task", "is_large", "record_key", "v").agg(F.count(F.lit(1)).alias("n"), newest)

    def finish(part: DataFrame, by: list[str]) -> DataFrame:
        done = part.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.max("top").alias("top"), F.count("v").alias("n_distinct"))
        return done.select("record_key", "n_rows", F.col("top.s").alias("newest_stamp"), F.col("top.i").alias("newest_id"), "n_distinct")

    small = finish(inner.where(~F.col("is_large")), ["task", "is_large", "record_key"])
    shards = inner.where(F.col("is_large")).groupBy("record_key", "v").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    return small.unionByName(finish(shards, ["record_key"]))
