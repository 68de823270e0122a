"""Session helpers: where durable intermediates live and how lineage is cut.

Every iterative operator writes its rounds as Parquet below the shared folder
named by ``spark.checkpoint.dir`` and reads them back. The files survive the
loss of any executor and end the lineage, so a lost task repeats one round, not
all of them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_SETTING = "spark.checkpoint.dir"


def build_session(app: str = "arborlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where the session names none, a temporary one is made if the master is
    local; on a cluster executors would not share it, so that is an error.
    """
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="arborlens-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/arborlens/{label}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back; returns the frame and its path."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def numbered(df: DataFrame, order: list, name: str, first: int = 1) -> DataFrame:
    """``df`` with a running number in a total order, without one task that sorts all rows.

    Rows are range-partitioned and sorted; each partition's start follows from
    the counts of those before it (one small row per partition).
    """
    local, whole = F.lit((1 << 33) - 1), Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    laid = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    laid, _ = materialize(laid, "numbered")
    part = F.shiftrightunsigned("_id", 33).alias("_part")
    starts = laid.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_start"))
    both = laid.withColumn("_part", F.shiftrightunsigned("_id", 33)).join(starts, "_part")
    return both.withColumn(name, F.col("_start") + F.col("_id").bitwiseAND(local) + first).drop("_part", "_id", "_start")


def task_count(spark: SparkSession) -> int:
    """Tasks that a balanced stage should have: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
