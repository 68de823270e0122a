"""Processing only new or changed records, with versioned state.

State holds, per key, the stamp and content hash of its current row. It lives
in a folder of immutable segments and numbered manifests:

* a run writes one segment with the keys it touched, under a fresh name;
* it then publishes ``v<n+1>.json``, which lists all live segments and the
  outputs not yet acknowledged, by a rename that fails if that version exists.

The rename is the only commit. A run that dies before it leaves the old version
current and repeats in full. A run that dies after it has its output kept: asked
for the same run again, ``apply`` returns the same rows, until the reader says
by ``acknowledge`` that it has stored them. So no record is skipped, and none is
reported by two runs.

Segments are bucketed by a hash of the key. A delivery is reduced to one row per
key (before its one shuffle, so a key of a third of the rows is no hot spot) and
shuffled into the same buckets; the state is read bucket by bucket and never
shuffled. A key is looked up in at most ``max_segments`` segments; beyond that
the small ones are merged, and large ones only when the small ones have grown
to half their size.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..runtime import remove_path, task_count
from ..sources.versions import VersionLog

_SEGMENT = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("record_key", T.StringType()),
        T.StructField("stamp", T.LongType()),
        T.StructField("content_hash", T.BinaryType()),
        T.StructField("change", T.StringType()),
    ]
)
_KEY = ["table_name", "record_key"]


def epoch_seconds(stamp: Column) -> Column:
    """Whole seconds of an epoch number given in seconds or milliseconds (1e11 s is the year 5138)."""
    return F.when(F.abs(stamp) >= 100_000_000_000, F.floor(stamp / 1000)).otherwise(stamp).cast("long")


def digest(spelled: Column) -> Column:
    """Digest without regard to letter case, outer blanks and a prefix naming the algorithm."""
    return F.regexp_replace(F.lower(F.trim(spelled)), r"^sha-?_?256\s*[:=\-_ ]\s*", "")


@dataclass
class _Manifest:
    """``segments``: path and rows of each, oldest first; ``outputs``: the segment of each run not yet acknowledged."""

    version: int = 0
    last_run: int | None = None
    buckets: int = 0
    segments: list[list] = field(default_factory=list)
    outputs: dict[str, str] = field(default_factory=dict)


class KeyedState:
    """Versioned key-and-hash state in a folder that all executors share.

    ``buckets`` is fixed when the folder is new (default: the session's shuffle partitions) and kept from then on.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, max_segments: int = 6):
        self.spark, self.root, self.buckets, self.max_segments = spark, root.rstrip("/"), buckets, max_segments
        self.log = VersionLog(spark, self.root)

    def manifest(self) -> _Manifest:
        """The newest published version; version 0 is the empty state."""
        _, content = self.log.newest()
        return _Manifest(**content) if content else _Manifest(buckets=self.buckets or task_count(self.spark))

    def _segment(self, path: str, buckets: int) -> DataFrame:
        """A segment as a bucketed table, so that Spark knows its layout; the table is only a name for the folder."""
        name = f"arborlens_{path.rsplit('/', 1)[-1]}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _SEGMENT)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({', '.join(_KEY)}) INTO {buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame, buckets: int) -> list:
        """Write a segment; returns its path and number of rows."""
        name, counted = uuid.uuid4().hex, Observation()
        path = f"{self.root}/segments/{name}"
        rows = rows.observe(counted, F.count(F.lit(1)).alias("n"))
        rows.write.format("parquet").bucketBy(buckets, *_KEY).option("path", path).saveAsTable(f"arborlens_{name}")
        return [path, counted.get["n"]]

    def current(self) -> DataFrame:
        """The current row of every key: ``table_name, record_key, stamp, content_hash``."""
        now = self.manifest()
        if not now.segments:
            return self.spark.createDataFrame([], _SEGMENT).drop("change")
        return self._newest(now.segments, now.buckets).drop("change")

    def _newest(self, segments: list[list], buckets: int) -> DataFrame:
        """Rows of several segments, the newest of each key."""
        rows = None
        for age, (path, _) in enumerate(segments):
            part = self._segment(path, buckets).withColumn("age", F.lit(age))
            rows = part if rows is None else rows.unionByName(part)
        if len(segments) == 1:
            return rows.drop("age")
        newest = rows.groupBy(*_KEY).agg(F.max_by(F.struct("stamp", "content_hash"), "age").alias("s"))
        return newest.select(*_KEY, "s.stamp", "s.content_hash", F.lit("touched").alias("change"))

    def apply(self, run_id: int, delivered: DataFrame) -> DataFrame:
        """Fold one successful run's delivery into the state; returns its new and changed keys.

        ``delivered`` has ``table_name, record_key, stamp, content_hash``; further
        columns are ignored. Rows with a null key or stamp are no records. Of a
        key's rows the greatest stamp counts, of equal stamps the greatest hash.
        A null hash is a content of its own. A row older than the state changes
        nothing. Run ids grow: a run that is in the state already, or older than
        its last, changes nothing; its rows are returned again as long as they
        are not acknowledged, then none. An empty delivery publishes a version
        with an empty segment.

        Result: ``table_name, record_key, change`` (``new`` or ``changed``).
        """
        now = self.manifest()
        if now.last_run is not None and run_id <= now.last_run:
            return self.output(run_id)
        rows = delivered.select(*_KEY, "stamp", "content_hash").where(F.col("record_key").isNotNull() & F.col("stamp").isNotNull())
        rows = rows.withColumn("table_name", F.coalesce("table_name", F.lit("")))
        best = rows.groupBy(*_KEY).agg(F.max(F.struct("stamp", "content_hash")).alias("row"))
        if now.buckets != task_count(self.spark):
            best = best.repartition(now.buckets, *_KEY)
        best = best.withColumn("held", F.lit(None).cast("struct<stamp:bigint,content_hash:binary>"))
        for path, _ in now.segments:
            older = self._segment(path, now.buckets).select(*_KEY, F.struct("stamp", "content_hash").alias("there"))
            best = best.join(older, _KEY, "left").withColumn("held", F.coalesce("there", "held")).drop("there")
        touched = best.where(F.col("held").isNull() | (F.col("row") > F.col("held")))
        segment = touched.select(
            *_KEY,
            "row.stamp",
            "row.content_hash",
            F.when(F.col("held").isNull(), "new")
            .when(~F.col("row.content_hash").eqNullSafe(F.col("held.content_hash")), "changed")
            .otherwise("touched")
            .alias("change"),
        )
        written = self._write(segment, now.buckets)
        after = _Manifest(
            now.version + 1, run_id, now.buckets, self._merged([*now.segments, written], now.buckets), {**now.outputs, str(run_id): written[0]}
        )
        self.log.publish(after.version, asdict(after))
        return self.output(run_id)

    def output(self, run_id: int) -> DataFrame:
        """The new and changed keys of a committed run that is not acknowledged; no rows for any other."""
        now = self.manifest()
        path = now.outputs.get(str(run_id))
        if path is None:
            return self.spark.createDataFrame([], _SEGMENT).select(*_KEY, "change")
        return self.spark.read.schema(_SEGMENT).parquet(path).where(F.col("change") != "touched").select(*_KEY, "change")

    def acknowledge(self, run_id: int) -> None:
        """The reader has stored the output of ``run_id``: it need not be kept."""
        now = self.manifest()
        if now.outputs.pop(str(run_id), None) is not None:
            now.version += 1
            self.log.publish(now.version, asdict(now))

    def vacuum(self) -> int:
        """Delete the segments that the newest version does not name, and say how many; readers of older versions must be done."""
        now = self.manifest()
        live = {path.rsplit("/", 1)[-1] for path in (*(p for p, _ in now.segments), *now.outputs.values())}
        gone = [name for name in self.log.names(f"{self.root}/segments") if name not in live]
        for name in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS arborlens_{name}")
            remove_path(self.spark, f"{self.root}/segments/{name}")
        return len(gone)

    def _merged(self, segments: list[list], buckets: int) -> list[list]:
        """Beyond ``max_segments``, merge the newest ones, and as many older ones as are not twice as large as these together."""
        kept = [s for s in segments if s[1]]
        if len(kept) <= self.max_segments:
            return kept
        at = next(i for i in range(len(kept)) if i == len(kept) - 2 or kept[i][1] <= 2 * sum(n for _, n in kept[i + 1 :]))
        return [*kept[:at], self._write(self._newest(kept[at:], buckets), buckets)]


def replay_runs(
    state: KeyedState, runs: list[tuple[int, bool]], deliveries: DataFrame, staging: str
) -> list[tuple[int, DataFrame]]:
    """Drive ``state`` through index runs; one (run id, new and changed keys) for each succeeded run.

    ``deliveries`` has ``table_name, record_key, stamp, content_hash, load_id``.
    What a run without success delivered waits for the next success. Deliveries
    are laid out once by the run that will process them, so a run reads its own
    rows only. A restart gives all outputs that are not acknowledged again. ``runs`` (id, succeeded) is the run log, which has one row per
    run; rows delivered after the last success stay unprocessed.
    """
    good = sorted(run for run, ok in runs if ok)
    if not good:
        return []
    due = F.lit(None).cast("long")
    for run in reversed(good):
        due = F.when(F.col("load_id") <= run, F.lit(run).cast("long")).otherwise(due)
    staged = deliveries.withColumn("due_run", due).where(F.col("due_run").isNotNull())
    staged = staged.select(*_KEY, "stamp", "content_hash", "due_run")
    staged.write.partitionBy("due_run").parquet(staging)
    spark = deliveries.sparkSession
    read = spark.read.schema(staged.schema).parquet(staging)
    return [(run, state.apply(run, read.where(F.col("due_run") == run))) for run in good]
