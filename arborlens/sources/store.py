"""The graph of symbols as versioned snapshots: upserts, file replacement and removal.

A snapshot is a list of immutable segments per table, named by one manifest with
a number for each. A change writes what it adds and the keys it takes out, and
is published at once, so a reader never sees half of it and a change costs as
much as it is large. Reading takes the newest row of a key and drops rows whose
key was taken out later. Beyond ``max_segments`` a table is written anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..model import EDGES, FILES, SYMBOLS
from ..runtime import remove_path
from .versions import VersionLog

SCHEMA_VERSION = 3
EMBEDDINGS = T.StructType(
    [
        T.StructField("qualified_name", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("text_hash", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("created_at", T.StringType()),
    ]
)
TABLES = {"files": FILES, "symbols": SYMBOLS, "edges": EDGES, "embeddings": EMBEDDINGS}


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: Column | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal key; of equal keys in ``new`` the last by ``order`` stays."""
    if order is not None:
        place = F.row_number().over(Window.partitionBy(*key).orderBy(order.desc_nulls_last()))
        new = new.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")
    else:
        new = new.dropDuplicates(key)
    return old.join(new.select(*key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def without_files(symbols: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols outside ``paths`` (column path), and edges that touch neither those files nor their symbols."""
    gone = paths.select("path").distinct()
    names = symbols.join(gone, symbols.file_path == gone.path, "left_semi").select(F.col("qualified_name").alias("gone"))
    ends = names.unionByName(gone.select(F.col("path").alias("gone"))).distinct()
    kept = symbols.join(gone, symbols.file_path == gone.path, "left_anti")
    left = edges.join(ends, edges.source == ends.gone, "left_anti")
    return kept, left.join(ends, left.target == ends.gone, "left_anti")


#: What makes a row of each table unique, and the columns that hold keys which can be taken out.
KEYS = {"files": ["path"], "symbols": ["qualified_name"], "edges": ["kind", "source", "target"], "embeddings": ["qualified_name"]}
_TAKEN_OUT_BY = {"files": ["path"], "symbols": ["file_path"], "edges": ["source", "target"], "embeddings": ["qualified_name"]}
_GONE = "key string"


def _upgraded(content: dict) -> dict:
    """A manifest of schema 2, which had one folder a table, as one of schema 3."""
    if content["schema"] == 2:
        tables = {name: [[path, 0]] for name, path in content["tables"].items()}
        content = content | {"schema": SCHEMA_VERSION, "tables": tables, "gone": [], "dropped": []}
    if content["schema"] != SCHEMA_VERSION:
        raise ValueError(f"the store has schema {content['schema']}, this library reads {SCHEMA_VERSION}")
    return content


class GraphStore:
    """Snapshots below ``root``; readers take the newest. A store of the schema before is read and upgraded by its next write."""

    def __init__(self, spark: SparkSession, root: str, max_segments: int = 12):
        self.spark, self.root, self.max_segments = spark, root.rstrip("/"), max_segments
        self.log = VersionLog(spark, self.root)
        self._now()

    def _now(self) -> tuple[int, dict]:
        number, content = self.log.newest()
        return number, _upgraded(content) if content else {"schema": SCHEMA_VERSION, "tables": {}, "gone": [], "dropped": [], "batch": None}

    def last_batch(self) -> int | None:
        """The batch that the newest snapshot ends with."""
        return self._now()[1]["batch"]

    def read(self, table: str) -> DataFrame:
        return self._read(table, self._now()[1])

    def _read(self, table: str, now: dict) -> DataFrame:
        shape, segments = TABLES[table], now["tables"].get(table, [])
        if not segments:
            return self.spark.createDataFrame([], shape)
        rows = None
        for path, number in segments:
            part = self.spark.read.schema(shape).parquet(path).withColumn("_at", F.lit(number))
            rows = part if rows is None else rows.unionByName(part)
        oldest = min(number for _, number in segments)
        gone = [(path, number) for path, number in now["dropped" if table == "embeddings" else "gone"] if number > oldest]
        if gone:
            keys = None
            for path, number in gone:
                part = self.spark.read.schema(_GONE).parquet(path).withColumn("_until", F.lit(number))
                keys = part if keys is None else keys.unionByName(part)
            keys = keys.groupBy("key").agg(F.max("_until").alias("_until"))
            for column in _TAKEN_OUT_BY[table]:
                rows = rows.join(keys.withColumnRenamed("key", column), column, "left").where(F.col("_until").isNull() | (F.col("_at") >= F.col("_until"))).drop("_until")
        if len(segments) > 1:
            newest = rows.groupBy(*KEYS[table]).agg(F.max("_at").alias("_newest"))
            rows = rows.join(newest, KEYS[table]).where(F.col("_at") == F.col("_newest"))
        return rows.select(*shape.fieldNames())

    def _segment(self, frame: DataFrame, name: str, shape=None) -> str:
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        if shape is not None:
            frame = frame.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in shape])
        frame.write.parquet(path)
        return path

    def _publish(self, number: int, now: dict, batch: int | None) -> int:
        """Publish a manifest, tables of too many segments written anew; gone keys older than all segments are left out."""
        for table, segments in now["tables"].items():
            if len(segments) > self.max_segments:
                now["tables"][table] = [[self._segment(self._read(table, now), table, TABLES[table]), number]]
        for kind, tables in (("gone", ("files", "symbols", "edges")), ("dropped", ("embeddings",))):
            oldest = min((n for t in tables for _, n in now["tables"].get(t, [])), default=number)
            now[kind] = [[path, n] for path, n in now[kind] if n > oldest]
        self.log.publish(number, now | {"batch": now["batch"] if batch is None else batch})
        return number

    def write(self, tables: dict[str, DataFrame], batch: int | None = None) -> int:
        """Publish new contents of ``tables``, in place of all they held, as the next version; returns its number."""
        number, now = self._now()
        for name, frame in tables.items():
            now["tables"][name] = [[self._segment(frame, name, TABLES[name]), number + 1]]
        return self._publish(number + 1, now, batch)

    def replace_files(self, files: DataFrame, symbols: DataFrame, edges: DataFrame, removed: DataFrame | None = None, batch: int | None = None) -> int:
        """Put in all data of ``files`` anew and take out the files of ``removed`` (column path), in one version.

        Of repeated names the symbol furthest down its file stays; edges are unique by kind, source and target.
        What is written is the files' own data and the keys that lost their old data.
        """
        paths = files.select("path")
        gone = paths if removed is None else paths.unionByName(removed.select("path"))
        symbols = upsert(symbols.limit(0), symbols, ["qualified_name"], F.col("line_start"))
        edges = edges.select("kind", "source", "target").distinct().withColumns({"edge_id": F.xxhash64("kind", "source", "target"), "metadata": F.lit(None).cast("string")})
        return self._change({"files": files.dropDuplicates(["path"]), "symbols": symbols, "edges": edges}, gone, batch)

    def remove_files(self, paths: DataFrame, batch: int | None = None) -> int:
        return self._change({}, paths, batch)

    def _change(self, added: dict[str, DataFrame], gone: DataFrame, batch: int | None) -> int:
        number, now = self._now()
        gone = gone.select(F.col("path").alias("key")).where(F.col("key").isNotNull()).distinct()
        own = self._read("symbols", now).select("qualified_name", F.col("file_path").alias("key")).join(gone, "key", "left_semi")
        keys = gone.unionByName(own.select(F.col("qualified_name").alias("key"))).distinct()
        now["gone"].append([self._segment(keys, "gone"), number + 1])
        for name, frame in added.items():
            now["tables"].setdefault(name, []).append([self._segment(frame, name, TABLES[name]), number + 1])
        return self._publish(number + 1, now, batch)

    def store_embeddings(self, rows: DataFrame) -> int:
        """Add vectors, or put them in place of those of the same names; of repeated names the last created stays."""
        number, now = self._now()
        rows = upsert(rows.limit(0), rows, ["qualified_name"], F.col("created_at"))
        now["tables"].setdefault("embeddings", []).append([self._segment(rows, "embeddings", EMBEDDINGS), number + 1])
        return self._publish(number + 1, now, None)

    def remove_embeddings(self, names: DataFrame) -> int:
        number, now = self._now()
        now["dropped"].append([self._segment(names.select(F.col("qualified_name").alias("key")).distinct(), "dropped"), number + 1])
        return self._publish(number + 1, now, None)

    def has_embedding(self, name: str) -> bool:
        return not self.read("embeddings").where(F.col("qualified_name") == name).isEmpty()

    def embedding_count(self) -> int:
        return self.read("embeddings").count()

    def embedding_hashes(self) -> DataFrame:
        """``qualified_name, text_hash`` of what is stored."""
        return self.read("embeddings").select("qualified_name", "text_hash")

    def vacuum(self) -> int:
        """Delete the folders that the newest version does not name, and say how many; readers of older versions must be done."""
        _, now = self._now()
        live = {path for segments in (*now["tables"].values(), now["gone"], now["dropped"]) for path, _ in segments}
        places = [f"{self.root}/{kind}/{name}" for kind in (*TABLES, "gone", "dropped") for name in self.log.names(f"{self.root}/{kind}")]
        old = [place for place in places if place not in live]
        for place in old:
            remove_path(self.spark, place)
        return len(old)
