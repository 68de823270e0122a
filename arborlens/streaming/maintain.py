"""Keeping the graph fresh from a stream of file changes.

The stream is an append-only change log (path, content, op, at); the tree itself
cannot be streamed, since a changed file is not emitted again. Each micro-batch
is folded into the store in one version that carries the batch number, so a
repeated batch does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.names import language_of
from ..operators.resolve import resolve_all
from ..runtime import materialize
from ..sources.extract import extract, part
from ..sources.store import GraphStore
from ..sources.tree import IGNORED_DIRS


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last change of each path by ``at``; ignored folders and null paths left out."""
    kept = changes.where(F.col("path").isNotNull() & ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(d) for d in IGNORED_DIRS])))
    last = kept.groupBy("path").agg(F.max(F.struct("at", "op", "content")).alias("c"))
    return last.select("path", "c.op", "c.content")


def dependents(symbols: DataFrame, edges: DataFrame, changed: DataFrame, include_file_edges: bool = False) -> DataFrame:
    """Files one hop away: those of symbols with an edge to a symbol of a ``changed`` file (column path).

    Edges from file to file do not count unless ``include_file_edges``.
    """
    gone = changed.select("path").distinct()
    targets = symbols.join(gone, symbols.file_path == gone.path, "left_semi").select(F.col("qualified_name").alias("target"))
    sources = edges.join(targets.distinct(), "target", "left_semi").select("source").distinct()
    found = symbols.join(sources, symbols.qualified_name == sources.source, "left_semi").select(F.col("file_path").alias("path"))
    if include_file_edges:
        found = found.unionByName(edges.join(gone, edges.target == gone.path, "left_semi").select(F.col("source").alias("path")))
    return found.where(F.col("path").isNotNull()).distinct().join(gone, "path", "left_anti")


def apply_changes(store: GraphStore, changes: DataFrame, tree: DataFrame, batch: int, go_module: str | None = None) -> bool:
    """Fold one batch into the store; returns whether there was anything to do.

    Equal hashes are skipped. Changed files and their dependents are extracted
    anew and resolved against all files of the snapshot. ``tree`` (path,
    content) has the contents of files that did not change themselves.
    """
    done = store.last_batch()
    if done is not None and batch <= done:
        return False
    last, _ = materialize(latest_changes(changes), "changes")
    removed = last.where((F.col("op") == "delete") | F.col("content").isNull()).select("path")
    stored = store.read("files").select("path", F.col("hash").alias("held"))
    fresh = last.join(removed, "path", "left_anti").withColumn("hash", F.sha2("content", 256)).join(stored, "path", "left")
    fresh, _ = materialize(fresh.where(~F.col("hash").eqNullSafe(F.col("held"))).select("path", "content", "hash"), "fresh")
    if fresh.isEmpty() and removed.isEmpty():
        return False
    near = dependents(store.read("symbols"), store.read("edges"), fresh).join(removed, "path", "left_anti")
    again = tree.select("path", "content").join(near, "path", "left_semi").withColumn("hash", F.sha2("content", 256))
    sources, _ = materialize(fresh.unionByName(again), "to-parse")
    found, _ = materialize(extract(sources), "parsed")
    paths = store.read("files").select("path").join(removed, "path", "left_anti").unionByName(sources.select("path")).distinct()
    files = sources.join(found.select("path"), "path", "left_semi").select(
        "path", language_of(F.col("path")).alias("language"), "hash", F.unix_timestamp().alias("updated_at")
    )
    symbols = part(found, "symbols").drop("path")
    store.replace_files(files, symbols, resolve_all(found, paths, go_module), removed, batch)
    return True


def freshness(stored: DataFrame, tree: DataFrame) -> DataFrame:
    """How a tree (path, hash) differs from the ``stored`` files (path, hash): ``path, state`` with new, changed or removed; equal files have no row."""
    now = tree.where(F.col("path").isNotNull()).groupBy("path").agg(F.max("hash").alias("now"), F.lit(True).alias("is_there"))
    both = stored.select("path", F.col("hash").alias("held"), F.lit(True).alias("was_there")).join(now, "path", "full")
    state = F.when(F.col("was_there").isNull(), "new").when(F.col("is_there").isNull(), "removed").when(~F.col("now").eqNullSafe(F.col("held")), "changed")
    return both.select("path", state.alias("state")).where(F.col("state").isNotNull())


def ensure_fresh(store: GraphStore, tree: DataFrame, go_module: str | None = None) -> bool:
    """Bring the store up to date with ``tree`` (path, hash, content) before a query; returns whether anything had changed.

    Only what differs is read on, with its dependents; a fresh store costs one comparison of hashes.
    """
    stale, _ = materialize(freshness(store.read("files"), tree), "stale")
    if stale.isEmpty():
        return False
    touched = stale.join(tree.select("path", "content"), "path", "left")
    op = F.when(F.col("state") == "removed", "delete").otherwise("modify")
    last = store.last_batch()
    return apply_changes(store, touched.select("path", "content", op.alias("op"), F.lit(0).cast("long").alias("at")), tree, 0 if last is None else last + 1, go_module)


def watch(changes: DataFrame, store: GraphStore, tree: DataFrame, checkpoint: str, interval: str = "100 milliseconds", once: bool = False) -> StreamingQuery:
    """Run ``apply_changes`` on each micro-batch of the streaming ``changes``."""
    writer = changes.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.foreachBatch(lambda rows, batch: apply_changes(store, rows, tree, batch) and None).start()


def full_index(store: GraphStore, tree: DataFrame, go_module: str | None = None) -> int:
    """Index a whole tree (path, content) as a new snapshot; files that vanished are gone."""
    found, _ = materialize(extract(tree), "parsed")
    files = tree.join(found.select("path"), "path", "left_semi").select(
        "path", language_of(F.col("path")).alias("language"), F.sha2("content", 256).alias("hash"), F.unix_timestamp().alias("updated_at")
    )
    edges = resolve_all(found, tree.select("path"), go_module).withColumns(
        {"edge_id": F.xxhash64("kind", "source", "target"), "metadata": F.lit(None).cast("string")}
    )
    symbols = part(found, "symbols").drop("path")
    newest = symbols.groupBy("qualified_name").agg(F.max_by(F.struct(*[c for c in symbols.columns if c != "qualified_name"]), "line_start").alias("s"))
    return store.write({"files": files, "symbols": newest.select("qualified_name", "s.*"), "edges": edges})
