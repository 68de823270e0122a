"""The current graph of symbols from the delivered feeds, and lookups on it.

Symbols and files come many times; a current row is the newest of its key,
found by an aggregation that combines before it shuffles, so a name of a tenth
of all rows is no hot spot. Edges are unique by (kind, source, target).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..model import confidence_rank, plain_key, snake_kind
from .incremental import digest, epoch_seconds

_NEVER = -(2**62)


def current_files(files: DataFrame) -> DataFrame:
    """``path, language, hash, updated_at``: the newest row of each path (by seconds, then load)."""
    stamp = epoch_seconds(F.col("updated_at"))
    order = F.struct(F.coalesce(stamp, F.lit(_NEVER)).alias("s"), F.coalesce("load_id", F.lit(_NEVER)).alias("l"), digest(F.col("hash")).alias("h"), F.col("language").alias("g"))
    newest = files.where(F.col("path").isNotNull()).groupBy("path").agg(F.max(order).alias("o"))
    return newest.select("path", F.col("o.g").alias("language"), F.col("o.h").alias("hash"), F.nullif(F.col("o.s"), F.lit(_NEVER)).alias("updated_at"))


def current_symbols(symbols: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per qualified name: the newest (by seconds, then ``symbol_id``); ``columns`` limits what is carried along."""
    wanted = columns or [
        "name", "kind", "file_path", "line_start", "line_end", "visibility", "is_exported", "is_async", "is_test", "decorators", "signature",
    ]
    stamp = F.coalesce(epoch_seconds(F.col("updated_at")), F.lit(_NEVER))
    row = F.struct(stamp.alias("s"), F.col("symbol_id"), *[F.col(c) for c in wanted])
    newest = symbols.where(F.col("qualified_name").isNotNull()).groupBy("qualified_name").agg(F.max(row).alias("o"))
    out = newest.select("qualified_name", *[F.col(f"o.{c}") for c in wanted])
    return out.withColumn("file_path", plain_key(F.col("file_path"))) if "file_path" in wanted else out


def current_edges(edges: DataFrame) -> DataFrame:
    """``edge_id, kind, source, target`` with plain keys and store names, both ends present, unique by the last three."""
    plain = edges.select(
        "edge_id", snake_kind(F.col("kind")).alias("kind"), plain_key(F.col("source")).alias("source"), plain_key(F.col("target")).alias("target")
    ).dropna(subset=["kind", "source", "target"])
    return plain.groupBy("kind", "source", "target").agg(F.min("edge_id").alias("edge_id")).select("edge_id", "kind", "source", "target")


def at_least(edges: DataFrame, rank: int) -> DataFrame:
    """Edges of at least a confidence rank (0 structural to 3 high)."""
    return edges.where(confidence_rank(F.col("kind")) >= rank)


def find_by_name(symbols: DataFrame, pattern: str) -> DataFrame:
    """Symbols named exactly ``pattern``; if there are none, those whose name starts with it without regard to ASCII case."""
    exact = symbols.where(F.col("name") == pattern)
    ascii_lower = F.translate("name", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lowered = "".join(c.lower() if c.isascii() else c for c in pattern)
    both = symbols.where((F.col("name") == pattern) | F.startswith(ascii_lower, F.lit(lowered)))
    ranked = both.withColumn("phase", F.when(F.col("name") == pattern, 0).otherwise(1))
    best = exact.limit(1).select(F.lit(0).alias("best")).agg(F.coalesce(F.min("best"), F.lit(1)).alias("phase"))
    return ranked.join(F.broadcast(best), "phase").drop("phase")


def references_to(edges: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """Edges that point to ``name`` (of one kind, or all)."""
    found = edges.where(F.col("target") == name)
    return found.where(F.col("kind") == kind) if kind else found


def references_from(edges: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    found = edges.where(F.col("source") == name)
    return found.where(F.col("kind") == kind) if kind else found


def symbols_of_files(symbols: DataFrame, paths: DataFrame) -> DataFrame:
    """Symbols whose file is among ``paths`` (column path)."""
    return symbols.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi")


def first_names(edges: DataFrame, key: str, other: str, keep: int = 3) -> DataFrame:
    """Per ``key``: number of edges and the ``keep`` ends of lowest edge id, joined by ``, ``.

    Candidates are cut to ``keep`` in every partial aggregate, so a hot key never gathers its edges.
    """
    salted = edges.groupBy(F.col(key).alias("k"), F.pmod(F.col("edge_id"), F.lit(64)).alias("salt")).agg(
        F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_list(F.struct("edge_id", F.col(other).alias("o")))), 1, keep).alias("few")
    )
    merged = salted.groupBy("k").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("few"))), 1, keep).alias("few"))
    return merged.select("k", "n", F.array_join(F.transform("few", lambda x: x["o"]), ", ").alias("names"))


def find_cards(symbols: DataFrame, edges: DataFrame, pattern: str) -> DataFrame:
    """``find_by_name`` with number and first three of callers, callees and tests of each hit."""
    hits = find_by_name(symbols, pattern).select("qualified_name", "kind", "file_path")
    calls, tests = edges.where(F.col("kind") == "calls"), edges.where(F.col("kind") == "tested_by")
    sides = (("callers", calls, "target", "source"), ("callees", calls, "source", "target"), ("tests", tests, "target", "source"))
    for label, side, key, other in sides:
        near = side.join(hits.select(F.col("qualified_name").alias(key)), key, "left_semi")
        found = first_names(near, key, other).select(F.col("k").alias("qualified_name"), F.col("n").alias(f"n_{label}"), F.col("names").alias(label))
        hits = hits.join(found, "qualified_name", "left").fillna(0, [f"n_{label}"]).fillna("", [label])
    return hits


def changed_symbols(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """Symbols that overlap a diff hunk of their file (a range semi-join on the file).

    A hunk covers ``new_count`` lines from ``new_start``; one without new lines
    (a deletion) covers its start line. ``hunks``: file, new_start, new_count.
    """
    spans = hunks.select(
        F.col("file").alias("h_file"),
        F.col("new_start").alias("h_start"),
        (F.col("new_start") + F.greatest(F.col("new_count"), F.lit(1)) - 1).alias("h_end"),
    )
    overlap = (F.col("file_path") == F.col("h_file")) & (F.col("line_start") <= F.col("h_end")) & (F.col("h_start") <= F.col("line_end"))
    return symbols.join(spans, overlap, "left_semi")


def table_counts(**tables: DataFrame) -> DataFrame:
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)
