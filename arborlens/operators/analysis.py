"""Entry points, dead code, coupling, test gaps, sensitivity and risk over the current graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import matches_any, segments
from ..model import HIGH_KINDS, USAGE_KINDS, DeadCodeConfig, FlowConfig, RiskConfig, confidence_rank
from ..runtime import numbered

# What marks an entry point.
CALLABLE_KINDS = ["function", "method", "class", "struct"]
HTTP_MARKS = ["get", "post", "put", "delete", "patch", "app.route", "router.get", "router.post", "api_view", "route"]
CLI_MARKS = ["command", "subcommand", "clap", "parser"]


def _decorated(marks: list[str], fold: bool = True) -> Column:
    def hit(d: Column) -> Column:
        text = F.lower(d) if fold else d
        return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks])

    return F.coalesce(F.exists("decorators", lambda d: F.coalesce(hit(d), F.lit(False))), F.lit(False))


def entry_points(symbols: DataFrame, edges: DataFrame, config: FlowConfig = FlowConfig()) -> DataFrame:
    """``qualified_name, entry_kind, confidence, n_out``: where execution starts.

    Main before test before HTTP handler before command before public root. Of
    the public roots (exported public callables nobody calls, and the extra
    ones) the ``max_public_roots`` with most high-confidence edges stay, ties by
    name. Null flags count as false.
    """
    name = F.lower("name")
    called = edges.where(F.col("kind") == "calls").select(F.col("target").alias("qualified_name")).distinct()
    out = edges.where(F.col("kind").isin(HIGH_KINDS)).groupBy(F.col("source").alias("qualified_name")).agg(F.count(F.lit(1)).alias("n_out"))
    extra = F.col("qualified_name").isin(list(config.extra_entry_patterns)) if config.extra_entry_patterns else F.lit(False)
    rows = symbols
    if config.excluded_entry_patterns:
        rows = rows.where(~F.col("qualified_name").isin(list(config.excluded_entry_patterns)))
    rows = rows.join(called.withColumn("is_called", F.lit(True)), "qualified_name", "left").join(out, "qualified_name", "left")
    root = (
        F.coalesce("is_exported", F.lit(False))
        & F.coalesce(F.col("visibility") == "public", F.lit(False))
        & F.col("kind").isin(CALLABLE_KINDS)
        & F.col("is_called").isNull()
    )
    kind = (
        F.when((name == "main") | _decorated(["tokio::main"], fold=False), "main")
        .when(F.coalesce("is_test", F.lit(False)) | (F.col("kind") == "test") | F.startswith(name, F.lit("test_")), "test")
        .when(_decorated(HTTP_MARKS), "http_handler")
        .when(_decorated(CLI_MARKS), "cli_command")
        .when(extra | root, "public_root")
    )
    weak_test = ~(F.coalesce("is_test", F.lit(False)) | (F.col("kind") == "test"))
    sure = F.when(F.col("entry_kind") == "public_root", 0.7).when((F.col("entry_kind") == "test") & weak_test, 0.9).otherwise(1.0)
    found = rows.withColumn("entry_kind", kind).where(F.col("entry_kind").isNotNull())
    found = found.select("qualified_name", "entry_kind", sure.alias("confidence"), F.coalesce("n_out", F.lit(0)).cast("long").alias("n_out"))
    roots = found.where(F.col("entry_kind") == "public_root").orderBy(F.desc("n_out"), "qualified_name").limit(config.max_public_roots)
    return found.where(F.col("entry_kind") != "public_root").unionByName(roots)


def dead_layers(symbols: DataFrame, edges: DataFrame, config: DeadCodeConfig = DeadCodeConfig()) -> DataFrame:
    """Every symbol with its ``layer``: alive, or the first exclusion that holds, or dead."""
    used = edges.where(F.col("kind").isin(USAGE_KINDS)).select(F.col("target").alias("qualified_name")).distinct()
    entries = entry_points(symbols, edges).where(F.col("entry_kind") != "test").select("qualified_name")
    rows = symbols.join(used.withColumn("is_used", F.lit(True)), "qualified_name", "left")
    rows = rows.join(entries.withColumn("is_entry", F.lit(True)), "qualified_name", "left")
    layer = (
        F.when(F.col("is_used").isNotNull(), "alive")
        .when(F.col("is_entry").isNotNull() | matches_any(F.col("qualified_name"), config.entry_patterns), "entry_point")
        .when(F.coalesce("is_exported", F.lit(False)), "exported")
        .when(F.coalesce("is_test", F.lit(False)) & F.lit(not config.include_tests), "test")
        .when(matches_any(F.col("file_path"), config.migration_globs), "migration")
        .when(matches_any(F.col("qualified_name"), config.exclude_globs) | matches_any(F.col("file_path"), config.exclude_globs), "pattern")
        .otherwise("dead")
    )
    return rows.select("qualified_name", "kind", "file_path", "line_start", "visibility", layer.alias("layer"))


def dead_code(layers: DataFrame, config: DeadCodeConfig = DeadCodeConfig()) -> DataFrame:
    found = layers.where(F.col("layer") == "dead").drop("layer")
    return found.where(F.col("kind").isin(list(config.kind_filter))) if config.kind_filter else found


def dead_summary(layers: DataFrame) -> DataFrame:
    dead, kept = F.count_if(F.col("layer") == "dead"), F.count_if(~F.col("layer").isin("dead", "alive"))
    total = F.count(F.lit(1))
    share = F.coalesce(F.round(F.try_divide(dead, total) * 100, 6), F.lit(0.0))
    return layers.agg(total.alias("total_symbols"), dead.alias("dead_count"), kept.alias("excluded_count"), share.alias("dead_percentage"))


def coupling(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``qualified_name, degree, coupling``: edges above structural between known symbols, both directions, over the largest degree."""
    names = symbols.select("qualified_name")
    inner = edges.where(confidence_rank(F.col("kind")) > 0)
    for end in ("source", "target"):
        inner = inner.join(names.select(F.col("qualified_name").alias(end)), end, "left_semi")
    ends = inner.select(F.explode(F.array("source", "target")).alias("qualified_name"))
    degrees = ends.groupBy("qualified_name").agg(F.count(F.lit(1)).alias("degree"))
    rows = names.join(degrees, "qualified_name", "left").fillna(0, ["degree"])
    top = degrees.agg(F.coalesce(F.max("degree"), F.lit(0)).alias("top")).withColumn("one", F.lit(1))
    both = rows.withColumn("one", F.lit(1)).join(F.broadcast(top), "one")
    return both.select("qualified_name", "degree", F.coalesce(F.try_divide("degree", "top"), F.lit(0.0)).alias("coupling"))


def test_gaps(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``qualified_name, test_gap``: 0 if a tested_by edge points to the symbol, else 1."""
    tested = edges.where(F.col("kind") == "tested_by").select(F.col("target").alias("qualified_name")).distinct()
    rows = symbols.select("qualified_name").join(tested.withColumn("t", F.lit(0.0)), "qualified_name", "left")
    return rows.select("qualified_name", F.coalesce("t", F.lit(1.0)).alias("test_gap"))


def sensitivity(symbols: DataFrame, patterns: tuple[str, ...] = RiskConfig.patterns) -> DataFrame:
    """``qualified_name, sensitivity``: 1 if a segment of name or decorators starts with a pattern."""
    if not patterns:
        return symbols.select("qualified_name", F.lit(0.0).alias("sensitivity"))
    parts = F.concat(segments(F.col("qualified_name")), F.flatten(F.transform(F.coalesce("decorators", F.array().cast("array<string>")), lambda d: segments(F.coalesce(d, F.lit(""))))))
    hit = F.exists(parts, lambda s: reduce(lambda a, b: a | b, [F.startswith(s, F.lit(p.lower())) for p in patterns]))
    return symbols.select("qualified_name", F.when(hit, 1.0).otherwise(0.0).alias("sensitivity"))


def risk_scores(symbols: DataFrame, edges: DataFrame, criticality: DataFrame | None = None, config: RiskConfig = RiskConfig()) -> DataFrame:
    """Composite risk of every symbol and its four parts; ``criticality`` (qualified_name, criticality) defaults to 0."""
    w = config.weights()
    rows = symbols.select("qualified_name", "file_path")
    rows = rows.join(coupling(symbols, edges).drop("degree"), "qualified_name").join(test_gaps(symbols, edges), "qualified_name")
    rows = rows.join(sensitivity(symbols, config.patterns), "qualified_name")
    if criticality is None:
        rows = rows.withColumn("criticality", F.lit(0.0))
    else:
        rows = rows.join(criticality, "qualified_name", "left").fillna(0.0, ["criticality"])
    parts = ("criticality", "coupling", "test_gap", "sensitivity")
    total = reduce(lambda a, b: a + b, [F.col(p) * F.lit(x) for p, x in zip(parts, w)])
    scored = rows.withColumn("composite", F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))
    return scored.where(F.col("composite") >= config.min_score) if config.min_score > 0 else scored


def risk_files(scores: DataFrame) -> DataFrame:
    """Per file: greatest composite, number of symbols, and the symbol behind it (ties by name; none if all are 0)."""
    best = F.min(F.struct(-F.col("composite"), F.col("qualified_name")))["qualified_name"]
    by = scores.groupBy("file_path").agg(F.max("composite").alias("max_risk"), F.count(F.lit(1)).alias("n_symbols"), best.alias("driver"))
    return by.withColumn("driver", F.when(F.col("max_risk") > 0, F.col("driver")).otherwise(""))


def risk_stats(scores: DataFrame) -> DataFrame:
    """Number of symbols and files, mean, median and p90 (the value at position ceil(0.9 n), counted from 0, at most the last).

    The order statistics are exact: scores are numbered in order, and the wanted positions picked.
    """
    totals = scores.agg(
        F.count(F.lit(1)).alias("symbols_scored"),
        F.count_distinct("file_path").alias("files_scored"),
        F.coalesce(F.round(F.avg("composite"), 6), F.lit(0.0)).alias("avg_risk"),
    ).withColumn("one", F.lit(1))
    n = F.col("symbols_scored")
    placed = numbered(scores.select("composite"), ["composite"], "at", first=0).withColumn("one", F.lit(1)).join(F.broadcast(totals), "one")

    def value_at(position: Column) -> Column:
        return F.min(F.when(F.col("at") == position, F.col("composite")))

    picked = placed.agg(
        ((value_at(F.floor((n - 1) / 2)) + value_at(F.floor(n / 2))) / 2).alias("median"), value_at(F.least(F.ceil(n * 0.9), n - 1)).alias("p90")
    )
    both = totals.join(picked.withColumn("one", F.lit(1)), "one").drop("one")
    rounded = {"median_risk": F.coalesce(F.round("median", 6), F.lit(0.0)), "p90_risk": F.coalesce(F.round("p90", 6), F.lit(0.0))}
    return both.withColumns(rounded).drop("median", "p90")
