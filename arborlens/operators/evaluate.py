"""Quality of search and impact results against expected answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def reciprocal_ranks(results: DataFrame, expected: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, reciprocal_rank``: 1 / position of the first expected item, 0 without one.

    ``results``: query_id, position (from 1), item; ``expected``: query_id, item; ``queries``: query_id.
    """
    hits = results.join(expected.select("query_id", "item").distinct(), ["query_id", "item"]).groupBy("query_id").agg(F.min("position").alias("p"))
    both = queries.select("query_id").distinct().join(hits, "query_id", "left")
    return both.select("query_id", F.coalesce(F.lit(1.0) / F.col("p"), F.lit(0.0)).alias("reciprocal_rank"))


def precision_at(results: DataFrame, expected: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, precision``: share of the first ``k`` results that are expected, of as many as were returned; 0 for none."""
    first = results.where(F.col("position") <= k)
    marked = first.join(expected.select("query_id", "item").distinct().withColumn("good", F.lit(1)), ["query_id", "item"], "left")
    by = marked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"))
    both = queries.select("query_id").distinct().join(by, "query_id", "left")
    return both.select("query_id", F.coalesce(F.try_divide("good", "n"), F.lit(0.0)).alias("precision"))


def blast_scores(predicted: DataFrame, expected: DataFrame, scenarios: DataFrame) -> DataFrame:
    """``scenario, precision, recall``: predicted against expected nodes, both lists as they come; 0 where a side is empty."""
    truth = expected.select("scenario", "node").distinct()
    good = predicted.join(truth.withColumn("good", F.lit(1)), ["scenario", "node"], "left").groupBy("scenario")
    good = good.agg(F.count(F.lit(1)).alias("n_predicted"), F.sum("good").alias("n_good"))
    wanted = expected.groupBy("scenario").agg(F.count(F.lit(1)).alias("n_expected"))
    both = scenarios.select("scenario").distinct().join(good, "scenario", "left").join(wanted, "scenario", "left")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return both.select("scenario", share("n_good", "n_predicted").alias("precision"), share("n_good", "n_expected").alias("recall"))


def macro_f1(scores: DataFrame) -> DataFrame:
    """Mean precision and recall over scenarios, and F1 of the two means."""
    means = scores.agg(F.coalesce(F.avg("precision"), F.lit(0.0)).alias("precision"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return means.withColumn("f1", f1)


def category_means(per_query: DataFrame, categories: DataFrame, measure: str) -> DataFrame:
    """Mean of a measure by category (query_id, category; missing counts as ``uncategorized``) and over all, ``target`` in the report."""
    named = per_query.join(categories.select("query_id", "category"), "query_id", "left").fillna("uncategorized", ["category"])
    return named.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg(measure).alias(f"mean_{measure}"))


def ranked(results: DataFrame, query: str, item: str, score: str) -> DataFrame:
    """``query_id, item, position`` of scored results; ties by item."""
    place = Window.partitionBy(query).orderBy(F.desc(score), item)
    return results.select(F.col(query).alias("query_id"), F.col(item).alias("item"), F.row_number().over(place).alias("position"))


def unknown_expectations(expected: DataFrame, symbols: DataFrame) -> DataFrame:
    """Expected items that are no current symbol: mistakes of the ground truth."""
    return expected.join(symbols.select(F.col("qualified_name").alias("item")), "item", "left_anti")
