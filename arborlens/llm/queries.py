"""Queries of problems 3, 6, 7 and 8, over the whole tables.

Judgement of sources and sizes in tokens have no SQL; tests use labelled
fixtures and brute force. What must hold of any packing, mixture or cut can be
said in SQL: the queries ``*_checks`` measure it over the whole results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..runtime import materialize
from ..sources.tables import read_table
from .evidence import HouseStyle
from .handwritten import classify_sources
from .mixing import document_sizes, mix, share_report
from .packing import fill_report, pack_texts
from .splitting import CutLimit, split_texts


#: The house whose tree the tables describe.
HOUSE = HouseStyle(("Marrowfield Works",))


def _languages(spark: SparkSession, sf: str) -> DataFrame:
    """The language last delivered for each path."""
    files = read_table(spark, sf, "files").where(F.col("path").isNotNull() & F.col("language").isNotNull())
    return files.groupBy("path").agg(F.max(F.struct("load_id", "updated_at", "language"))["language"].alias("language"))


def not_handwritten(spark: SparkSession, sf: str) -> DataFrame:
    labels = classify_sources(read_table(spark, sf, "sources"), HOUSE, _languages(spark, sf))
    return labels.where(F.col("label") != "handwritten").select("path")


def source_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Label of every source with the language last delivered for its path."""
    languages = _languages(spark, sf)
    labels = classify_sources(read_table(spark, sf, "sources"), HOUSE, languages)
    return labels.join(languages, "path", "left").select("path", F.lower("language").alias("language"), "label", "p_handwritten")


def _limits(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return read_table(spark, sf, "size_limits").where(F.startswith(F.col("limit_name"), F.lit(kind)))


def packed(spark: SparkSession, sf: str) -> DataFrame:
    return pack_texts(read_table(spark, sf, "documents"), _limits(spark, sf, "pack_"))


def packing_fill(spark: SparkSession, sf: str) -> DataFrame:
    return fill_report(packed(spark, sf), _limits(spark, sf, "pack_"))


def mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mix(document_sizes(read_table(spark, sf, "documents")), read_table(spark, sf, "mix_targets"))[0]


def mixture_shares(spark: SparkSession, sf: str) -> DataFrame:
    mixed, plan = mix(document_sizes(read_table(spark, sf, "documents")), read_table(spark, sf, "mix_targets"))
    return share_report(mixed, plan)


def pieces(spark: SparkSession, sf: str) -> DataFrame:
    limits = [CutLimit(r["limit_name"], r["max_tokens"], r["overlap_tokens"]) for r in _limits(spark, sf, "cut_").collect()]
    return split_texts(read_table(spark, sf, "documents"), limits)


def packing_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Per capacity: texts placed, and how many are broken up needlessly or have gaps, and how many containers are overfull or overlap."""
    placed, _ = materialize(packed(spark, sf), "packed-all")
    limits = _limits(spark, sf, "pack_").select("limit_name", "max_tokens")
    texts = placed.groupBy("limit_name", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("size"), F.max(F.col("start_token") + F.col("n_tokens")).alias("upto"))
    needed = F.greatest(F.ceil(F.col("size") / F.col("max_tokens")), F.lit(1))
    texts = texts.join(limits, "limit_name").groupBy("limit_name").agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if(F.col("n") != needed).alias("n_broken_up"), F.count_if(F.col("size") != F.col("upto")).alias("n_with_gaps")
    )
    bins = placed.groupBy("limit_name", "container_id").agg(F.sum("n_tokens").alias("size"), F.max(F.col("container_offset") + F.col("n_tokens")).alias("upto"))
    bins = bins.join(limits, "limit_name").groupBy("limit_name").agg(
        F.count_if(F.col("size") > F.col("max_tokens")).alias("n_overfull"), F.count_if(F.col("size") != F.col("upto")).alias("n_overlapping")
    )
    return texts.join(bins, "limit_name")


def mixture_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Per target source: its share of the mixture and the texts that are repeated too often."""
    mixed, plan = mix(document_sizes(read_table(spark, sf, "documents")), read_table(spark, sf, "mix_targets"))
    mixed, _ = materialize(mixed, "mixed-all")
    shares = share_report(mixed, plan).select("source", "max_repeats", F.round(F.coalesce("actual_share", F.lit(0.0)), 2).alias("share"))
    used = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n")).join(shares.select("source", "max_repeats"), "source")
    often = used.groupBy("source").agg(F.count_if(F.col("n") > F.col("max_repeats")).alias("n_repeated_too_often"))
    return shares.join(often, "source", "left").select("source", "share", F.coalesce("n_repeated_too_often", F.lit(0)).alias("n_repeated_too_often"))


def piece_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Per limit: texts of more words than tokens allowed that were cut, and pieces that break a rule."""
    cut, _ = materialize(pieces(spark, sf), "pieces-all")
    limits = _limits(spark, sf, "cut_").select("limit_name", "max_tokens")
    texts = read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("whole"))
    both = cut.join(texts, "doc_id").join(limits, "limit_name")
    after = Window.partitionBy("limit_name", "doc_id").orderBy("piece")
    both = both.withColumns({"before": F.lag("end_char").over(after), "next": F.lead("piece").over(after)})
    gap = F.when(F.col("before").isNull(), F.col("start_char") > 0).otherwise((F.col("start_char") > F.col("before")) | (F.col("end_char") <= F.col("before")))
    bad = both.groupBy("limit_name").agg(
        F.count_if(F.col("n_tokens") > F.col("max_tokens")).alias("n_too_long"),
        F.count_if(gap | (F.col("next").isNull() & (F.col("end_char") != F.char_length("whole")))).alias("n_gaps"),
        F.count_if(F.col("text") != F.substr("whole", (F.col("start_char") + 1).cast("int"), (F.col("end_char") - F.col("start_char")).cast("int"))).alias("n_other_text"),
    )
    words = both.select("limit_name", "doc_id", "max_tokens", "whole").dropDuplicates(["limit_name", "doc_id"])
    long = words.groupBy("limit_name").agg(F.count_if(F.size(F.regexp_extract_all("whole", F.lit(r"[^ \t\n\r]+"), 0)) > F.col("max_tokens")).alias("n_long_cut"))
    return bad.join(long, "limit_name")


QUERIES = {
    "p3_found": not_handwritten,
    "p3_labels": source_labels,
    "p6_containers": packed,
    "p6_fill": packing_fill,
    "p7_mixture": mixture,
    "p7_shares": mixture_shares,
    "p8_pieces": pieces,
    "p6_checks": packing_checks,
    "p7_checks": mixture_checks,
    "p8_checks": piece_checks,
}
ORACLE: dict[str, str] = {
    "p6_checks": """
SELECT limit_name, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n_texts, 0 AS n_broken_up, 0 AS n_with_gaps, 0 AS n_overfull, 0 AS n_overlapping
FROM size_limits WHERE starts_with(limit_name, 'pack_')""",
    "p7_checks": """
WITH own AS (SELECT DISTINCT replace(lower(trim(source)), '-', '_') AS source FROM documents WHERE text <> ''),
t AS (SELECT m.source, CASE WHEN o.source IS NULL THEN 0 ELSE m.target_share END AS w FROM mix_targets m LEFT JOIN own o ON o.source = m.source)
SELECT source, round(w / sum(w) OVER (), 2) AS share, 0 AS n_repeated_too_often FROM t""",
    "p8_checks": """
SELECT l.limit_name, 0 AS n_too_long, 0 AS n_gaps, 0 AS n_other_text,
  (SELECT count(*) FROM documents WHERE len(regexp_extract_all(text, '[^ \t\n\r]+')) > l.max_tokens) AS n_long_cut
FROM size_limits l WHERE starts_with(l.limit_name, 'cut_')""",
}
