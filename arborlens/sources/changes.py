"""Texts of version control: unified diffs and status lists, parsed in the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

SUPPORTED = ["ts", "tsx", "js", "jsx", "rs", "py", "go"]
_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """Hunks of unified diffs (diff_id, text): ``diff_id, file, old_start, old_count, new_start, new_count``.

    The file is the new one, of a rename the target. A missing count is 1. A
    malformed hunk header, or one before any file, is an error when the result
    is computed. Null texts have no hunks.
    """
    lines = diffs.select("diff_id", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    named = F.when(F.startswith("line", F.lit("diff --git ")), F.substring_index("line", " b/", -1)).when(
        F.startswith("line", F.lit("rename to ")), F.substr("line", F.lit(11))
    )
    before = Window.partitionBy("diff_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("file", F.last(named, ignorenulls=True).over(before)).where(F.startswith("line", F.lit("@@ ")))
    whole = F.col("line").rlike(_HEADER)
    checked = (
        F.when(~whole, F.raise_error(F.concat(F.lit("malformed hunk header: "), "line")))
        .when(F.col("file").isNull(), F.raise_error(F.lit("hunk header before any file")))
        .otherwise(F.col("file"))
    )

    def number(group: int):
        text = F.regexp_extract("line", _HEADER, group)
        return F.when(text == "", F.lit(1)).otherwise(F.try_to_number(text, F.lit("99999999999999"))).cast("long")

    return placed.select("diff_id", checked.alias("file"), number(1).alias("old_start"), number(2).alias("old_count"), number(3).alias("new_start"), number(4).alias("new_count"))


def changed_paths(lists: DataFrame) -> DataFrame:
    """Non-empty lines of path lists (list_id, text): ``list_id, path``."""
    lines = lists.select("list_id", F.explode(F.split("text", r"\r?\n")).alias("path"))
    return lines.where(F.trim("path") != "")


def modified_paths(statuses: DataFrame) -> DataFrame:
    """Paths of short status lists (list_id, text) with a supported extension; of a rename the new path."""
    lines = statuses.select("list_id", F.explode(F.split("text", r"\r?\n")).alias("line")).where(F.length("line") >= 4)
    rest = F.substr("line", F.lit(4))
    path = F.trim(F.when(F.startswith("line", F.lit("R")), F.substring_index(rest, " -> ", -1)).otherwise(rest))
    found = lines.select("list_id", path.alias("path"))
    return found.where(F.regexp_extract("path", r"[^/]\.([^./]*)$", 1).isin(SUPPORTED))
