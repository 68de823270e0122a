"""A source tree as tables: files with content, hash and language, without what is ignored."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.names import extension, glob_pattern, language_of
from .changes import SUPPORTED

# Folders that are never read.
IGNORED_DIRS = [".git", "target", "node_modules"]


def project_root(start: str, marks: tuple[str, ...] = (".git",)) -> str | None:
    """The nearest folder at or above ``start`` that holds one of ``marks``."""
    here = Path(start).resolve()
    return next((str(folder) for folder in (here, *here.parents) if any((folder / mark).exists() for mark in marks)), None)


def current_head(root: str) -> str | None:
    """The commit that the working tree below ``root`` is at, read from the version control's files; None without any."""
    folder = Path(root) / ".git"
    if not (folder / "HEAD").is_file():
        return None
    head = (folder / "HEAD").read_text().strip()
    if not head.startswith("ref: "):
        return head
    name = head.removeprefix("ref: ")
    if (folder / name).is_file():
        return (folder / name).read_text().strip()
    packed = folder / "packed-refs"
    listed = packed.read_text().splitlines() if packed.is_file() else []
    return next((line.split(" ", 1)[0] for line in listed if line.endswith(f" {name}")), None)


def ignore_rules(lines: list[str]) -> list[tuple[bool, str]]:
    """Ignore-file lines as (keep, pattern) in order: ``!`` keeps, a slash inside anchors, a slash at the end means a folder."""
    rules = []
    for line in lines:
        rule = line.rstrip("\r\n").rstrip()
        if not rule or rule.startswith("#"):
            continue
        keep, rule = rule.startswith("!"), rule.lstrip("!")
        folder, anchored = rule.endswith("/"), "/" in rule.rstrip("/")
        body = glob_pattern(rule.strip("/"))[1:-1].replace(".*", "[^/]*") if "**" not in rule else glob_pattern(rule.strip("/"))[1:-1]
        rules.append((keep, ("^" if anchored else "^(?:.*/)?") + body + ("/.*" if folder else "(?:/.*)?") + "$"))
    return rules


def scan_tree(spark: SparkSession, root: str, ignore: list[str] | None = None, extensions: list[str] = SUPPORTED) -> DataFrame:
    """``path, language, hash, content`` of the files below ``root``; paths relative to it.

    Content that is no UTF-8 is kept as it is in bytes. Ignored are the fixed
    folders and what the last matching ignore rule excludes.
    """
    glob = "*.{" + ",".join(extensions) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = "file:" + root.rstrip("/") if root.startswith("/") else root.rstrip("/")
    path = F.regexp_replace(F.col("path"), "^" + "file:/+", "file:/")
    start = len(base.replace("file:///", "file:/")) + 2
    rows = raw.select(F.substr(path, F.lit(start)).alias("path"), "content")
    rows = rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(d) for d in IGNORED_DIRS])))
    ignored = F.lit(False)
    for keep, pattern in ignore_rules(ignore or []):
        ignored = F.when(F.col("path").rlike(pattern), F.lit(not keep)).otherwise(ignored)
    rows = rows.where(~ignored & extension(F.col("path")).isin(extensions))
    return rows.select("path", language_of(F.col("path")).alias("language"), F.sha2("content", 256).alias("hash"), "content")
