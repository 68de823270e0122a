"""A numbered log of small JSON manifests, with an atomic commit.

A version is published by a rename that fails if its number is taken, so of two
writers one wins and the other learns of it; readers see a whole version or
none. This needs a file system whose rename is atomic and does not overwrite:
local disks and HDFS. Object stores copy instead, so they are refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class VersionConflict(RuntimeError):
    """Another writer published this version first."""


# Schemes of file systems with an atomic rename.
ATOMIC_SCHEMES = ["file", "hdfs", "viewfs"]


class VersionLog:
    """Manifests below ``root``; ``schemes`` are the file systems trusted to rename atomically."""

    def __init__(self, spark: SparkSession, root: str, schemes: list[str] = ATOMIC_SCHEMES):
        self._jvm = spark.sparkContext._jvm
        self._new_array = spark.sparkContext._gateway.new_array
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._root = f"{root.rstrip('/')}/manifests"
        self._fs = self._path(self._root).getFileSystem(self._conf)
        scheme = self._fs.getUri().getScheme()
        if scheme not in schemes:
            raise ValueError(f"{scheme}: versions need a file system with an atomic rename ({', '.join(schemes)})")
        self._fs.mkdirs(self._path(self._root))

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def names(self, folder: str) -> list[str]:
        """What lies in a folder; nothing if it does not exist."""
        place = self._path(folder)
        return [status.getPath().getName() for status in self._fs.listStatus(place)] if self._fs.exists(place) else []

    def newest(self) -> tuple[int, dict | None]:
        """Number and content of the newest version; ``(0, None)`` before the first."""
        numbers = [int(n[1:-5]) for n in self.names(self._root) if n.startswith("v") and n.endswith(".json")]
        return (max(numbers), self.read(max(numbers))) if numbers else (0, None)

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self._root}/v{number}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, number: int, content: dict) -> None:
        staged = self._path(f"{self._root}/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(staged)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        final = self._path(f"{self._root}/v{number}.json")
        options = self._new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(staged, final, options)
        except Exception as error:
            taken = self._fs.exists(final)
            self._fs.delete(staged, False)
            if taken:
                raise VersionConflict(f"version {number} exists") from error
            raise
