"""Atomic commits: numbered files, each put in place by a rename that fails if the
number is taken."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer committed first."""


class Commits:
    """Numbered JSON files in one folder; the highest number is current."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = jvm.Path(self.path).getFileSystem(self._conf)

    def latest(self) -> tuple[int, dict]:
        """The number and content of the last commit; -1 if there is none."""
        folder = self._path(self.path)
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return -1, {}
        with_text = self.spark.read.option("wholetext", True).text(f"{self.path}/{max(numbers):010d}")
        return max(numbers), json.loads(with_text.first()[0])

    def put(self, number: int, content: dict) -> None:
        """Commits ``content`` as ``number``; raises Conflict if that exists."""
        jvm = self.spark._jvm
        self._fs.mkdirs(self._path(self.path))
        staged, final = self._path(f"{self.path}/.{uuid.uuid4().hex}"), self._path(f"{self.path}/{number:010d}")
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(staged, final, none)
        except Exception as e:
            self._fs.delete(staged, False)
            if self._fs.exists(final):
                raise Conflict(f"commit {number} of {self.path} exists") from e
            raise

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def folders(self, path: str) -> list[str]:
        folder = self._path(path)
        return [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
