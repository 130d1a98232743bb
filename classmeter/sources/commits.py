"""Commit records: numbered JSON files, each written last, that say which folders make up a version.

Data is written to folders that no record names yet. A record appears under its
name by one rename, so a reader sees all that a version holds or nothing of it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class CommitLog:
    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder
        path = self._path("")
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{name}" if name else self._folder)

    def numbers(self) -> list[int]:
        """The numbers of all records, in order."""
        if not self._fs.exists(self._path("")):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(self._path(""))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_"))

    def last(self) -> int | None:
        return max(self.numbers(), default=None)

    def has(self, number: int) -> bool:
        return self._fs.exists(self._path(f"{number}.json"))

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{number}.json"))
        try:
            return json.loads(self._spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, number: int, record: dict) -> None:
        """Publish a record. A number is used once."""
        draft = self._path(f"_{number}-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(record).encode()))
        finally:
            stream.close()
        if self.has(number) or not self._fs.rename(draft, self._path(f"{number}.json")):
            self._fs.delete(draft, False)
            raise FileExistsError(f"version {number} of {self._folder} is there already")

    def forget(self, number: int) -> None:
        self._fs.delete(self._path(f"{number}.json"), False)

    def remove_folder(self, folder: str) -> None:
        """Delete a data folder that no record names any more."""
        self._fs.delete(self._spark._jvm.org.apache.hadoop.fs.Path(folder), True)

    def folder_exists(self, folder: str) -> bool:
        return self._fs.exists(self._spark._jvm.org.apache.hadoop.fs.Path(folder))
