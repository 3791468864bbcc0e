"""Tables that are replaced as a whole, without a moment in which there is none.

A store is a folder with ``data/<uuid>`` (Parquet, never changed) and ``versions/<number>``, small files that
each name the data of one version. A writer puts its data down first and then creates the file of the
version after the one that it read, which succeeds for one writer only. Whatever breaks off earlier leaves the
last version as it was; readers keep reading the version that they began with.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer has made the next version."""


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.java = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.java.org.apache.hadoop.fs.Path("/".join([self.path, *parts]) if parts != ("",) else self.path)

    def versions(self) -> list[int]:
        at = self._path("versions")
        return sorted(int(s.getPath().getName()) for s in self.fs.listStatus(at) if s.getPath().getName().isdigit()) if self.fs.exists(at) else []

    def version(self) -> int:
        """The newest version's number; 0: nothing was written yet."""
        return max(self.versions(), default=0)

    def _data(self, version: int) -> str:
        stream = self.fs.open(self._path("versions", f"{version:020d}"))
        try:
            return bytes(stream.readNBytes(64)).decode()
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """The newest version, or the one asked for; None where nothing was written."""
        version = self.version() if version is None else version
        return self.spark.read.parquet(f"{self.path}/data/{self._data(version)}") if version else None

    def stage(self, rows: DataFrame) -> str:
        """Put data down that no version names yet."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        return name

    def publish(self, name: str, seen: int) -> int:
        """Make staged data the version after ``seen``; a Conflict if there is one already."""
        self.fs.mkdirs(self._path("versions"))
        draft, goal = self._path("versions", f".{name}"), self._path("versions", f"{seen + 1:020d}")
        out = self.fs.create(draft, True)
        try:
            out.write(name.encode())
        finally:
            out.close()
        try:
            if self.fs.getScheme() == "file":
                os.link(draft.toUri().getPath(), goal.toUri().getPath())  # fails if the goal is there
            else:
                none = self.java.org.apache.hadoop.fs.Options.Rename.NONE
                options = self.spark.sparkContext._gateway.new_array(self.java.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = none
                self.java.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri()).rename(draft, goal, options)
        except Exception as e:
            if self.fs.exists(goal):
                raise Conflict(f"version {seen + 1} of {self.path} is there already") from e
            raise
        finally:
            self.fs.delete(draft, False)
        return seen + 1

    def try_publish(self, name: str, seen: int) -> int | None:
        """As ``publish``; None instead of a Conflict."""
        try:
            return self.publish(name, seen)
        except Conflict:
            return None

    def write(self, rows: DataFrame, seen: int) -> int:
        """Write the version after ``seen``, the one that ``rows`` were derived from; returns its number."""
        return self.publish(self.stage(rows), seen)

    def update(self, change: Callable[[DataFrame | None], DataFrame], tries: int = 5) -> int:
        """Read, change and write; begins again from the newer version when another writer was faster."""
        for left in reversed(range(tries)):
            seen = self.version()
            try:
                return self.write(change(self.read(seen) if seen else None), seen)
            except Conflict:
                if not left:
                    raise
        raise ValueError("tries must be positive")

    def prune(self, keep: int = 2) -> list[int]:
        """Drop all but the newest versions and the data that no kept version names; no writer may be at work."""
        every = self.versions()
        old, kept = every[:-keep], {self._data(v) for v in every[-keep:]}
        for v in old:
            self.fs.delete(self._path("versions", f"{v:020d}"), False)
        for s in self.fs.listStatus(self._path("data")) if every else []:
            if s.getPath().getName() not in kept:
                self.fs.delete(s.getPath(), True)
        return old
