"""Data sources that read no more of a folder than they have to: the last lines of files, and walks that stay out of folders.

``register`` makes them known to a session; then ``spark.read.format("tail_lines").option("n", 30).load(path)``
and ``spark.read.format("walked_files").option("skip", "node_modules,.git").load(path)``. Paths are whatever
pyarrow's file systems take: local paths, or URIs of HDFS and object stores that all executors reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that are read at a time, going back from a file's end.
STEP = 64 << 10


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def walk(path: str, skip: frozenset[str]) -> Iterator[fs.FileInfo]:
    """Files below a path (or the file itself), by name; folders named in ``skip`` are never listed."""
    store, root = opened(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        yield info
        return
    waiting = [root]
    while waiting:
        listed = sorted(store.get_file_info(fs.FileSelector(waiting.pop())), key=lambda x: x.path)
        yield from (x for x in listed if x.type == fs.FileType.File)
        waiting += [x.path for x in reversed(listed) if x.type == fs.FileType.Directory and x.base_name not in skip]


def last_lines(store: fs.FileSystem, path: str, n: int) -> tuple[list[str], int]:
    """The last n lines, and how many bytes were read for them."""
    with store.open_input_file(path) as f:
        at, got, read = f.size(), b"", 0
        while at > 0 and got.rstrip(b"\n").count(b"\n") < n:
            size = min(max(STEP, len(got)), at)  # steps grow, so that a line of any length takes linear time
            at -= size
            f.seek(at)
            got = f.read(size) + got
            read += size
    lines = got.rstrip(b"\n").split(b"\n") if got.strip(b"\n") else []
    return [x.decode("utf-8", "replace") for x in lines[-n:]] if n else [], read


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, datetime]]) -> None:
        self.files = files


def _dealt(files: list, most: int) -> list[_Files]:
    return [_Files(files[i::most]) for i in range(min(most, len(files)))] or [_Files([])]


class _Walked(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.skip = frozenset(x for x in options.get("skip", "").split(",") if x)
        self.most = int(options.get("partitions", 64))

    def partitions(self) -> list[_Files]:
        return _dealt([(x.path, x.size, x.mtime) for x in walk(self.path, self.skip)], self.most)

    def read(self, partition: _Files) -> Iterator[tuple]:
        yield from ((p, size, mtime.astimezone(UTC).replace(tzinfo=None) if mtime else None) for p, size, mtime in partition.files)


class WalkedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "walked_files"

    def schema(self) -> str:
        return "path string, length bigint, mtime timestamp_ntz"

    def reader(self, schema) -> DataSourceReader:
        return _Walked(dict(self.options))


class _Tails(_Walked):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.n = int(options.get("n", 30))

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, _ = opened(self.path)
        for path, size, _ in partition.files:
            lines, read = last_lines(store, path, self.n)
            yield from ((path, size, i, x, read) for i, x in enumerate(lines))


class TailLines(DataSource):
    """(path, length, line from 0 among the last ones, text, bytes read of the file)."""

    @classmethod
    def name(cls) -> str:
        return "tail_lines"

    def schema(self) -> str:
        return "path string, length bigint, line int, text string, read_bytes bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Tails(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (WalkedFiles, TailLines):
        spark.dataSource.register(source)


def walked(spark: SparkSession, path: str, *, suffixes: list[str], skip: list[str], most: int) -> DataFrame:
    """(path, length, mtime) of files by suffix, without those in skipped folders, empty and large ones."""
    register(spark)
    rows = spark.read.format("walked_files").option("skip", ",".join(skip)).load(path)
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | F.col("path").endswith(s)
    return rows.where(ends & (F.col("length") > 0) & (F.col("length") <= most))


def transcripts(spark: SparkSession, path: str, n: int = 30) -> DataFrame:
    """(path, line, turn) of the last n lines of each file that are JSON objects; files of any size are read from their ends."""
    register(spark)
    turn = "struct<type:string,role:string,name:string,content:array<struct<type:string,name:string,input:struct<command:string>>>>"
    rows = spark.read.format("tail_lines").option("n", n).load(path)
    return rows.select("path", "line", F.try_parse_json("text").alias("v"), F.from_json("text", turn).alias("turn")).where(F.schema_of_variant("v").startswith("OBJECT")).drop("v")
