"""Token ids as length-delimited binary records with masked checksums and an offset index.

A frame is: payload length (u64), masked checksum of those 8 bytes (u32), payload, masked
checksum of the payload (u32), and one line feed. The payload is a null flag of the id
(u8), the id (i64), the width of a token id in bytes (u8: 2 or 4) and the token ids, all
little-endian. Frames lie in ascending order of (id, text hash), null ids first, in files
``data/block=B/part-NNNNN*``, in order of the numbers NNNNN and B; a task begins a new block once
one holds ``FILE_BYTES``, so a file is at most that and one record long. ``index`` is a Parquet
table with one row a frame (id, file, offset, bytes, n_tokens), with which ``fetch`` reads the
bytes of the wanted records alone, in any order.

Spark's own text writer puts the frames down, so files commit or vanish as whole tasks: a
lost executor or a second attempt leaves no half or double records. Null texts count as
empty and give a record with the end id alone; repeated rows give one record each; an
empty table gives no data.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import chunks, map_rows, pick, store_dir, texts_of
from brindle.llm.tokens import encoder, id_width
from brindle.sources.files import opened

HEAD = struct.Struct("<QI")
TAIL = struct.Struct("<I")
INNER = struct.Struct("<BqB")
#: Bytes from which a file is followed by another, and records in a file at most: these bound the memory of a reading task.
FILE_BYTES, FILE_RECORDS = 32 << 20, 8192
#: Characters of texts that are encoded together: the more, the fewer look-ups of one word.
CHUNK = 2_000_000


def masked(data: bytes) -> int:
    """CRC-32, rotated and shifted, so that checksums of data with checksums stay sound."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(row_id: int | None, ids: bytes, width: int) -> bytes:
    """A record of token ids, given as little-endian unsigned integers of ``width`` bytes."""
    payload = INNER.pack(row_id is None, row_id or 0, width) + ids
    size = struct.pack("<Q", len(payload))
    return b"".join([size, TAIL.pack(masked(size)), payload, TAIL.pack(masked(payload))])  # the writer ends it with a line feed


def frames(content: bytes, name: str = ""):
    """(offset, bytes, id, ids) of every frame; a wrong checksum or length is an error."""
    at, end = 0, len(content)
    while at < end:
        try:
            size, crc = HEAD.unpack_from(content, at)
            payload = content[at + 12 : at + 12 + size]
            (crc2,) = TAIL.unpack_from(content, at + 12 + size)
        except struct.error as e:
            raise ValueError(f"{name}: a frame at {at} is cut off") from e
        stop = at + 17 + size
        if masked(content[at : at + 8]) != crc or masked(payload) != crc2 or content[stop - 1 : stop] != b"\n":
            raise ValueError(f"{name}: wrong checksum in the frame at {at}")
        null, row_id, width = INNER.unpack_from(payload)
        yield at, stop - at, None if null else row_id, np.frombuffer(payload, f"<u{width}", offset=INNER.size)
        at = stop


def heads(content: memoryview):
    """(offset, bytes, id, number of ids) of every frame, by its lengths alone; checksums are left to readers."""
    at, end = 0, len(content)
    while at < end:
        size, _ = HEAD.unpack_from(content, at)
        null, row_id, width = INNER.unpack_from(content, at + HEAD.size)
        yield at, size + 17, None if null else row_id, (size - INNER.size) // width
        at += size + 17
    if at != end:
        raise ValueError(f"a frame goes {at - end} bytes beyond the end")


def write(docs: DataFrame, vocabulary: str, *, end_id: int, kind: str = "words", path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode whole texts, append ``end_id``, write frames and the index; returns the folder."""
    spark = docs.sparkSession
    path = path or store_dir(spark, "records")
    rows = pick(docs, id_col, text_col).withColumn("_tie", F.xxhash64(text_col))
    rows = rows.repartitionByRange(F.col(id_col), F.col("_tie")).sortWithinPartitions(id_col, "_tie")

    width = id_width(vocabulary, end_id)
    last = end_id.to_bytes(width, "little")

    def run(batches, most=FILE_BYTES):
        enc, written = encoder(vocabulary, kind, width), 0
        for b in batches:
            ids, texts = b[id_col].to_pylist(), texts_of(b[text_col])
            for lo, hi in chunks([len(t) for t in texts], CHUNK):
                made = [frame(i, x + last, width) for i, x in zip(ids[lo:hi], enc.encode(texts[lo:hi]), strict=True)]
                before = written + np.cumsum([0, *[len(f) + 1 for f in made]])
                written = int(before[-1])
                yield {"frame": made, "block": (before[:-1] // most).astype(np.int32)}

    out = map_rows(rows, "frame binary, block int", run, holds=True).select(F.col("frame").cast("string").alias("value"), "block")
    with in_order(spark):
        out.write.option("compression", "none").option("maxRecordsPerFile", FILE_RECORDS).partitionBy("block").text(f"{path}/data")

    def index(batches):
        for b in batches:
            for name, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                got = [(i, o, size, n) for o, size, i, n in heads(memoryview(content.as_buffer()))]
                cols = list(zip(*got, strict=True)) or [[]] * 4
                yield {id_col: list(cols[0]), "file": [name] * len(got), "offset": list(cols[1]), "bytes": list(cols[2]), "n_tokens": list(cols[3])}

    found = map_rows(_files(spark, path), f"`{id_col}` bigint, file string, offset bigint, bytes bigint, n_tokens bigint", index)
    found.write.parquet(f"{path}/index")
    return path


@contextmanager
def in_order(spark: SparkSession) -> Iterator[None]:
    """Tasks write several files as their rows come, instead of sorting the rows by file first."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, "0")
    spark.conf.set(name, str(1 << 20))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data").select("path", "content")


#: Names of Spark's data files: the block, the task's partition, the write's UUID, the file's number in the block.
FILE_NAME = re.compile(r"block=(\d+)/part-(\d+)-[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\.?-?c(\d+)\.[^/]*\Z")


def file_order(name: str) -> tuple[int, int, int]:
    found = FILE_NAME.search(name)
    if not found:
        raise ValueError(f"{name} is not named like a data file")
    return int(found[2]), int(found[1]), int(found[3])


def starts(spark: SparkSession, path: str) -> dict[str, int]:
    """Token ids before each file: one number a file is all that the driver gathers."""
    totals = spark.read.parquet(f"{path}/index").groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()
    out, so_far = {}, 0
    for file, n in sorted(totals, key=lambda r: file_order(r["file"])):
        out[file] = so_far
        so_far += n
    return out


def scan(spark: SparkSession, path: str, *, id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """Read the files in order: id, start, n_tokens and the ids (or their CRC-32)."""
    before = starts(spark, path)
    last = "ids_crc32 bigint" if digest else "ids array<bigint>"

    def run(batches):
        for b in batches:
            for name, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                row_ids, begin, n, out, at = [], [], [], [], before.get(name, 0)
                for _, _, i, ids in frames(memoryview(content.as_buffer()).tobytes(), name):
                    row_ids.append(i)
                    begin.append(at)
                    n.append(len(ids))
                    out.append(zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int64))
                    at += len(ids)
                yield {id_col: row_ids, "start": begin, "n_tokens": n, last.split()[0]: out}

    return map_rows(_files(spark, path), f"`{id_col}` bigint, start bigint, n_tokens bigint, {last}", run)


def fetch(spark: SparkSession, path: str, wanted: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Records of the wanted ids: id, ids and how many bytes were read for the record. One row a record.

    A task opens each of its files once and reads the ranges that the index names.
    """
    index = spark.read.parquet(f"{path}/index").join(wanted.select(id_col).distinct(), id_col, "left_semi")
    rows = index.select("file", "offset", "bytes").repartition("file").sortWithinPartitions("file", "offset")

    def run(batches):
        name, source = None, None
        for b in batches:
            got = []
            for file, offset, size in zip(b["file"].to_pylist(), b["offset"].to_pylist(), b["bytes"].to_pylist(), strict=True):
                if file != name:
                    store, local = opened(unquote(file) if file.startswith("file:") else file)
                    name, source = file, store.open_input_file(local)
                got.append(next(frames(source.read_at(size, offset), file)))
            yield {id_col: [g[2] for g in got], "ids": [g[3].astype(np.int64) for g in got], "read": [g[1] for g in got]}

    return map_rows(rows, f"`{id_col}` bigint, ids array<bigint>, read bigint", run)


__all__ = ["fetch", "file_order", "frame", "frames", "heads", "in_order", "masked", "scan", "starts", "write"]
