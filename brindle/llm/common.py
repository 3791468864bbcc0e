"""Shared plumbing of the training-data operators: tables, spilled stages, Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from brindle.session import run_base, shared_base, spill, sweep

#: Rows are handed to Python in Arrow batches of about this many bytes.
ARROW_BYTES = 4 << 20
#: Rows of a batch that is read from Parquet.
READ_ROWS = 512
#: Texts are worked on in chunks of about this many characters.
CHUNK_CHARS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder for a result that outlives the application."""
    return f"{shared_base(spark)}/brindle-store-{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let the driver drop shuffle files of stages that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def thin(rows: DataFrame, want: int, *by: str) -> DataFrame:
    """By hash, about four times as many rows as a bounded sample wants, or all if there are fewer.

    The sample's sort then sends the driver a few rows in all, not its size from every task.
    """
    n = rows.count()
    if n <= 4 * want:
        return rows
    return rows.where(F.pmod(F.xxhash64(*by), F.lit(1 << 30)) < int((1 << 30) * 4 * want / n))


def arrow_limits(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes and Parquet batches by rows, so that a run of long texts can't fill a worker or an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


#: What a Python worker holds from task to task (one vocabulary with its cache), by name.
HELD: dict = {}


def held(name: tuple, make: Callable):
    """An object that the worker's next tasks find again, until another one is asked for."""
    if name not in HELD:
        let_go()
        HELD[name] = make()
    return HELD[name]


def let_go() -> None:
    """Drop what is held and give the memory back, for the stage that now runs in this worker."""
    HELD.clear()
    give_back()


def give_back() -> None:
    """Return freed memory to the system, since a worker that idles would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(df: DataFrame, schema: str | StructType, work: Callable[[Iterator[dict]], Iterator[dict]], holds: bool = False) -> DataFrame:
    """mapInArrow for functions from an iterator of column dicts to one of column dicts.

    ``holds``: the work uses ``held``; other work first drops what earlier stages held.
    """
    arrow_limits(df.sparkSession)
    out = to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        if not holds and HELD:
            let_go()
        for cols in work(dict(zip(b.schema.names, b.columns, strict=True)) for b in batches):
            every = [c if isinstance(c := cols[f.name], pa.Array) else pa.array(c, f.type) for f in out]
            yield pa.RecordBatch.from_arrays(every, schema=out)
            del cols, every
        give_back()

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def chunks(sizes: list[int], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``most`` (a longer row stands alone)."""
    a, total = 0, 0
    for i, n in enumerate(sizes):
        if i > a and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns that an operator works on: clashing extra columns stay outside."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def own_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own, none of which ``df`` has."""
    there = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in there:
            n = f"_{n}"
        out.append(n)
        there.add(n.lower())
    return out


__all__ = ["arrow_limits", "chunks", "give_back", "held", "let_go", "map_rows", "own_names", "pick", "release", "run_base", "shared_base", "spill", "store_dir", "sweep", "table", "texts_of", "thin"]
