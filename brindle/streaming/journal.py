"""Append-only journals from streams, each micro-batch once however often it is tried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from brindle.functions import constants as C


def append(rows: DataFrame, path: str, source: str) -> DataStreamWriter:
    """A writer (start it with a checkpoint of its own) that keeps batch b of a stream in ``source=<source>/batch=<b>``.

    A batch that is tried again replaces what its earlier try left. A stream that begins anew, with another
    checkpoint, counts its batches from 0 again and needs another ``source``.
    """

    def batch(now: DataFrame, number: int) -> None:
        now.write.mode("overwrite").json(f"{path}/source={source}/batch={number}")

    return rows.writeStream.foreachBatch(batch)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of batches that were written whole, with ``source`` and ``batch``; broken lines drop out."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/source=*/batch=*/_SUCCESS")
    found = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(files)
    whole = sorted(str(s.getPath().getParent()) for s in found or [])
    full = f"{schema}, source string, batch bigint"
    if not whole:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", path).option("mode", "DROPMALFORMED").json(whole)


def latest(journal: DataFrame, by: str, order: list[str], most: int = C.TREND_ROWS) -> DataFrame:
    """Of each group the last ``most`` rows."""
    w = W.partitionBy(by).orderBy(*[F.desc(c) for c in [*order, "batch"]])
    return journal.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")
