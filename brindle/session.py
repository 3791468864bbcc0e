"""Session defaults (UTC, adaptive execution, Arrow) and folders that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: Bytes of a Parquet row group of an intermediate table: a writing task buffers one.
ROW_GROUP = 8 << 20


def session(name: str = "brindle", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which every executor can reach.

    Only on one machine (a local master), where the session may have no such setting, a
    folder of its warehouse stands in; on a cluster a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"


def run_base(spark: SparkSession) -> str:
    """Where this application alone keeps its intermediate tables."""
    return f"{shared_base(spark)}/brindle-run-{spark.sparkContext.applicationId}"


def spill(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a shared Parquet table of this application and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{run_base(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(schema).parquet(path)


def sweep(spark: SparkSession) -> bool:
    """Delete this application's intermediate tables; results not yet computed read them, so write those first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_base(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
