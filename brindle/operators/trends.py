"""Metric trends over trailing windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window(rows: DataFrame, metric: str, days: int, as_of: Column) -> DataFrame:
    """(project, ts, value) of the last ``days`` days; rows without a readable time drop out."""
    since = F.unix_micros(as_of.cast("timestamp")) - F.lit(days * 86_400_000_000)
    return rows.where(F.unix_micros(F.col("ts").cast("timestamp")) >= since).select("project", "ts", F.col(metric).alias("value"))


def summary(rows: DataFrame, numbers: list[str], words: list[str], days: int, as_of: Column) -> DataFrame:
    """First and last value by project and metric: difference of numbers, changes of words; null under two rows."""
    since = F.unix_micros(as_of.cast("timestamp")) - F.lit(days * 86_400_000_000)
    recent = rows.where(F.unix_micros(F.col("ts").cast("timestamp")) >= since)
    aggs = [F.count("*").alias("n")]
    for m in [*numbers, *words]:
        aggs += [F.min_by(m, "ts").alias(f"{m}_first"), F.max_by(m, "ts").alias(f"{m}_last")]
    got = recent.groupBy("project").agg(*aggs)
    enough = F.col("n") >= 2
    deltas = [F.when(enough, F.round((F.col(f"{m}_last") - F.col(f"{m}_first")).cast("double"), 6)).alias(f"{m}_delta") for m in numbers]
    changes = [F.when(enough & (F.col(f"{m}_first") != F.col(f"{m}_last")), F.concat_ws(" -> ", f"{m}_first", f"{m}_last")).alias(f"{m}_change") for m in words]
    return got.select("project", "n", *deltas, *changes)
