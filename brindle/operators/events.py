"""Event logic in batch form: folds and windows per key, with streaming twins in ``streaming``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import constants as C
from brindle.operators import segmented
from brindle.operators.ordered import ordered


def _timed(events: DataFrame, key: list[str], *more: str) -> DataFrame:
    return events.select(*key, F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "seq", *more)


def throttle(events: DataFrame, key: str = "key", seconds: float = C.THROTTLE_S) -> DataFrame:
    """Accepted events: at least so long after the last accepted one."""
    return segmented.fold(_timed(events, [key]), [key], ["t", "seq"], "t", [key, "seq"], segmented.Throttle(int(seconds * 1e6)))


def cooldown(events: DataFrame, key: list[str], seconds: float = C.COOLDOWN_S) -> DataFrame:
    """Emitted events by key: strictly longer after the last emitted one."""
    return segmented.fold(_timed(events, key), key, ["t", "seq"], "t", [*key, "seq"], segmented.Throttle(int(seconds * 1e6), strict=True))


def batch_trigger(events: DataFrame, key: str = "key", seconds: float = C.BATCH_S, files: int = C.BATCH_FILES) -> DataFrame:
    """(key, seq, n_files) of events that fire a batch: so long after its first edit, or so many files."""
    return segmented.fold(_timed(events, [key], "file"), [key], ["t", "seq"], "t", [key, "seq"], segmented.Batch(int(seconds * 1e6), files), extra="file")


def sessions(events: DataFrame, key: str = "key", seconds: float = C.SESSION_S) -> DataFrame:
    """Session numbers (a new one after a strictly longer gap) and first-of-session and first-of-file flags."""
    cold, hot = segmented.split(_timed(events, [key], "file"), [key])
    w = W.partitionBy(key).orderBy("t", "seq")
    rows = cold.withColumn("starts", _begins(F.lag("t").over(w), seconds)).withColumn("session", F.sum("starts").over(w.rowsBetween(W.unboundedPreceding, 0)))
    first_file = F.row_number().over(W.partitionBy(key, "session", "file").orderBy("t", "seq")) == 1
    out = rows.select(key, "seq", "session", (F.col("starts") == 1).alias("first_of_session"), first_file.alias("first_of_file"))
    return out if hot is None else out.unionByName(_hot_sessions(hot, key, seconds))


def _begins(before: Column, seconds: float) -> Column:
    return F.coalesce((F.col("t") - before > int(seconds * 1e6)).cast("bigint"), F.lit(1).cast("bigint"))


def _hot_sessions(rows: DataFrame, key: str, seconds: float) -> DataFrame:
    """The same by scans over ranges: gaps to the row before, running sums of starts, places among a file's rows."""
    gaps = ordered(rows, [key], ["t", "seq"], previous="t").rows.select(key, "t", "seq", "file", _begins(F.col("before"), seconds).alias("starts"))
    sums = ordered(gaps, [key], ["t", "seq"], sums=("starts",)).rows
    first = sums.where("at = 0").select(F.col(key).alias("_key"), F.col("sum_starts").alias("_first"))  # a row a hot key
    numbered = sums.join(F.broadcast(first), F.col(key).eqNullSafe(F.col("_key"))).select(key, "t", "seq", "file", "starts", (F.col("sum_starts") - F.col("_first") + 1).alias("session"))
    places = ordered(numbered, [key, "session", "file"], ["t", "seq"]).rows
    return places.select(key, "seq", "session", (F.col("starts") == 1).alias("first_of_session"), (F.col("at") == 0).alias("first_of_file"))


def idle_stops(events: DataFrame, key: str = "key", seconds: float = 600) -> DataFrame:
    """Events after which a key stays unused for ``seconds`` or longer, and when it is stopped."""
    cold, hot = segmented.split(_timed(events, [key]), [key])
    rows = cold.withColumn("after", F.lead("t").over(W.partitionBy(key).orderBy("t", "seq")))
    if hot is not None:
        back = ordered(hot, [key], [F.desc("t"), F.desc("seq")], previous="t").rows
        rows = rows.unionByName(back.select(*cold.columns, F.col("before").alias("after")))
    stop = F.timestamp_micros((F.col("t") + int(seconds * 1e6)).cast("bigint")).cast("timestamp_ntz")
    return rows.where(F.col("after").isNull() | (F.col("after") - F.col("t") >= int(seconds * 1e6))).select(key, "seq", stop.alias("stopped_at"))
