"""Streaming twins of the event operators, on applyInPandasWithState, and windowed counts.

State per key is a few numbers (and, for batches, the distinct files of the open batch).
Events of a micro-batch are taken in order of (ts, seq); a replay of the same events in
the same batches gives the same output as the batch fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brindle.functions import constants as C


def _rows(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    got = pd.concat(list(frames), ignore_index=True)
    return got.sort_values(["ts", "seq"])


def throttle(events: DataFrame, seconds: float = C.THROTTLE_S, strict: bool = False) -> DataFrame:
    """Accepted events of (key, seq, ts): so long (or, if strict, longer) after the last accepted."""

    def step(key, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        out = []
        for r in _rows(frames).itertuples():
            t = r.ts.timestamp()
            if last is None or (t - last > seconds if strict else t - last >= seconds):
                last = t
                out.append((key[0], r.seq))
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "seq"])

    return events.groupBy("key").applyInPandasWithState(step, "key bigint, seq bigint", "last double", "append", GroupStateTimeout.NoTimeout)


def batch_trigger(events: DataFrame, seconds: float = C.BATCH_S, files: int = C.BATCH_FILES) -> DataFrame:
    """Events of (key, seq, ts, file) that fire a batch, with its number of files."""

    def step(key, frames, state: GroupState):
        first, got = state.get if state.exists else (None, [])
        got, out = list(got), []
        for r in _rows(frames).itertuples():
            t = r.ts.timestamp()
            first = t if first is None else first
            got = got if r.file in got else [*got, r.file]
            if t - first >= seconds or len(got) >= files:
                out.append((key[0], r.seq, len(got)))
                first, got = None, []
        state.update((first, got))
        yield pd.DataFrame(out, columns=["key", "seq", "n_files"])

    return events.groupBy("key").applyInPandasWithState(step, "key bigint, seq bigint, n_files int", "first double, files array<string>", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, seconds: float = C.SESSION_S) -> DataFrame:
    """Session numbers: a new one after a strictly longer gap."""

    def step(key, frames, state: GroupState):
        last, n = state.get if state.exists else (None, 0)
        out = []
        for r in _rows(frames).itertuples():
            t = r.ts.timestamp()
            n += last is None or t - last > seconds
            last = t
            out.append((key[0], r.seq, n))
        state.update((last, n))
        yield pd.DataFrame(out, columns=["key", "seq", "session"])

    return events.groupBy("key").applyInPandasWithState(step, "key bigint, seq bigint, session bigint", "last double, n bigint", "append", GroupStateTimeout.NoTimeout)


def once(events: DataFrame, keys: list[str], ts: str = "ts", within: str = "30 days") -> DataFrame:
    """The first event of each key, as far back as the watermark keeps keys."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def counts(events: DataFrame, key: str, every: str = "1 hour", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Events by key and window of event time; later ones than the watermark are left out."""
    got = events.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), key).agg(F.count("*").alias("n"))
    return got.select(key, F.col("w.start").alias("start"), "n")


def rotate_baseline(findings: DataFrame, path: str, report) -> object:
    """foreachBatch writer: reports findings that the last batch's baseline lacks, then replaces it.

    The first batch reports nothing. Baselines are written under a new name each time, so a
    repeated batch reads what it read before.
    """

    def batch(now: DataFrame, number: int) -> None:
        spark = now.sparkSession
        now = now.select("type", "file").distinct()
        if number > 0:
            old = spark.read.schema(now.schema).parquet(f"{path}/batch={number - 1}")
            report(now.join(old, ["type", "file"], "left_anti"), number)
        now.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return findings.writeStream.foreachBatch(batch)
