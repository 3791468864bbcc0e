"""Streams with timers: order of arrival, quiet streams, versions, replayed batches."""

import random
import time

import pytest
from pyspark.sql import functions as F

from brindle.operators import events as E
from brindle.operators import search as SE
from brindle.streaming import timed as T


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", T.PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def table(spark, rows, more=""):
    d = spark.createDataFrame(rows, f"key bigint, seq bigint, t double{more}")
    return d.withColumn("ts", F.timestamp_seconds(F.col("t") + 1000).cast("timestamp_ntz")).drop("t")  # a watermark begins at 0


def replay(spark, tmp_path, parts, make, name):
    """The parts as files, one a micro-batch, then a late row of another key that moves the watermark beyond all."""
    for i, d in enumerate(parts):
        d.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        time.sleep(0.02)
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def shuffled(rows, seed, within=30.0):
    """Rows as they arrive: each up to ``within`` late, in three parts."""
    r = random.Random(seed)
    order = sorted(rows, key=lambda x: x[2] + r.random() * within)
    n = len(order)
    return [order[: n // 3], order[n // 3 : 2 * n // 3], order[2 * n // 3 :]]


END = (99, 10_000, 90_000.0)


def test_idle_stops_equal_the_batch_form_whatever_the_order_of_arrival(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.randint(1, 3), i, round(i * 7 + r.random() * 5 + (300 if i > 20 else 0), 3)) for i in range(40)]
    parts = [table(spark, p) for p in [*shuffled(rows, 2), [END]]]
    got = replay(spark, tmp_path, parts, lambda s: T.idle_stops(s, 20, "40 seconds"), "idle")
    want = sorted(map(tuple, E.idle_stops(table(spark, [*rows, END]), "key", 20).collect()), key=str)
    assert got == [w for w in want if w[0] != 99] and got


def test_batches_fire_without_a_further_event(spark, tmp_path):
    rows = [(1, 1, 0.0, "a"), (1, 2, 3.0, "b"), (2, 3, 5.0, "a"), (2, 4, 6.0, "b"), (2, 5, 7.5, "c"), (1, 6, 30.0, "z"), (1, 7, 38.0, "y")]
    parts = [table(spark, [(99, 99, 60_000.0, "end")], ", file string")]
    parts = [table(spark, [rows[i] for i in p], ", file string") for p in ((1, 0, 4), (3, 2), (6, 5))] + parts
    got = replay(spark, tmp_path, parts, lambda s: T.batches(s, 8, 3, "40 seconds"), "batches")
    at = lambda t: spark.range(1).select(F.timestamp_seconds(F.lit(t + 1000)).cast("timestamp_ntz")).first()[0]
    assert got == sorted([(1, 2, at(8.0), 2), (2, 5, at(7.5), 3), (1, 6, at(38.0), 1), (1, 7, at(46.0), 1)], key=str)


def test_asof_of_two_streams(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.randint(1, 2), i, i * 3.0 + r.random(), r.random() < 0.4) for i in range(40)]
    parts = [table(spark, p, ", searched boolean") for p in [*shuffled(rows, 5), [(*END, True)]]]
    every = lambda d: d.select(F.col("key").alias("project"), "seq", "ts", "searched", F.array(F.concat(F.lit("t"), (F.col("seq") % 3).cast("string"))).alias("results"), F.concat(F.lit("t"), (F.col("seq") % 2).cast("string")).alias("tool"))
    split = lambda d: (every(d).where("searched").drop("tool", "searched"), every(d).where("not searched").drop("results", "searched"))
    got = replay(spark, tmp_path, parts, lambda s: T.asof_selection(*split(s), late="40 seconds"), "asof")
    want = SE.asof_selection(*split(table(spark, rows, ", searched boolean")))
    assert got == sorted(map(tuple, want.select("project", "seq", "search_seq", "hit").collect()), key=str) and got


def test_a_stream_that_goes_quiet_stops_by_the_clock(spark, tmp_path):
    table(spark, [(1, 1, 0.0), (1, 2, 0.0), (2, 3, 0.0)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key bigint, seq bigint, ts timestamp_ntz").parquet(str(tmp_path / "in"))
    q = T.quiet(stream, 1).writeStream.format("memory").queryName("quiet").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("quiet").count() < 2:
            time.sleep(0.5)
        assert sorted(map(tuple, spark.table("quiet").collect())) == [(1, 2, 2), (2, 3, 1)]
    finally:
        q.stop()


def test_notes_go_out_again_once_they_are_newer(spark, tmp_path):
    notes = str(tmp_path / "notes")
    put = lambda rows: spark.createDataFrame(rows, "project bigint, id string, version bigint, body string").coalesce(1).write.mode("overwrite").parquet(notes)
    put([(1, "a", 1, "old"), (1, "b", 1, "b"), (2, "a", 5, "other"), (2, "n", None, "no version")])
    schema = spark.read.parquet(notes).schema

    def ask(project):
        spark.createDataFrame([(project,)], "project bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("project bigint").parquet(str(tmp_path / "in"))
        out = T.newer_copies(stream, spark.read.schema(schema).parquet(notes))
        got = []
        q = out.writeStream.foreachBatch(lambda d, _: got.extend(map(tuple, d.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(got)

    assert ask(1) == [(1, "a", 1, "old"), (1, "b", 1, "b")]
    assert ask(1) == []
    put([(1, "a", 2, "new"), (1, "b", 1, "b"), (2, "a", 5, "other")])
    assert ask(1) == [(1, "a", 2, "new")]
    assert ask(2) == [(2, "a", 5, "other")]
