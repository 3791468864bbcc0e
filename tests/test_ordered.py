"""Numbered scans, folds of keys that are cut into chunks, and contracted graphs against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import events as E
from brindle.operators import graph as G
from brindle.operators import memory as M
from brindle.operators import search as SE
from brindle.operators import segmented as S
from brindle.operators.ordered import ordered


def test_ordered_numbers_runs_and_sums(spark):
    r = random.Random(3)
    rows = [(r.choice([None, 1, 2, 2, 2, 2, 3]), r.randint(0, 50), i) for i in range(500)]
    d = spark.createDataFrame(rows, "k int, v bigint, id bigint").repartition(5)
    got = ordered(d, ["k"], ["v", "id"], head="id", sums=("v",), previous="v")
    want, total, runs, last = [], 0, -1, "none"
    for i, (k, v, own) in enumerate(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))):
        if k != last:
            last, runs, start, head, before = k, runs + 1, i, own, None
        total += v
        want.append((k, v, own, i, runs, i - start, head, total, before))
        before = v
    assert sorted(map(tuple, got.rows.collect()), key=lambda x: x[3]) == want
    assert (got.n_rows, got.n_runs) == (500, 4)
    none = ordered(d.limit(0), ["k"], ["v"])
    assert none.rows.collect() == [] and none.n_rows == none.n_runs == 0


def machines():
    return [S.Throttle(5), S.Throttle(5, strict=True), S.Throttle(0), S.Batch(6, 3), S.Batch(0, 3), S.Batch(100, 2), S.Batch(3, 1), S.Budget(40), S.Budget(0)]


@pytest.mark.parametrize("machine", machines(), ids=lambda m: f"{type(m).__name__}-{sorted(vars(m).items())}")
def test_composed_chunks_equal_one_run(machine):
    for seed in range(60):
        r = random.Random(seed)
        n = r.randint(1, 60)
        t = sorted(r.randint(0, r.choice([5, 60, 400])) for _ in range(n)) if not isinstance(machine, S.Budget) else [r.randint(0, 25) for _ in range(n)]
        x = [r.choice(["a", "b", "c", "d", None][: r.randint(1, 5)]) for _ in range(n)]
        want = list(machine.run(t, x, 0, n, machine.fresh))
        size, state, got = r.randint(1, 20), machine.fresh, []
        for a in range(0, n, size):
            b = min(a + size, n)
            got += machine.run(t, x, a, b, state)
            state = machine.apply(machine.summary(t[a:b], x[a:b]), state)
        assert got == want, (seed, size)


def edits(spark, n, hot=0.6):
    """One key holds most rows; the key that is null some more than a chunk."""
    i = F.col("id")
    key = F.when(F.rand(1) < hot, F.lit(7)).when(F.rand(2) < 0.5, i % 50 + 100)
    gap = F.when(F.rand(4) < 0.01, 400).otherwise(F.floor(F.rand(3) * 3))
    return spark.range(n).select(key.cast("bigint").alias("key"), i.alias("seq"), F.timestamp_seconds(i / 3 + gap).cast("timestamp_ntz").alias("ts"), F.concat(F.lit("f"), F.floor(F.rand(5) * 7).cast("string")).alias("file"))


def test_hot_keys_equal_whole_keys(spark, tmp_path, monkeypatch):
    edits(spark, 30_000).write.parquet(str(tmp_path / "e"))
    e = spark.read.parquet(str(tmp_path / "e"))
    sizes = e.select("key", "seq", (F.col("seq") % 9).alias("size"))

    def every():
        made = [E.throttle(e, "key", 30), E.cooldown(e, ["key", "file"], 20), E.batch_trigger(e, "key", 8, 5), M.pack_skipping(sizes, "size", ["seq"], "key", "seq", 600), E.sessions(e, "key", 20), E.idle_stops(e, "key", 15)]
        return [sorted(map(tuple, d.collect()), key=str) for d in made]

    want = every()
    assert all(want)
    monkeypatch.setattr(S, "CHUNK", 700)
    assert every() == want


def test_hot_projects_equal_whole_projects(spark, tmp_path, monkeypatch):
    log = edits(spark, 20_000).select(F.col("key").alias("project"), "seq", "ts", F.when(F.rand(9) < 0.05, None).otherwise(F.col("file")).alias("to_node"), (F.rand(8) < 0.01).alias("reset"))
    log.write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))

    searches = log.where("seq % 5 = 0 and seq > 40").select("project", "seq", "ts", F.array("to_node").alias("results"))
    chosen = log.where("seq % 5 <> 0").select("project", "seq", "ts", F.col("to_node").alias("tool"))

    def every():
        return [sorted(map(tuple, d.collect()), key=str) for d in (SE.asof_selection(searches, chosen), G.taken(log, 5).select("project", "seq", "epoch", "visit", "taken"), G.states(log, 5), G.steps(log).select("project", "seq", "from_node", "to_node"))]

    want = every()
    monkeypatch.setattr(S, "CHUNK", 700)
    assert every() == want


def test_a_key_of_millions_of_events_over_many_tasks(spark, tmp_path):
    """Against a loop over the same events in numpy."""
    n = 3_000_000
    e = spark.range(n).select(F.lit(1).cast("bigint").alias("key"), F.col("id").alias("seq"), F.timestamp_micros(F.col("id") * 700_000 + F.pmod(F.xxhash64("id"), F.lit(900_000))).cast("timestamp_ntz").alias("ts"))
    e.write.parquet(str(tmp_path / "e"))
    t = np.array([x.as_py() for x in spark.read.parquet(str(tmp_path / "e")).orderBy("ts", "seq").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).toArrow()["t"]])
    want, i = 0, 0
    while i < n:
        want, i = want + 1, int(np.searchsorted(t, t[i] + 30_000_000))
    got = S.fold(E._timed(spark.read.parquet(str(tmp_path / "e")), ["key"]), ["key"], ["t", "seq"], "t", ["key", "seq"], S.Throttle(30_000_000), chunk=200_000)
    assert got.count() == want


# --- graphs


def plain_residual(deps):
    left = set(deps)
    while True:
        tasks = {(n, t) for n, t, _ in left}
        kept = {d for d in left if (d[0], d[2]) in tasks}
        if kept == left:
            return sorted(tasks)
        left = kept


def random_graph(r):
    n = r.randint(1, 40)
    return [(r.randint(1, 3), r.randint(1, n), r.randint(1, n)) for _ in range(r.randint(1, n + r.randint(0, 15)))]


def test_residuals_equal_plain_peeling(spark):
    r = random.Random(5)
    every = [(1000 * k + n, t, x) for k in range(60) for n, t, x in random_graph(r)]
    deps = spark.createDataFrame(every, "node int, task int, needs int")
    want = plain_residual(every)
    assert sorted(map(tuple, G.cycle_residual(deps).collect())) == want
    assert sorted(map(tuple, G.contract(deps).rows.collect())) == want
    words = deps.select("node", F.concat(F.lit("t"), "task").alias("task"), F.concat(F.lit("t"), "needs").alias("needs"))
    assert sorted(map(tuple, G.cycle_residual(words).collect())) == sorted((n, f"t{t}") for n, t in want)
    assert G.cycle_residual(deps.limit(0)).collect() == []


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(G, "GROUP", 1000)
    n = 100_000
    up = spark.range(1, n).select(F.lit(1).alias("node"), F.col("id").alias("task"), (F.col("id") - 1).alias("needs"))
    loop = spark.createDataFrame([(1, 50_000, 50_007), (1, n, n - 1), (1, n, 10)], "node int, task bigint, needs bigint")
    free = G.contract(up)
    assert free.rows.collect() == [] and free.rounds <= 20
    closed = G.contract(up.unionByName(loop))
    assert closed.rounds <= 20
    assert sorted(r["task"] for r in closed.rows.collect()) == list(range(50_000, n + 1))
    assert G.cycle_residual(up.unionByName(loop)).count() == n + 1 - 50_000
