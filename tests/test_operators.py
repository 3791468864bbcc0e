from pyspark.sql import functions as F

from brindle.operators import events as E
from brindle.operators import graph as G
from brindle.operators import merge as MG
from brindle.operators import scans as SC
from brindle.sources import formats as FM


def test_ready_tasks_of_a_diamond(spark):
    def ready(done):
        tasks = spark.createDataFrame([(1, t, t in done) for t in (1, 2, 3)], "node int, task int, done boolean")
        deps = spark.createDataFrame([(1, 3, 1), (1, 3, 2)], "node int, task int, needs int")
        return sorted(r["task"] for r in G.ready(tasks, deps).collect())

    assert ready(set()) == [1, 2] and ready({1}) == [2] and ready({1, 2}) == [3] and ready({1, 2, 3}) == []


def test_cycles(spark):
    deps = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 2), (2, 2, 1), (3, 1, 1)], "node int, task int, needs int")
    assert sorted(map(tuple, G.cycle_residual(deps).collect())) == [(1, 1), (1, 2), (1, 3), (3, 1)]
    assert G.cycle_residual(deps.where("node = 2")).count() == 0


def _events(spark, rows):
    d = spark.createDataFrame([(k, s, t, f) for k, s, t, f in rows], "key bigint, seq bigint, t double, file string")
    return d.select("key", "seq", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts"), "file")


ROWS = [(1, 1, 0.0, "a"), (1, 2, 29.0, "b"), (1, 3, 30.0, "b"), (1, 4, 61.0, "c"), (2, 5, 5.0, "a"), (1, 6, 2000.0, "d"), (1, 7, 3800.0, "a")]


def test_throttle_cooldown_sessions(spark):
    e = _events(spark, ROWS)
    assert sorted(r["seq"] for r in E.throttle(e, "key", 30).collect()) == [1, 3, 4, 5, 6, 7]
    assert sorted(r["seq"] for r in E.cooldown(e, ["key"], 30).collect()) == [1, 4, 5, 6, 7]
    got = {r["seq"]: r["session"] for r in E.sessions(e, "key", 1800).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2, 7: 2}  # a gap of exactly 1800 s stays in the session


def test_batches_fire_by_time_or_files(spark):
    e = _events(spark, [(1, i, float(i), f"f{i}") for i in range(5)] + [(2, 10, 0.0, "a"), (2, 11, 8.0, "a"), (2, 12, 9.0, "a")])
    assert sorted(map(tuple, E.batch_trigger(e, "key", 8, 5).collect())) == [(1, 4, 5), (2, 11, 1)]


def test_streams_equal_batches(spark, tmp_path):
    from brindle.streaming import stateful as ST

    e = _events(spark, ROWS)
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    for i, (flow, want) in enumerate([(ST.throttle(stream, 30), E.throttle(e, "key", 30)), (ST.batch_trigger(stream, 8, 5), E.batch_trigger(e, "key", 8, 5)), (ST.sessions(stream), E.sessions(e).select("key", "seq", "session"))]):
        name = f"flow{i}"
        q = flow.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, want.collect()))


def test_merge_keeps_first_longest_and_order(spark):
    rows = [("t", "p", "d", 1, "ab", "", "x"), ("t", "p", "d", 2, "abc", "r1", "y"), ("t", "p", "d", 3, "xyz", "r2", "x")]
    e = spark.createDataFrame(rows, "type string, file_pattern string, domain string, seq bigint, description string, resolution string, related string").withColumn("seen", F.timestamp_seconds("seq").cast("timestamp_ntz"))
    r = MG.experience_merge(e).first()
    assert (r["occurrences"], r["description"], r["resolution"], r["related_files"]) == (3, "abc", "r1", "x,y")


def test_upsert_skips_unchanged(spark):
    old = spark.createDataFrame([("a", "h1"), ("b", "h2")], "k string, h string")
    new = spark.createDataFrame([("a", "h1"), ("b", "h3"), ("c", "h4")], "k string, h string")
    assert sorted(map(tuple, MG.hash_upsert(old, new, ["k"], "h").collect())) == [("b", "h3"), ("c", "h4")]
    assert sorted(map(tuple, MG.apply_upsert(old, new, ["k"], "h").collect())) == [("a", "h1"), ("b", "h3"), ("c", "h4")]


def test_rule_scan_reports_lines_and_counts(spark):
    code = "import os\ntry:\n    pass\nexcept:\n    os.system('x')\nexcept :\n"
    d = spark.createDataFrame([(1, code)], "id int, text string")
    got = {r["rule"]: (r["n"], r["line"]) for r in SC.rule_scan(d, "id", "text", SC.flat_rules()).collect() if r["rule"].startswith("python/")}
    assert got == {"python/bare-except": (2, 4), "python/os-system": (1, 5)}


def test_snippet(spark):
    code = "import a\nx = 1\nfunc one() {\n  y\n}\nfunc two() {\n}\nfunc three() {\n}\n"
    got = spark.createDataFrame([(code,)], "t string").select(SC.snippet("t").alias("s")).first()["s"]
    assert got == "import a\nfunc one() {\n  y\n}\nfunc two() {\n}"


def test_formats(spark, tmp_path):
    (tmp_path / "n.md").write_text("---\nid: n1\npriority: high\ntags:\n- a\n- b\n---\nBody text\n")
    r = FM.read_notes(spark, str(tmp_path)).first()
    assert r["fields"]["id"] == "n1" and r["lists"]["tags"] == ["a", "b"] and r["body"] == "Body text"
    (tmp_path / "e.json").write_text('{"entries": [{"id": "1", "type": "t", "unknown": 3, "related_files": ["x"]}], "count": 1}')
    r = FM.read_experience(spark, str(tmp_path / "e.json")).first()
    assert r["id"] == "1" and r["related_files"] == ["x"] and r["confidence"] is None
    (tmp_path / "j.jsonl").write_text('{"id":"1","ref":"r","commit":"c"}\nbroken\n{"id":"2"}\n')
    assert [r["id"] for r in FM.read_journal(spark, str(tmp_path / "j.jsonl")).collect()] == ["1"]
    doc = FM.parse_graph("nodes:\n  - id: a\n    is_start: true\n    tasks:\n      - id: t1\n        dependencies: [x, 'y']\nedges:\n  - id: e1\n    from: a\n    to: b\n    condition:\n      type: always\n    priority: 2\n")
    assert doc["nodes"][0]["tasks"][0]["dependencies"] == ["x", "y"] and doc["edges"][0]["condition"] == {"type": "always"} and doc["edges"][0]["priority"] == 2
    nodes, edges, tasks = FM.graph_frames(spark, "nodes:\n- id: a\nedges:\n- id: e\n  from: a\n  to: a\n")
    assert (nodes.count(), edges.count(), tasks.count()) == (1, 1, 0)
