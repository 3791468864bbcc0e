"""Versioned stores, journals of streams, folders of workflows, tails and walks."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from brindle.operators import graph as G
from brindle.operators import merge as MG
from brindle.sources import editing as ED
from brindle.sources import files as FI
from brindle.sources import proxies as PX
from brindle.sources import stored as SD
from brindle.sources import workflows as WF
from brindle.sources.store import Conflict, Store
from brindle.streaming import journal as J


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def held(store):
    d = store.read()
    return None if d is None else sorted(r["v"] for r in d.collect())


def test_a_crash_leaves_the_old_version(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "s"))
    assert s.version() == 0 and s.read() is None
    assert s.write(rows(spark, 1, 2), 0) == 1
    s.stage(rows(spark, 9))  # staged, never published
    assert (s.version(), held(s)) == (1, [1, 2])
    monkeypatch.setattr(os, "link", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        s.write(rows(spark, 9), 1)
    monkeypatch.undo()
    assert (s.version(), held(s)) == (1, [1, 2])
    reading = s.read()
    assert s.write(s.read().union(rows(spark, 3)), 1) == 2
    assert (held(s), sorted(r["v"] for r in reading.collect())) == ([1, 2, 3], [1, 2])
    assert s.prune(1) == [1] and held(s) == [1, 2, 3] and len(os.listdir(tmp_path / "s/data")) == 1


def test_two_writers_lose_no_update(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.write(rows(spark, 0), 0)
    seen = s.version()
    s.write(s.read().union(rows(spark, 1)), seen)
    with pytest.raises(Conflict):
        s.write(s.read().union(rows(spark, 2)), seen)
    assert held(s) == [0, 1]
    failed = []

    def add(v):
        try:
            Store(spark, str(tmp_path / "s")).update(lambda old: old.union(rows(spark, v)), tries=20)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    each = [threading.Thread(target=add, args=(v,)) for v in range(10, 14)]
    for t in each:
        t.start()
    for t in each:
        t.join(120)
    assert not failed and held(s) == [0, 1, 10, 11, 12, 13] and s.version() == 6


def test_stored_slots_and_states(spark, tmp_path):
    s = Store(spark, str(tmp_path / "slots"))
    slot = lambda *r: spark.createDataFrame(r, "project int, seq int, body string")
    SD.put_slots(s, slot((1, 1, "a"), (1, 2, "b"), (2, 1, "c")), "project", ["seq"])
    SD.put_slots(s, slot((1, 3, "d"), (2, 0, "old")), "project", ["seq"])
    assert sorted(map(tuple, s.read().select("project", "body").collect())) == [(1, "d"), (2, "c")]
    log = Store(spark, str(tmp_path / "states"))
    assert SD.load_states(log) is None
    step = lambda seq, node, reset=False: spark.createDataFrame([(1, seq, seq, node, reset)], "project int, seq int, ts int, to_node string, reset boolean")
    for r in (step(1, "a"), step(2, "b"), step(2, "b")):
        SD.record(log, r)
    assert [(r["current_node"], r["transitions"]) for r in SD.load_states(Store(spark, str(tmp_path / "states"))).collect()] == [("b", 2)]
    SD.record(log, step(3, None, True))
    SD.record(log, step(4, "c"))
    assert [(r["current_node"], r["transitions"]) for r in SD.load_states(log).collect()] == [("c", 1)]


def test_stored_entries_equal_those_of_all_events(spark, tmp_path):
    rows = [(f"t{i % 3}", f"p{i % 5}", "d", i, "x" * (i % 7), ["", "", f"r{i}"][i % 3 if i > 4 else 0], i) for i in range(60)]
    events = spark.createDataFrame(rows, "type string, file_pattern string, domain string, seq int, description string, resolution string, seen int")
    s = Store(spark, str(tmp_path / "e"))
    for a in range(0, 60, 20):
        SD.learn(s, events.where(f"seq >= {a} and seq < {a + 20}"))
    want = MG.entries(events)
    assert sorted(map(tuple, s.read().select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    SD.learn(s, events.limit(0), most=4)
    assert s.read().count() == 4 and min(r["confidence"] for r in s.read().collect()) >= sorted(r["confidence"] for r in want.collect())[-4]


def test_stored_catalog_skips_what_is_unchanged(spark, tmp_path):
    tools = lambda *r: spark.createDataFrame(r, "mcp_name string, tool_name string, text_hash string, body string")
    s = Store(spark, str(tmp_path / "c"))
    assert SD.upsert_tools(s, tools(("m", "a", "1", "old"), ("m", "b", "1", "b"), ("n", "a", "1", "n"))) == 1
    assert SD.upsert_tools(s, tools(("m", "a", "1", "ignored"))) == 1
    assert SD.upsert_tools(s, tools(("m", "a", "2", "new"), ("m", "c", "1", "c"))) == 2
    assert sorted((r["tool_name"], r["body"]) for r in s.read().where("mcp_name = 'm'").collect()) == [("a", "new"), ("b", "b"), ("c", "c")]
    assert SD.drop_server(s, "m") == 3 and [r["mcp_name"] for r in s.read().collect()] == ["n"]


def test_a_replayed_batch_adds_no_row(spark, tmp_path):
    path = str(tmp_path / "j")
    assert J.read(spark, path, "id int, at int").collect() == []
    writers = {}

    class Kept:
        def foreachBatch(self, f):
            writers["f"] = f
            return self

    class Rows:
        writeStream = Kept()

    J.append(Rows, path, "one")
    one, two = spark.createDataFrame([(1, 5), (2, 6)], "id int, at int"), spark.createDataFrame([(3, 7)], "id int, at int")
    for d, b in ((one, 0), (two, 1), (two, 1), (one, 0)):
        writers["f"](d, b)
    os.makedirs(tmp_path / "j/source=one/batch=2")
    (tmp_path / "j/source=one/batch=2/part-0.json").write_text('{"id": 9, "at": 9}\n')  # a batch that broke off
    assert sorted((r["id"], r["source"], r["batch"]) for r in J.read(spark, path, "id int, at int").collect()) == [(1, "one", 0), (2, "one", 0), (3, "one", 1)]
    assert [r["id"] for r in J.latest(J.read(spark, path, "id int, at int"), "source", ["at"], 1).collect()] == [3]


def test_a_journal_of_a_stream_that_begins_again(spark, tmp_path):
    put = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for ids in ((1, 2), (3,)):
        put(*ids)
        stream = spark.readStream.schema("id int").parquet(str(tmp_path / "in"))
        q = J.append(stream, str(tmp_path / "j"), "s").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted((r["id"], r["batch"]) for r in J.read(spark, str(tmp_path / "j"), "id int").collect()) == [(1, 0), (2, 0), (3, 1)]


GOOD = """
name: w
nodes:
  - id: a
    name: First
    is_start: true
    node_type: dag
    tools_blocked: ["*"]
    prompt_injection: |
      # not a comment
      - look: here

        deeper
    model: small
    tasks:
      - id: t1
      - id: t2
        dependencies: [t1]
  - id: b
    is_end: true
edges:
  - id: e1
    from: a
    to: b
    condition:
      type: tool
      tool: x
    priority: 2
"""


def test_a_folder_of_workflows_is_one_table(spark, tmp_path):
    for i in range(1000):
        d = tmp_path / f"d{i % 7}"
        d.mkdir(exist_ok=True)
        bad = {3: "nodes:\n  - id: a\n      x: 1\n", 5: "just text", 8: " \n", 11: "nodes:\n  - name: no id\n", 13: "- a\n- b\n"}
        (d / f"w{i}.yaml").write_text(bad.get(i, GOOD.replace("name: w", f"name: w{i}")))
    (tmp_path / "old.yml").write_text("steps:\n  - id: s\n    name: S\n    tools_blocked: [x, y]\n")
    got = WF.read_workflows(spark, str(tmp_path))
    n = {r["kind"]: r["count"] for r in got.groupBy("kind").count().collect()}
    assert n == {"node": 2 * 995, "task": 2 * 995, "edge": 995, "error": 5, "step": 1}
    assert all(r["error"] and r["id"] is None for r in got.where("kind = 'error'").collect())
    one = got.where(F.col("path").endswith("/w20.yaml"))
    assert [(r["id"], r["tools"]) for r in one.where("kind = 'node'").orderBy("seq").collect()] == [("a", ["*"]), ("b", [])]
    first = one.where("kind = 'node' and seq = 0").first()
    assert (first["prompt"], first["mcps"], first["node_type"], json.loads(first["extra"])) == ("# not a comment\n- look: here\n\n  deeper", ["*"], "dag", {"model": "small"})
    assert [(r["src"], r["dst"], r["trigger"], r["tool"], r["priority"]) for r in one.where("kind = 'edge'").collect()] == [("a", "b", "tool", "x", 2)]
    nodes, edges, needs = WF.frames(got)
    assert (nodes.count(), edges.count(), needs.count()) == (1990, 995, 995) and G.cycle_residual(needs).count() == 0
    WF.register(spark)
    assert spark.sql("SELECT kind, id FROM parse_workflow('steps:\n  - id: s1\n')").collect()[0]["id"] == "s1"


def test_the_yaml_subset():
    from brindle.sources.formats import parse_graph

    assert parse_graph("a:\n- 1\n- x: 2\n  y:\n    - p\n    - q\n-\n  z: 3\nb: >-\n  one\n  two\n\n  three\n# end\nc: 'it: is'\nd:\ne: [1, \"b\", true]\n") == {"a": [1, {"x": 2, "y": ["p", "q"]}, {"z": 3}], "b": "one two\n\nthree", "c": "it: is", "d": None, "e": [1, "b", True]}
    assert parse_graph("") == {} and parse_graph("x: |\n    deep\n      more\n  \ny: -3") == {"x": "deep\n  more", "y": -3}


def test_workflows_are_edited_and_only_valid_ones_saved(spark, tmp_path):
    for name in "uv":
        (tmp_path / f"{name}.yaml").write_text(GOOD)
    nodes, edges, _ = WF.frames(WF.read_workflows(spark, str(tmp_path)))
    path = F.element_at(F.split("path", "/"), -1)
    nodes, edges = nodes.withColumn("path", path), edges.withColumn("path", path)
    assert ED.problems(nodes, edges).collect() == []
    store = Store(spark, str(tmp_path / "store"))
    assert ED.save(store, nodes, edges, 0) == 1
    more = ED.put(nodes, spark.createDataFrame([("u.yaml", "c", "Third", False, True), ("u.yaml", "b", "Second", None, False)], "path string, id string, name string, is_start boolean, is_end boolean"))
    got = {(r["path"], r["id"]): (r["name"], r["is_end"], r["seq"]) for r in more.collect()}
    assert got == {("u.yaml", "a"): ("First", False, 0), ("u.yaml", "b"): ("Second", False, 1), ("u.yaml", "c"): ("Third", True, 2), ("v.yaml", "a"): ("First", False, 0), ("v.yaml", "b"): ("b", True, 1)}
    with pytest.raises(ED.Invalid) as e:
        ED.save(store, more.fillna(False, ["is_start"]), edges, 1)
    assert e.value.problems == [("u.yaml", "no_incoming", "c"), ("u.yaml", "no_outgoing", "b")] and store.version() == 1
    way = spark.createDataFrame([("u.yaml", "e2", "b", "c", "phrase", ["go on"])], "path string, id string, src string, dst string, kind string, phrases array<string>")
    assert ED.save(store, more.fillna(False, ["is_start"]), ED.put(edges, way), 1) == 2
    kept_nodes, kept_edges = ED.load(store)
    assert kept_nodes.count() == 5 and kept_edges.count() == 3
    assert [r["dst"] for r in G.triggered(kept_edges.where("path = 'u.yaml'"), phrase="please GO ON now").collect()] == ["c"]
    fewer = ED.drop_nodes(kept_nodes, kept_edges, spark.createDataFrame([("u.yaml", "b")], "path string, id string"))
    assert sorted((r["path"], r["error"]) for r in ED.problems(*fewer).collect()) == [("u.yaml", "no_incoming"), ("u.yaml", "no_outgoing")]
    bad = ED.put(kept_edges, spark.createDataFrame([("v.yaml", "e1", "tool", "", "nowhere")], "path string, id string, kind string, tool string, dst string"))
    assert sorted((r["error"], r["subject"]) for r in ED.problems(kept_nodes, bad).collect()) == [("dangling_to", "nowhere"), ("empty_trigger", "e1"), ("no_incoming", "b")]


def test_jumps_pass_the_cap_and_unknown_ones_are_refused(spark):
    log = spark.createDataFrame([(1, i, i, "a", False, False) for i in range(4)] + [(1, 4, 4, "a", False, True), (1, 5, 5, "gone", False, True)], "project int, seq int, ts int, to_node string, reset boolean, jump boolean")
    kept, wrong = G.known_jumps(log, spark.createDataFrame([("a",)], "id string"))
    assert [r["seq"] for r in wrong.collect()] == [5]
    assert [r["taken"] for r in G.taken(kept, 2).orderBy("seq").collect()] == [True, True, False, False, True]


def test_arguments_are_coerced_by_schema(spark):
    from brindle.sources.formats import coerce

    cases = [
        ('["a", 1]', '{"type": "array"}', '["a",1]'), ("plain", '{"type": "array"}', '["plain"]'), ('{"a": 1}', '{"type": "array"}', '["{\\"a\\": 1}"]'), ('{"a": 1}', '{"type": "object"}', '{"a":1}'),
        ("[1]", '{"type": "object"}', '"[1]"'), ("no { json", '{"type": "object"}', '"no { json"'), ("[1]", '{"type": "string"}', '"[1]"'), ('say "x"', "{}", '"say \\"x\\""'), (None, '{"type": "array"}', None),
        ("[1]", '{"anyOf": [{"type": "null"}, {"type": "array"}]}', "[1]"), ("[1]", '{"oneOf": [{"type": "string"}, {"type": "array"}]}', '"[1]"'), ("5", '{"anyOf": []}', '"5"'), ("[1]", None, '"[1]"'),
    ]
    d = spark.createDataFrame([(i, v, s) for i, (v, s, _) in enumerate(cases)], "i int, v string, s string")
    assert [r["x"] for r in d.select("i", coerce(F.col("v"), F.col("s")).alias("x")).orderBy("i").collect()] == [w for _, _, w in cases]


def test_server_configurations(spark, tmp_path):
    good = '[proxies.a]\ncommand = "run"\nargs = ["-x", "say \\"hi\\""]\nenv = {K = "v", N = 3}\n[proxies.b]\nidle_timeout_seconds = 5\n[proxies.c]\nargs = 7\n[other]\nx = 1\n'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.toml").write_text(good)
    (tmp_path / "in" / "two.toml").write_text("[proxies\n")
    (tmp_path / "in" / "three.toml").write_text("proxies = 3\n")
    got = PX.read_proxies(spark, str(tmp_path / "in"))
    fields = ["name", "command", "args", "env", "idle_timeout_seconds"]
    fine = sorted(tuple(r[f] for f in fields) for r in got.where("error is null").collect())
    assert fine == [("a", "run", ["-x", 'say "hi"'], {"K": "v", "N": "3"}, 600.0), ("b", "", [], {}, 5.0)]
    assert sorted((r["path"].split("/")[-1], r["name"]) for r in got.where("error is not null").collect()) == [("one.toml", "c"), ("two.toml", None)]
    PX.write_proxies(got.where("error is null"), str(tmp_path / "out"))
    again = PX.read_proxies(spark, str(tmp_path / "out"), "*.txt")
    assert sorted(tuple(r[f] for f in fields) for r in again.collect()) == fine


def test_timelines_of_texts_compare_texts(spark):
    rows = spark.createDataFrame([("x", "2024-01-02T00:00", "a"), ("y", "2024-01-10", "b"), ("z", "", "c"), ("w", None, "d"), ("v", "2023-12-31", "e")], "source string, ts string, ref string")
    first, counts = G.timeline([rows], "2024-01-02", 10)
    assert [r["ref"] for r in first.collect()] == ["a", "b", "d", "c"] and counts.count() == 4


def test_tails_read_little(spark, tmp_path):
    big = tmp_path / "t" / "big.jsonl"
    big.parent.mkdir()
    with open(big, "wb") as f:
        f.truncate(1 << 30)  # a sparse gigabyte
        f.seek(0, 2)
        f.write(b"\n" + b"".join(json.dumps({"type": "message", "role": "user", "name": f"n{i}"}).encode() + b"\n" for i in range(100)) + b"not json\n[1]\n")
    (tmp_path / "t" / "empty.jsonl").write_text("")
    (tmp_path / "t" / "few.jsonl").write_text('{"role": "a"}\n{"role": "b"}')
    (tmp_path / "t" / "node_modules").mkdir()
    (tmp_path / "t" / "node_modules" / "x.jsonl").write_text('{"role": "hidden"}\n')
    FI.register(spark)
    got = spark.read.format("tail_lines").option("n", 30).option("skip", "node_modules").load(str(tmp_path / "t"))
    by = {}
    for r in got.orderBy("path", "line").collect():
        by.setdefault(os.path.basename(r["path"]), []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"big.jsonl": 30, "few.jsonl": 2}
    assert by["big.jsonl"][0]["read_bytes"] <= FI.STEP and by["big.jsonl"][-1]["text"] == "[1]"
    turns = FI.transcripts(spark, f"file://{big}", 30)
    assert [r["turn"]["name"] for r in turns.orderBy("line").collect()] == [f"n{i}" for i in range(72, 100)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000])
def test_last_lines_of_long_lines(tmp_path, n):
    lines = ["a" * 200_000, "é" * 70_000, "", "end"]
    (tmp_path / "f").write_text("\n".join(lines) + "\n\n")
    got, _ = FI.last_lines(*FI.opened(str(tmp_path / "f")), n)
    assert got == (lines[-n:] if n else [])


def test_walks_stay_out_of_skipped_folders(spark, tmp_path, monkeypatch):
    for name in ("src/a.py", "src/deep/b.py", "src/empty.py", "src/big.py", "src/c.txt", ".git/d.py", "src/node_modules/e/f.py"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("" if "empty" in name else "x" * (2000 if "big" in name else 5))
    listed = []
    plain = FI.fs.FileSelector
    monkeypatch.setattr(FI.fs, "FileSelector", lambda d: listed.append(d) or plain(d))
    assert len(list(FI.walk(str(tmp_path), frozenset([".git", "node_modules"])))) == 5
    assert not any(".git" in d or "node_modules" in d for d in listed)
    monkeypatch.undo()
    got = FI.walked(spark, str(tmp_path), suffixes=[".py"], skip=[".git", "node_modules"], most=1000)
    assert sorted(os.path.relpath(r["path"], tmp_path) for r in got.collect()) == ["src/a.py", "src/deep/b.py"]
