"""Rules of reports, selections, workflow state and formats, each on small rows."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from brindle.functions import constants as C
from brindle.functions import scoring as S
from brindle.functions import text as X
from brindle.operators import findings as FI
from brindle.operators import graph as G
from brindle.operators import memory as M
from brindle.operators import merge as MG
from brindle.operators import reports as R
from brindle.operators import scans as SC
from brindle.operators import search as SE
from brindle.operators import selection as SL
from brindle.sources import formats as FM


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def rows(d):
    return sorted(map(tuple, d.collect()), key=str)


def test_default_edges_fire_unless_they_name_something_else(spark):
    e = spark.createDataFrame([("a", "b", "tool", "x_y", None, 1, 0), ("a", "c", "default", None, None, 0, 1), ("a", "d", "default", "other", "stop", 0, 2), ("a", "e", "always", None, None, 5, 3), ("a", "f", "phrase", None, "GO on", 2, 4)], "src string, dst string, kind string, tool string, phrase string, priority int, seq int")
    got = lambda **k: [r["dst"] for r in G.triggered(e, **k).orderBy("place").collect()]
    assert got(tool="mcp__x_y__z") == ["c", "b"] and got(tool="some other") == ["c", "d"]
    assert got(phrase="please go ON") == ["c", "f"] and got(phrase="stop it") == ["c", "d"]
    assert got() == ["c", "d", "e"]


def test_transcripts_count_memory_writes_and_commits(spark):
    blocks = "array<struct<name:string,command:string>>"
    d = spark.createDataFrame([(1, 1, "a", [("mem_memory_set", None), ("Bash", "git commit -m x")]), (1, 2, "a", [("Bash", "git status"), ("Read", "git commit")]), (1, 3, "a", None), (2, 1, "a", [])], f"conv_id int, turn int, role string, content {blocks}")
    assert rows(SC.transcript_tail(d, 3)) == [(1, 3, 1, 1), (2, 1, 0, 0)]
    assert rows(SC.transcript_tail(d, 2)) == [(1, 2, 0, 0), (2, 1, 0, 0)]


def test_visits_are_capped_until_a_reset(spark):
    log = spark.createDataFrame([(1, i, datetime(2024, 1, 1, 0, i), n, r) for i, (n, r) in enumerate([("a", False), ("b", False), ("a", False), ("a", False), ("x", True), ("a", False), ("b", False), ("b", False), ("b", False)])], "project int, seq int, ts timestamp_ntz, to_node string, reset boolean")
    assert [r["taken"] for r in G.taken(log, 2).orderBy("seq").collect()] == [True, True, True, False, True, True, True, False]
    s = G.states(log, 2).first()
    assert (s["current_node"], s["transitions"], s["refused"], s["visits"]) == ("b", 3, 1, 2)
    assert all(r["taken"] for r in G.taken(log, 0).collect())


def test_ready_tasks_after_more_are_done(spark):
    tasks = spark.createDataFrame([(1, t, t == 1) for t in (1, 2, 3, 4)], "node int, task int, done boolean")
    deps = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (1, 4, 3)], "node int, task int, needs int")
    done = spark.createDataFrame([(1, 2)], "node int, task int")
    assert rows(G.ready_delta(tasks, deps, done)) == [(1, 3, "newly_ready"), (1, 4, "blocked")]
    assert rows(G.unknown_needs(tasks, deps.withColumn("needs", F.lit(9)))) == [(1, 9, 2), (1, 9, 3), (1, 9, 4)]
    nodes = spark.createDataFrame([(1, "dag"), (2, "wave"), (3, "dag"), (4, None)], "node int, node_type string")
    assert rows(G.complete(tasks, nodes)) == [(1, False), (2, True), (3, True), (4, False)]


def test_large_graphs_are_peeled_by_joins(spark, monkeypatch):
    deps = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 2), (2, 2, 1), (3, 1, 1), (3, 5, 6)], "node int, task int, needs int")
    want = rows(G.cycle_residual(deps))
    monkeypatch.setattr(G, "GROUP", 1)
    assert rows(G.cycle_residual(deps)) == want == [(1, 1), (1, 2), (1, 3), (3, 1)]


def test_budgets(spark):
    d = spark.createDataFrame([(1, 1, "a" * 30), (1, 2, None), (1, 3, "b" * 30), (1, 4, "c"), (2, 1, "d" * 300), (2, 2, "e")], "g int, o int, text string")
    got = [(r["g"], r["o"], r["text"]) for r in M.cut_to_budget(d, "text", ["o"], "g", 10).orderBy("g", "o").collect()]
    assert got == [(1, 1, "a" * 30), (1, 3, "b" * 30 + "..."), (2, 1, "d" * 50 + "...")]
    d = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 4), (1, 4, 1), (2, 5, 11)], "g int, k int, size int")
    assert rows(M.pack_skipping(d, "size", ["k"], "g", "k", 10)) == [(1, 1), (1, 3), (1, 4)]
    d = spark.createDataFrame([(1, 3), (2, 3), (3, 3)], "id int, size int").withColumn("g", F.lit(0))
    assert [r["id"] for r in M.pack_prefix(d, "size", ["id"], ["g"], 7).collect()] == [1, 2]


def test_security_lines(spark):
    d = spark.createDataFrame([(1, None, None), (2, "high", "resolved"), (3, "low", "open"), (3, "critical", "resolved"), (4, "odd", "open")], "p int, severity string, status string")
    assert [r["line"] for r in R.security(d, "p").orderBy("p").collect()] == ["No security findings", "Security: 1 total findings (all resolved/suppressed)", "Security: 1 open findings (1 critical, 1 low)", "Security: 1 open findings"]


def test_formatters(spark):
    items = F.expr("array(named_struct('pattern', 'p', 'description', 'd', 'occurrences', 3, 'examples', array('x', 'y', 'z')))")
    text = value(spark, R.checklist_text(F.lit("feature"), F.lit(7), items, F.array(F.lit("n1"))))
    assert text == "## Implementation Checklist: feature\n_Derived from 7 past experience entries._\n\n### Files to create\n\n- [ ] `p` — d _(seen 3x)_\n  - e.g. `x`\n  - e.g. `y`\n\n### Conventions observed\n\n- n1"
    long = value(spark, R.checklist_text(F.lit("t"), F.lit(1), F.array_repeat(items[0], 200), F.array().cast("array<string>")))
    assert len(long) <= 3000 and long.endswith("\n\n_(checklist truncated)_")
    assert "_No recurring patterns found" in value(spark, R.checklist_text(F.lit("t"), F.lit(1), F.slice(items, 1, 0), F.array().cast("array<string>")))
    files = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: i.cast("string"))
    got = value(spark, R.next_task_text(F.lit(" done \n"), F.lit("it"), files, F.lit("now")))
    assert got.startswith("## Previous task summary (continuity context)\n**Was:** it\ndone\n\n**Files touched last time:** `1`, `2`") and got.endswith("`10` (+2 more)\n\n_(saved now)_")
    assert value(spark, R.next_task_text(F.lit(None).cast("string"), F.lit("it"), files, F.lit("now"))) == ""
    assert value(spark, R.fix_line(F.lit("x" * 400), F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")))) == "x" * 300 + " (files: a, b, c)"
    assert value(spark, R.fix_line(F.lit(""), F.array(F.lit("a")))) is None
    assert value(spark, X.context_text(F.lit("t"), F.lit("n"), F.lit(""), F.lit(" b \n"))) == "[t] n\nb"


def test_skills_in_order_and_once(spark):
    nodes = spark.createDataFrame([(1, "Test and REVIEW")], "node int, text string")
    languages = spark.createDataFrame([(1, "go", 1), (1, "go", 2)], "node int, language string, seq int")
    smells = spark.createDataFrame([(1, "orphan", 1), (1, "god_file", 2), (1, "none", 3), (1, "hub_overload", 4)], "node int, type string, seq int")
    got = [(r["skill"], r["section"]) for r in FI.select_skills(nodes, languages, smells).orderBy("place").collect()]
    assert got == [("go-patterns", ""), ("dev-patterns", "architecture.md"), ("qa-patterns", "best-practices.md"), ("dev-patterns", "architecture.md#module-organization"), ("dev-patterns", "design-patterns.md#single-responsibility")]


def test_small_rules(spark):
    assert value(spark, X.commit_type(F.lit("PERF: x"))) == "performance_fix" and value(spark, X.commit_type(F.lit("docs"))) == "general"
    assert value(spark, X.is_test(F.lit("a/Tests/x.py"))) and not value(spark, X.is_test_name(F.lit("tests/x.py"))) and value(spark, X.is_test_name(F.lit("a/x_test.go")))
    assert value(spark, X.skipped(F.lit("a/dist/x"))) and not value(spark, X.skipped(F.lit("a/x.py")))
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))
    assert value(spark, S.jaccard(a, b)) == pytest.approx(1 / 3) and value(spark, S.jaccard(a, F.array().cast("array<string>"))) == 0
    assert value(spark, S.blend(F.lit(0.5), F.lit(1.0))) == pytest.approx(0.7)
    assert value(spark, X.change_hash(F.lit("d"), F.lit('{"b":1,"a":{"d":1,"c":2}}'))) == value(spark, X.change_hash(F.lit("d"), F.lit('{"a": {"c": 2, "d": 1}, "b": 1}')))
    assert value(spark, X.schema_properties(F.lit('{"properties": {"b": {}, "a": {}}}'))) == ["a", "b"] and value(spark, X.schema_properties(F.lit("{}"))) == []
    assert value(spark, X.status_path(F.lit('R  "a b" -> "c d"'))) == "c d" and value(spark, X.status_code(F.lit("?? x"))) == "??"
    assert value(spark, X.mentioned_source(F.lit("in lib/a.py and src/b.py"))) == "lib/a.py" and value(spark, X.said_smells(F.lit("now 12 smells"))) == 12
    base, own = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))
    assert value(spark, MG.overridden(base, own)) == {"a": 1, "b": 3}
    assert value(spark, FM.coerce_array(F.lit('["a", "b"]'))) == ["a", "b"] and value(spark, FM.coerce_array(F.lit("a b"))) == ["a b"]
    assert value(spark, F.to_json(FM.coerce_object(F.lit('{"a": 1}')))) == '{"a":1}' and value(spark, FM.coerce_object(F.lit("[1]")).isNull())
    content = F.expr("array(named_struct('type', 'image', 'text', ''), named_struct('type', 'text', 'text', '{}'))")
    assert value(spark, FM.envelope_text(content)) == "{}"
    now = F.lit("2024-01-01 02:00:00").cast("timestamp_ntz")
    assert value(spark, FM.fresh(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), now, 7200)) and not value(spark, FM.fresh(F.lit("2023-12-31 23:59:59").cast("timestamp_ntz"), now, 7200))
    assert len(C.STOPWORDS) == len(set(C.STOPWORDS)) and len(C.NOTE_STOPWORDS) == len(set(C.NOTE_STOPWORDS))
    assert value(spark, X.query_tokens(F.lit("más nosotros también"))) == ["más", "nosotros", "también"]
    assert value(spark, X.note_tokens(F.lit("this list mucho"))) == ["list", "mucho"]


def test_stores(spark):
    old = spark.createDataFrame([("m1", "a", "h"), ("m2", "b", "h")], "mcp string, k string, h string")
    new = spark.createDataFrame([("m1", "a", "h"), ("m2", "b", "x")], "mcp string, k string, h string")
    assert rows(MG.hits_and_misses(old, new, ["k"], "h").select("k", "hit")) == [("a", True), ("b", False)]
    assert rows(MG.without(old, "mcp", "m1")) == [("m2", "b", "h")]
    both = spark.createDataFrame([("t", "p", "d", 0.5, 0), ("t", "p", "d", 0.5, 1), ("t", "q", "d", 0.9, 0), ("t", "q", "d", 0.5, 1)], "type string, file_pattern string, domain string, confidence double, own int")
    assert rows(MG.store_merge(both).select("file_pattern", "own")) == [("p", 1), ("q", 0)]
    calls = spark.createDataFrame([(1, "proxy", "bad"), (1, "bad", None), (2, "x", None)], "node int, tool string, inner string")
    rules = spark.createDataFrame([(1, ["bad"]), (2, ["*"])], "node int, tools array<string>")
    assert rows(SL.blocked(calls, rules, [])) == [(1, "bad", True), (1, "bad", True), (2, "x", True)]
    files = spark.createDataFrame([("a/index.ts",), ("b/zzz.ts",)], "path string")
    target = spark.createDataFrame([("a/q/index.ts",), ("b/x/other.ts",)], "path string")
    assert [r["file"] for r in SL.similar_paths(files, target, least=4.5).collect()] == []
    assert [r["file"] for r in SL.similar_paths(files, target, least=4.5, generic=("index",)).collect()] == ["a/index.ts"]


def test_selection_in_the_last_results(spark):
    s = spark.createDataFrame([(1, 1, datetime(2024, 1, 1), ["a"]), (1, 3, datetime(2024, 1, 3), ["b"])], "project int, seq int, ts timestamp_ntz, results array<string>")
    c = spark.createDataFrame([(1, 2, datetime(2024, 1, 2), "a"), (1, 4, datetime(2024, 1, 4), "a"), (2, 5, datetime(2024, 1, 4), "a")], "project int, seq int, ts timestamp_ntz, tool string")
    assert rows(SE.asof_selection(s, c)) == [(1, 2, 1, True), (1, 4, 3, False), (2, 5, None, False)]


def test_rules_agree_with_regular_expressions(spark):
    text = "import os\nfrom a import *\ndef f(x=[]):\n    os.system('x')\nlet y: any = 1 // @ts-ignore\nfunc f() { panic(1) }\nx.unwrap() unsafe { }\n$a = @file(); eval (1) if ($a == 2)\nlocal t = 1\nfoo = 2\nList raw = x.get();\nobj as! Foo\nresult = result .. 'x'\n"
    found = {r["rule"]: (r["n"], r["line"]) for r in SC.rule_scan(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text", SC.flat_rules()).collect()}
    want = {}
    for name, rule in SC.flat_rules().items():
        hits = list(re.finditer(rule, text))
        if hits:
            want[name] = (len(hits), text.count("\n", 0, hits[0].start()) + 1)
    assert found == want and len(found) >= 14


def test_stores_of_files(spark, tmp_path):
    from brindle.functions.constants import STORE_ROWS

    e = spark.range(STORE_ROWS + 5).selectExpr("cast(id as string) as id", "id / 1000.0 as confidence", "'2024' as last_seen")
    FM.write_experience(e, str(tmp_path / "exp"))
    got = FM.read_experience(spark, str(tmp_path / "exp"))
    assert got.count() == STORE_ROWS and got.where("id = '4'").isEmpty()
    notes = spark.createDataFrame([("n1", "user", "high", ["a", "b"], "Body\nmore"), ("n2", "user", "low", [], "x")], "id string, type string, priority string, tags array<string>, body string")
    FM.write_notes(notes, str(tmp_path / "notes"))
    texts = [p.read_text() for p in sorted((tmp_path / "notes").glob("note=*/*.txt"))]
    assert texts[0] == "---\nid: n1\ntype: user\npriority: high\ntags:\n- a\n- b\n---\nBody\nmore\n" and len(texts) == 2
    j = spark.createDataFrame([("1", "r", "c")], "id string, ref string, commit string")
    FM.append_journal(j, str(tmp_path / "j"))
    FM.append_journal(j, str(tmp_path / "j"))
    assert FM.read_journal(spark, str(tmp_path / "j")).count() == 2
    old = spark.createDataFrame([(1, i, 0.5) for i in range(4)], "project int, ts int, debt double")
    more = spark.createDataFrame([(1, 9, 3)], "project int, ts int, smells int")
    assert sorted((r["ts"], r["smells"]) for r in FM.append_trends(old, more, "project", ["ts"], 3).collect()) == [(2, None), (3, None), (9, 3)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.jsonl").write_text('{"role":"a"}\n{"role":"b","content":[{"name":"Bash","input":{"command":"git commit"}}]}\nbroken\n{"role":"c"}\n')
    (tmp_path / "t" / "b.jsonl").write_text('{"role":"long"}\n' * 50)
    got = FM.read_transcripts(spark, str(tmp_path / "t"), 3, most=200)
    assert [r["turn"]["role"] for r in got.orderBy("line").collect()] == ["b", "c"]
    v = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>")
    assert [r["x"] for r in v.select(FM.unpack_floats(FM.pack_floats(F.col("v"))).alias("x")).collect()] == [[1.5, -2.0], None]
    (tmp_path / "agents").mkdir()
    (tmp_path / "agents" / "a.md").write_text("---\nname: one\ndescription: >\n  two\n  lines\ntools: [a, 'b']\nskills:\n- s1\n- s2\nnote: |\n  x\n  y\n---\nText\n")
    r = FM.read_agents(spark, str(tmp_path / "agents")).first()
    assert r["fields"] == {"name": "one", "description": "two lines", "note": "x\ny"} and r["lists"] == {"tools": ["a", "b"], "skills": ["s1", "s2"]} and r["body"] == "Text"


def test_catalogs_by_server(spark, tmp_path):
    path = str(tmp_path / "catalog")
    tools = spark.createDataFrame([("m1", "a"), ("m1", "b"), ("m2", "c")], "mcp_name string, tool_name string")
    FM.write_catalog(tools, path)
    FM.write_catalog(spark.createDataFrame([("m1", "z")], tools.schema), path)
    assert rows(FM.read_catalog(spark, path).select("mcp_name", "tool_name")) == [("m1", "z"), ("m2", "c")]
    one = FM.read_catalog(spark, path, "m2")
    assert "PartitionFilters: [isnotnull(mcp_name" in one._jdf.queryExecution().toString() and one.count() == 1
    assert FM.drop_from_catalog(spark, path, "m1") and not FM.drop_from_catalog(spark, path, "m1")
    assert FM.read_catalog(spark, path).count() == 1


def test_more_sources(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "flow.yaml").write_text("metadata:\n  name: 'Own name'\nnodes:\n- id: a\nedges:\n")
    (tmp_path / "w" / "other.yml").write_text("nodes:\nedges:\n")
    (tmp_path / "w" / "no.yaml").write_text("nodes:\n")
    assert sorted(r["name"] for r in FM.list_workflows(spark, str(tmp_path / "w")).collect()) == ["Own name", "other"]
    (tmp_path / "w" / "node_modules").mkdir()
    (tmp_path / "w" / "node_modules" / "x.py").write_text("x")
    (tmp_path / "w" / "a.py").write_text("x")
    (tmp_path / "w" / "empty.py").write_text("")
    (tmp_path / "w" / "big.py").write_text("x" * 50)
    got = FM.representative_files(spark, str(tmp_path / "w"), [".py"], ["node_modules"], 20)
    assert [r["path"].rsplit("/", 1)[1] for r in got.collect()] == ["a.py"]
    j = spark.createDataFrame([("p", str(i), float(i)) for i in range(5)] + [("q", "9", 1.0)], "project string, id string, created_at double")
    assert rows(FM.prune_journal(j, "project", 2).select("project", "id", "place")) == [("p", "3", 2), ("p", "4", 1), ("q", "9", 1)]
    (tmp_path / "tr.json").write_text('[{"timestamp": "2024-01-01T00:00:00", "project": "p", "smell_count": 3}, {"timestamp": "soon", "project": "p"}, {"project": "p"}]')
    r = FM.read_trends(spark, str(tmp_path / "tr.json")).collect()
    assert len(r) == 1 and r[0]["smell_count"] == 3 and r[0]["debt_score"] is None and r[0]["ts"] == datetime(2024, 1, 1)
    paths = spark.createDataFrame([("/a/b_c",), ("/a/bxc",), ("/a/b_cd",)], "p string")
    assert FM.scoped_count(paths, "p", "/a/b_c") == 2


def test_workflow_texts(spark):
    text = "nodes:\n  - id: a\n    name: First\n    is_start: true\n    tools_blocked: [x, y]\n  - id: b\n    is_end: true\nedges:\n  - id: e\n    from: a\n    to: b\n    condition:\n      type: always\n    priority: 1\n"
    assert rows(FM.blocked_tools(spark, text)) == [("a", ["x", "y"]), ("b", [])]
    assert rows(FM.workflow_steps(spark, "steps:\n  - id: s1\n    name: One\n    tools_blocked:\n      - t\n  - name: Two\n")) == [(0, "s1", "One", ["t"]), (1, "1", "Two", [])]
    nodes, edges, _ = FM.graph_frames(spark, text)
    again = FM.graph_frames(spark, FM.graph_text(nodes, edges))
    assert rows(again[0]) == rows(nodes) and [r[:4] for r in rows(again[1])] == [r[:4] for r in rows(edges)]
    assert FM.mermaid(nodes, edges, "a") == "graph TD\n    a([First])\n    b([b])\n    a -->|always| b\n    style a fill:#90EE90"
    assert value(spark, FM.is_workflow(F.lit(text))) and not value(spark, FM.is_workflow(F.lit("nodes:\n")))


def test_streams_of_first_rows_counts_and_baselines(spark, tmp_path):
    from brindle.streaming import stateful as ST

    e = spark.createDataFrame([(1, 1, datetime(2024, 1, 1, 0, 10)), (1, 1, datetime(2024, 1, 1, 0, 20)), (2, 1, datetime(2024, 1, 1, 1, 5))], "key int, x int, ts timestamp")
    e.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    for name, flow, mode, want in [("once", ST.once(read(), ["key"]), "append", 2), ("counts", ST.counts(read(), "key"), "complete", 2)]:
        q = flow.writeStream.format("memory").queryName(f"s_{name}").outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(f"s_{name}").count() == want
    f = lambda k: spark.createDataFrame([("t", x) for x in k], "type string, file string")
    f(["a"]).write.parquet(str(tmp_path / "f" / "1"))
    seen = []
    flow = spark.readStream.schema(f(["a"]).schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "f"))
    for k in (["a"], ["a", "b"]):
        f(k).write.mode("overwrite").parquet(str(tmp_path / "f" / str(len(k))))
        q = ST.rotate_baseline(flow, str(tmp_path / "base"), lambda d, n: seen.append(sorted(r["file"] for r in d.collect()))).option("checkpointLocation", str(tmp_path / "rot")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert seen == [["b"]]
