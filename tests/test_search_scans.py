"""Filtered searches, blocked top-k and scans of many patterns against the plain ways."""

import difflib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.operators import patterns as P
from brindle.operators import scans as SC
from brindle.operators import search as SE


def catalog(spark, n=400):
    r = random.Random(6)
    words = "find search file list tool graph memory read write query index delete update note the of".split()
    rows = [(f"m{i % 5}", "_".join(r.choices(words, k=r.randint(1, 3))), " ".join(r.choices(words, k=r.randint(0, 25))) or None, i, r.choice([0.0, 0.0, 0.3])) for i in range(n)]
    return spark.createDataFrame(rows, "mcp_name string, tool_name string, description string, seq int, boost double")


def test_index_search_verifies_few_rows_and_finds_the_same(spark):
    tools, query = catalog(spark), "find the memory graph file"
    every = SE._index_scores(SE.index_bounds(tools, query), query, 0.15)
    for r in every.collect():
        assert r["raw"] <= r["bound"]
    want = [tuple(r) for r in every.select("mcp_name", "tool_name", "score", "seq").orderBy(F.desc("score"), "seq").limit(10).collect()]
    got = SE.index_search(tools, query, 10)
    assert [(r["mcp_name"], r["tool_name"], r["score"], r["seq"]) for r in got.collect()] == want
    assert len(want) <= SE.index_candidates(tools, query, 10).count() < 100
    assert SE.index_search(tools.limit(0), query).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc _", max_size=12), st.text(alphabet="abcd ", max_size=30))
def test_letters_bound_the_ratio(a, b):
    from collections import Counter

    shared = sum((Counter(a) & Counter(b)).values())
    total = len(a) + len(b)
    assert difflib.SequenceMatcher(None, a, b).ratio() <= (2 * shared / total if total else 1.0)


def test_blocked_topk_equals_one_query_at_a_time(spark):
    r = np.random.default_rng(2)
    vecs = [(i, [float(x) for x in np.round(r.normal(size=8), 1)]) for i in range(300)] + [(300, [0.0] * 8), (301, None), (302, [1.0] * 7), (303, [float("nan")] * 8), (304, [1.0] * 8), (305, [1.0] * 8)]
    rows = spark.createDataFrame(vecs, "seq int, embedding array<float>").repartition(5)
    asked = rows.where("seq % 7 = 0 or seq >= 300").select(F.col("seq").alias("query"), "embedding")
    want = []
    unit = {i: np.zeros(8) if v is None or len(v) != 8 or not np.isfinite(v).all() or not any(v) else np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for i, v in vecs}
    for q in [i for i, _ in vecs if i % 7 == 0 or i >= 300]:
        best = sorted((-(round(float(unit[q] @ v), 6) + 0.0), i) for i, v in unit.items())[:5]
        want += [(q, k + 1, i, -s + 0.0) for k, (s, i) in enumerate(best)]
    for block in (1 << 20, 8 * 8 * 10):  # one pass, and ten queries a pass
        got = SE.vector_topk_many(rows, asked, 5, block=block).collect()
        assert sorted((r["query"], r["rank"], r["seq"], r["score"]) for r in got) == sorted(want)
    assert SE.vector_topk_many(rows, asked.limit(0), 5).collect() == []


TEXTS = ["", None, "x: any = 1\n// @ts-ignore\nenum Foo", "def f(a=[]):\n  try:\n    pass\n  except:\n    os.system('x')", "let x = y.unwrap();\nunsafe { }", "a = b\nlocal c = d\nresult = result .. x", "if ($a == $b) @foo; eval (x)", "x as! Y; Timer.scheduledTimer (", "foo.get() ;\nList x = 1\n@Autowired private", "x" * 100_000 + " panic(", "subprocess.run(a, shell=True)" * 3]


def test_style_rules_equal_running_every_rule(spark):
    rules = SC.flat_rules()
    d = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").repartition(3)
    want = []
    for i, t in enumerate(TEXTS):
        for name, rule in rules.items():
            found = list(re.finditer(rule, t or ""))
            if found:
                want.append((i, name, len(found), (t or "").count("\n", 0, found[0].start()) + 1))
    got = sorted(map(tuple, SC.rule_scan(d, "id", "text", rules).collect()))
    assert got == sorted(want) and len({w[1] for w in want}) > 15
    own = P.Patterns(rules)
    assert len(own.always) <= 3 and own.possible("nothing of that kind") == sorted(own.always)


def test_needed_texts():
    assert P.needed(r"(?m)^from\s+\S+\s+import\s+\*") == ("import",)
    assert P.needed(r"\b(?:List|Map|Set)\s+\w+\s*=") == ("List", "Map", "Set")
    assert P.needed(r"(?i)abc") == () and P.needed(r"(?i:abc)d") == ("d",) and P.needed(r"a?b*") == ()
    assert P.needed(r"(abc|d)(ef)+") == ("ef",) and P.needed(r"(?<!=)ab\b(?=x)c") == ("abc",)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([r"a(b|cc)?d+", r"(ab|ba){2}", r"\bab\b", r"(?:a|bc)(?!d)", r"[ab]c{2,}", r"(?i:A)bc|cab", r"a.b(?=c)", r"(a+|b)c", r"(?>ab|a)c"]), st.text(alphabet="abcd A", max_size=12))
def test_matches_hold_what_is_needed(rule, text):
    needs = P.needed(rule)
    if re.search(rule, text):
        assert not needs or any(x in text for x in needs)
        assert P.Patterns({"r": rule}).possible(text) == [0]
