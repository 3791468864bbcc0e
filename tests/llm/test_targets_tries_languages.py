"""Importance resampling, the prefix trie and language profiles against brute force and on odd rows."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import connect, same, same_types
from pyspark.sql import functions as F

from brindle.llm import languages, queries, resampling, tries
from brindle.llm.common import table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("name", ["op11_resample", "op12_trie"])
def test_sql(name, spark, sf_dir):
    duck = connect(sf_dir)
    got = queries.QUERIES[name](spark, sf_dir)
    same_types(got.schema, duck.sql(queries.ORACLES[name]))
    same(got.toPandas(), duck.execute(queries.ORACLES[name]).df())


# --- importance resampling


def brute_features(text):
    w = WORD.findall((text or "").translate(LOW))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_resample(rows, target, least=20, percent=5):
    own = [(i, *brute_features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in brute_features(x)[1])
    all_s, all_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    out = []
    for i, n, f in own:
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    open_ = sorted((r for r in out if r[1] >= least and r[0] is not None), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(open_[: percent * len(open_) // 100]):
        r[5] = k + 1
    return [(r[0], *r[2:]) for r in out]


def order(rows):
    return sorted(rows, key=lambda r: [(x is not None, x or 0) for x in r])


def texts(seed, n):
    r = random.Random(seed)
    words = ["Ab", "c", "éÉ", "x1", "Zürich", "日本", "q" * 300] + [f"w{i}" for i in range(60)]
    return [r.choice([" ", ", ", "\n", "\x00-"]).join(r.choices(words, k=r.choice([0, 1, 2, 3, 19, 20, 21, 80]))) for _ in range(n)]


@pytest.mark.parametrize("percent", [5, 50])
def test_resampling_equals_brute_force(spark, percent):
    rows = [*enumerate(texts(1, 200)), (500, None), (501, ""), (None, "null id " * 30), (502, "same row " * 30), (502, "same row " * 30), (-3, "İ K ǅ Ω " * 9)]
    target = [*texts(2, 5), None, ""]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id bigint, text string, rank int, _down string, weight int")
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    got = resampling.resample(docs, goal, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert order(map(tuple, got.collect())) == order(brute_resample(rows, target, percent=percent))
    drawn = {r["doc_id"] for r in got.where("rank is not null").collect()}
    assert drawn and {r["doc_id"] for r in resampling.draw(docs, goal, percent=percent).collect()} == drawn


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    goal = spark.createDataFrame([], "item_id bigint, text string")
    assert resampling.resample(none, goal).collect() == []
    rows = list(enumerate(texts(3, 40)))
    got = resampling.resample(spark.createDataFrame(rows, "doc_id bigint, text string"), goal, percent=10)
    assert order(map(tuple, got.collect())) == order(brute_resample(rows, [], percent=10))


def test_a_long_text_is_written_as_runs(spark):
    long = " ".join(f"w{i * i % 977}" for i in range(resampling.LONG * 2 + 7))
    rows = [(1, long), (2, "w1 w4 w9"), (3, "a" * 2_000_000), (4, "b " * 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    packed = resampling.streams(docs).collect()
    assert max(len(r["stream"]) for r in packed) <= 2 * resampling.BUCKETS and sum(r["counts"] is not None for r in packed) == 1
    got = resampling.resample(docs, docs.select(F.col("doc_id").alias("item_id"), "text"))
    assert order(map(tuple, got.collect())) == order(brute_resample(rows, [t for _, t in rows]))


# --- prefix trie


def brute_trie(rows):
    own = defaultdict(list)
    digest = lambda r: hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest()
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, digest(r))):
        own[r[0]].append((r[2] or "", r[3] or ""))
    new = {}
    for c in own:
        lead = zlib.crc32(str(c).encode()) % 4
        new[c] = own.get(c - int(math.fmod(c, 20)), [])[:lead] + own[c][lead:]
    nodes, children = defaultdict(list), defaultdict(list)
    for c in sorted(new):
        for d in range(len(new[c]) + 1):
            nodes[tuple(new[c][:d])].append(c)
    for k in nodes:
        if k:
            children[k[:-1]].append(k)
    out = []

    def visit(k):
        leaves, saved = (sum(x) for x in zip((0, 0), *map(visit, children[k]), strict=True))
        leaves = leaves or 1
        if k:
            saved += (len(nodes[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1]))
        ends = ",".join(str(c) for c in nodes[k] if len(new[c]) == len(k))
        out.append((nodes[k][0], len(k), nodes[k[:-1]][0] if k else None, len(nodes[k]), len(children[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if nodes:
        sys.setrecursionlimit(20_000)
        visit(())
    return out


def nodes_of(spark, rows, parts=3):
    """Extra columns clash with names that the operator uses inside."""
    d = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, place int, least string, n int").repartition(parts)
    conv = F.col("conv_id")
    return tries.trie(*tries.rebuilt(tries.places(d), conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, most=3))


def random_turns(seed, n):
    r = random.Random(seed)
    out = []
    for c in range(-30, n):
        if r.random() < 0.2:
            continue
        script = r.choice(["aaaa", "aaab", "ab", "ba", "abcabc", "a", "aaaaaaaaa"])
        for t in range(r.randint(1, len(script))):
            out.append((c, r.choice([t, t, t, t - t % 2, None]), r.choice(["user", "user", None, ""]), script[t] + " x" * (t % 3)))
    return out


def test_trie_equals_brute_force(spark):
    rows = random_turns(1, 70)
    rows += rows[:9] + [(None, 0, "user", "no id"), (5, None, None, None), (7, 1, "user", ""), (123456, None, None, None)]
    assert order(map(tuple, nodes_of(spark, rows).collect())) == order(brute_trie(rows))


def test_trie_of_long_and_equal_conversations(spark, monkeypatch):
    """One conversation with a third of all rows, a group of copies with another one; rows of the walk and of ends are cut small."""
    monkeypatch.setattr(tries, "SALT", 16)
    rows = [(400, t, "user", f"turn {t % 7}") for t in range(300)] + [(c, t, "user", f"turn {t}") for c in range(1000, 1100) for t in range(3)] + [(c, 0, "user", "turn 0") for c in range(20)]
    assert order(map(tuple, nodes_of(spark, rows, 7).collect())) == order(brute_trie(rows))


def test_trie_of_few_rows(spark):
    assert nodes_of(spark, []).collect() == []
    assert nodes_of(spark, [(None, 1, "a", "b")]).collect() == []
    for rows in ([(41, 0, None, None)], [(c, 0, None, None) for c in (41, 42, 43)]):
        assert order(map(tuple, nodes_of(spark, rows).collect())) == order(brute_trie(rows))


# --- language profiles


def naive_bundle(text, space):
    out = np.zeros(space.dim)
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f" {word} "
        for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
            out += np.roll(space.letter(ord(a)).astype(int), 2) * np.roll(space.letter(ord(b)).astype(int), 1) * space.letter(ord(c)).astype(int)
    return out


def test_bundles_equal_the_definition(monkeypatch):
    rows = ["Hello, wörld!", "a", "", "12 34", "don't\x00stop", "ab" * 50, "Ωmega ωMEGA 日本語"]
    space = languages.Space(64)
    got = languages.bundles(rows, np.arange(len(rows)), len(rows), space)
    assert np.array_equal(got, [naive_bundle(t, languages.Space(64)) for t in rows])
    monkeypatch.setattr(languages, "GRAMS", 5)  # a cache that is too small for a chunk
    assert np.array_equal(got, languages.bundles(rows, np.arange(len(rows)), len(rows), languages.Space(64)))
    monkeypatch.setattr(languages, "PIECE", 7)
    long = "some words and others, " * 9
    parts = languages.pieces(long)
    assert len(parts) > 5 and "".join(parts) == long
    assert np.array_equal(languages.bundles(parts, np.zeros(len(parts), int), 1, space), languages.bundles([long], np.zeros(1, int), 1, space))


def test_held_out_accuracy(spark, sf_dir):
    got = queries.op13_languages(spark, sf_dir)
    assert got.schema.simpleString() == "struct<doc_id:bigint,held_out:boolean,lang_pred:string,score:double>"
    truth = {r["doc_id"]: r["lang"] for r in table(spark, sf_dir, "documents").collect()}
    rows = got.collect()
    assert len(rows) == len(truth) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"]: r["held_out"] for r in rows} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in truth}
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(held) >= 0.99 * len(held)


def test_languages_of_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "the dog", None), (4, None, "en"), (5, "", None), (6, "12 !?", "de"), (7, "und die", None), (7, "und die", None), (None, "the and", "xx"), (8, "the cat and " * 40_000, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, lang string, lang_pred string, SCORE int").coalesce(1)
    model = languages.learn(docs, teaches=F.col("doc_id") <= 6)
    assert sorted(model) == ["de", "en"]
    got = languages.identify(docs, model)
    assert got.columns == [*docs.columns, "_lang_pred", "_score"]
    by = [(r["doc_id"], r["_lang_pred"]) for r in got.collect()]
    assert by == [(1, "en"), (2, "de"), (3, "en"), (4, "und"), (5, "und"), (6, "und"), (7, "de"), (7, "de"), (None, "en"), (8, "en")]
    assert {r["_score"] for r in got.collect() if r["_lang_pred"] == "und"} == {0.0}
    assert {r["_lang_pred"] for r in languages.identify(docs, {}).collect()} == {"und"}
    assert languages.identify(docs.limit(0), languages.learn(docs.limit(0))).collect() == []
    twins = {"b": model["en"], "a": model["en"]}
    assert {r["_lang_pred"] for r in languages.identify(docs.where("doc_id = 1"), twins).collect()} == {"a"}
