"""Dedup, joins, search, extraction, sharding and the pipeline against brute force."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from compare import connect, same

import corpus_pipeline
from brindle.llm import components, curves, jaccard, queries, sharding, substrings, templates


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "s", "l", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, key string, n bigint")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(seed=0):
    """Random texts, copies, near copies, a passage that many share, short and odd texts."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "ß", "A", "a"]
    text = lambda n: " ".join(r.choices(vocab, k=n))
    out = [None, "", " \n", "one two", "One TWO", "a b c d e", text(34), text(35)]
    base = [text(r.choice([20, 60, 200, 400])) for _ in range(30)]
    out += base + base[:4] * 3
    for t in base[:10]:
        for _ in range(4):
            w = t.split(" ")
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w))
    passage = text(60)
    out += [f"{text(r.randint(5, 80))}\n{passage}\t{text(r.randint(5, 80))}" for _ in range(15)]
    out += [base[20][: len(base[20]) // 2], "x " * 100, "x " * 36, "y z " * 40, f"{text(50)} {passage} {text(9)} {passage}"]
    r.shuffle(out)
    return out


def brute_components(texts, ids):
    sets = []
    for t in texts:
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    u = components.Union()
    for i in range(len(sets)):
        u.find((ids[i], i))
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                u.join((ids[i], i), (ids[j], j))
    return [(ids[i], len(s), u.find((ids[i], i))[0]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("rare", [jaccard.RARE, 2])
def test_jaccard_classes(spark, rare, monkeypatch):
    monkeypatch.setattr(jaccard, "RARE", rare)
    texts = corpus(1)
    ids = [1000 - 3 * i for i in range(len(texts))]
    got = jaccard.classes(docs_of(spark, texts, ids).repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(texts, ids))


def test_jaccard_cuts_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BYTES", 9000)
    monkeypatch.setattr(jaccard, "RARE", 3)
    cut = []
    units = jaccard._units
    monkeypatch.setattr(jaccard, "_units", lambda *a: cut.append(units(*a)) or cut[-1])
    texts = corpus(2)
    got = jaccard.classes(docs_of(spark, texts).repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(texts, list(range(len(texts)))))
    assert cut[0][1]
    assert jaccard.classes(docs_of(spark, texts).limit(0)).count() == 0


def test_jaccard_with_hot_shingles_and_clashing_keys(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 1)
    monkeypatch.setattr(jaccard, "LEAST", 2)
    texts = corpus(7)
    docs = docs_of(spark, texts).selectExpr("doc_id as key", "text as `class`", "n as a", "n as least")
    got = jaccard.classes(docs.repartition(3), id_col="key", text_col="class")
    assert sorted(map(tuple, got.collect())) == sorted(brute_components(texts, list(range(len(texts)))))
    # Sets whose first keys are equal are told apart by the second.
    sets = jaccard.shingle_sets(["a b c d e f", "g h i j k l"])
    one, other = map(jaccard.set_keys, sets)
    assert len({*one, *other}) == 4
    assert jaccard.set_key(sets[0], frozenset([one[0]])) == one[1] and jaccard.set_key(sets[1], frozenset([one[0]])) == other[0]


@pytest.mark.parametrize("size", [jaccard.BYTES, 9000])
def test_jaccard_pairs_are_all_links(spark, size, monkeypatch):
    monkeypatch.setattr(jaccard, "BYTES", size)
    texts = corpus(8)
    sets = {}
    for i, t in enumerate(texts):
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if w:
            sets.setdefault(frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))), i)
    want = sorted((i, j) for a, i in sets.items() for b, j in sets.items() if i < j and 100 * len(a & b) >= 75 * len(a | b))
    assert sorted(map(tuple, jaccard.pairs(docs_of(spark, texts).repartition(3)).collect())) == want and len(want) > 20


def test_units_are_bounded_by_bytes(spark, monkeypatch):
    """Blocks of few large sets do not meet in one unit; blocks of many small ones share units of GROUP sets at most."""
    monkeypatch.setattr(jaccard, "BYTES", 80_000)
    monkeypatch.setattr(jaccard, "GROUP", 10)
    nodes = [(1000 * b + i, b) for b in range(1, 40) for i in range(4)]
    size = lambda key: 2000 if key // 1000 % 2 else 3
    d = spark.createDataFrame(nodes, "key bigint, root bigint")
    sizes = spark.createDataFrame([(k, size(k)) for k, _ in nodes], "key bigint, n bigint")
    units, cut, n = jaccard._units(d, sizes, 0.75)
    by = {}
    for r in units.collect():
        by.setdefault(r["unit"], []).append(r["key"])
    assert not cut and n == len(nodes) and sorted(k for x in by.values() for k in x) == sorted(k for k, _ in nodes)
    assert all(8 * sum(map(size, x)) <= 2 * 80_000 and len(x) <= 2 * 10 + 4 for x in by.values())


def test_jaccard_keeps_one_of_each_class(spark):
    texts = corpus(3)
    ids = list(range(len(texts)))
    docs = docs_of(spark, texts).unionByName(docs_of(spark, texts).where("doc_id = 5"))
    got = jaccard.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({c for _, _, c in brute_components(texts, ids)})


def test_traversal_finds_all_links_and_prunes():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 1 << 62, rng.integers(3, 60)).astype(np.uint64)) for _ in range(60)]
    sets = base + [np.unique(np.append(s[: max(1, int(len(s) * q))], rng.integers(0, 1 << 62, 2).astype(np.uint64))) for s in base for q in (0.7, 0.9, 1.0)]
    union, compared = jaccard.traverse(sets)
    want = components.Union()
    for i in range(len(sets)):
        want.find(i)
        for j in range(i):
            if jaccard.linked(sets[i], sets[j]):
                want.join(i, j)
    assert [union.find(i) for i in range(len(sets))] == [want.find(i) for i in range(len(sets))]
    assert compared < len(sets) * (len(sets) - 1) / 2 / 3


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(7)).collect()))
    u = components.Union()
    for a, b in edges:
        u.join(a, b)
    assert got == {x: u.find(x) for x in got} and set(got) == {x for e in edges for x in e if e[0] != e[1]}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def brute_removed(texts, width=35):
    count = collections.Counter(tuple(w[i : i + width]) for t in texts for w in [words_of(t)] for i in range(len(w) - width + 1))
    out = []
    for t in texts:
        w = words_of(t)
        gone = {i + j for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for j in range(width)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("seed", "group"), [(5, substrings.GROUP), (6, substrings.GROUP), (5, 3), (6, 1)])
def test_substrings(spark, seed, group, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", group)
    monkeypatch.setattr(substrings, "BATCH_WORDS", 300)
    grown = []
    lengthened = substrings._lengthened
    monkeypatch.setattr(substrings, "_lengthened", lambda *a: grown.append(1) or lengthened(*a))
    texts = corpus(seed)
    got = substrings.remove(docs_of(spark, texts).repartition(4), digest=True).collect()
    assert sorted(map(tuple, got)) == sorted((i, *x) for i, x in enumerate(brute_removed(texts)))
    assert bool(grown) == (group < substrings.BATCH_WORDS)
    assert substrings.remove(docs_of(spark, texts).limit(0)).count() == 0


def test_spans_are_the_maximal_repeats(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    texts = [f"a b {passage} c", f"{passage} d e", "none here", None]
    got = {r["doc_id"]: [(s["start"], s["stop"]) for s in r["spans"]] for r in substrings.spans(docs_of(spark, texts)).collect()}
    assert got == {0: [(2, 52)], 1: [(0, 50)], 2: [], 3: []}


def test_suffix_arrays_agree_with_sorting():
    rng = np.random.default_rng(2)
    for width in (3, 7, 8):
        codes = rng.integers(0, 3, 400).astype(np.uint64)
        starts = np.arange(len(codes) - width + 1)
        order, same = substrings.suffix_array(codes, starts, width)
        runs = [codes[i : i + width].tolist() for i in order]
        assert runs == sorted(runs) and same[1:].tolist() == [a == b for a, b in zip(runs, runs[1:])]


def test_stages_keep_columns_with_clashing_names(spark):
    texts = corpus(4)
    docs = docs_of(spark, texts).selectExpr("*", "n as _id", "n as rest", "n as _rest", "n as tid", "n as _tid", "n as some", "n as bit", "n as copied", "n as blocks", "n as ranges", "n as _root", "n as kept")
    for out in (substrings.cut(docs), jaccard.keep_one(docs)):
        assert out.columns == docs.columns
        for r in out.collect():
            assert len({r[c] for c in docs.columns[4:]}) == 1 and (r["text"] is None or r["text"] in texts or r["doc_id"] == r["n"])


def test_cutting_keeps_columns_and_white_space(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"first line\n\n{passage} tail  end", f"{passage}\nother", passage, None, "short  text\n"]
    got = {r["doc_id"]: r["text"] for r in substrings.cut(docs_of(spark, texts)).collect()}
    assert got == {0: "first line\n\ntail  end", 1: "other", 3: None, 4: "short  text\n"}
    assert substrings.cut(docs_of(spark, texts)).columns == docs_of(spark, texts).columns


def test_sql_of_the_dedup_queries(spark, sf_dir):
    duck = connect(sf_dir)
    for name, sql in queries.ORACLES.items():
        same(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(sql).df())


def test_hilbert_keys_are_a_walk():
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    walk = cells[np.argsort(curves.hilbert(cells, 3))]
    assert len(np.unique(curves.hilbert(cells, 3))) == side**3
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_search_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * rng.uniform(0.5, 2, (3000, 1))
    x[100:160] = 2.5 * x[100] / np.linalg.norm(x[100])  # copies, nearest to each other
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(9000, None, 1), (9020, [0.0] * 16, 1), (9040, [float("nan")] * 16, 1), (9060, [None] + [1.0] * 15, 1), (9080, [1.0] * 3, 1), (9100, [float("inf")] * 16, 1)]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = collections.defaultdict(list)
    for r in curves.nearest(d, d.where("vec_id % 20 = 0"), 20, piece=128, asks=16).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    assert set(got) == set(range(0, 3000, 20))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        top = np.lexsort((np.arange(3000), -s))[:20]
        hits += len({i for i, _, _ in found} & set(top.tolist()))
        assert [k for _, _, k in found] == list(range(1, 21)) and q not in {i for i, _, _ in found}
        assert np.allclose([v for _, v, _ in found], s[[i for i, _, _ in found]], atol=1e-12)
    assert hits >= 0.9 * 20 * len(got)
    assert [i for i, _, _ in got[100]] == list(range(101, 121)) and [i for i, _, _ in got[120]] == list(range(100, 120))
    few = curves.nearest(d.where("vec_id < 5"), d.where("vec_id < 5"), 20).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in few} == dict.fromkeys(range(5), 4)
    assert curves.nearest(d.limit(0), d, 20).count() == 0


@pytest.mark.parametrize("folder", ["sf0.1", "check_l"])
def test_search_recall_on_tables(spark, folder):
    folder = f"/root/testdata/{folder}"
    if not os.path.isdir(folder):
        pytest.skip("no such table")
    rows = queries.table(spark, folder, "embeddings")
    t = rows.toArrow()
    ids = t["vec_id"].to_numpy()
    x = np.array(t["embedding"].to_pylist(), float)
    got = collections.defaultdict(set)
    for r in queries.op4_curves(spark, folder).select("query_id", "vec_id").collect():
        got[r["query_id"]].add(r["vec_id"])
    ask = np.flatnonzero(ids % 20 == 0)
    assert set(got) == set(ids[ask].tolist())
    hits = 0
    for part in np.array_split(ask, 20):
        s = x[part] @ x.T
        s[np.arange(len(part)), part] = -np.inf
        top = ids[np.argpartition(-s, 20, axis=1)[:, :20]]
        hits += sum(len(got[i] & set(n)) for i, n in zip(ids[part].tolist(), top.tolist(), strict=True))
    assert hits >= 0.9 * 20 * len(ask)
    assert len(ids) < 10_000 or curves.products(len(ids)) < len(ids)


def test_search_takes_repeated_ids_and_clashing_columns(spark):
    rows = [(i % 30, [float(i % 30 % 7 + 1), float(i % 30 % 5), 1.0], "x") for i in range(60)]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, cid string").selectExpr("*", "cid as h", "cid as vec", "cid as slot", "cid as near", "1 as rank")
    got = curves.nearest(d, d.where("vec_id = 0"), 100).orderBy("rank").collect()
    assert {r["query_id"] for r in got} == {0} and sorted(r["vec_id"] for r in got) == list(range(1, 30))
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)


def test_plans_hold_windows_and_bound_tasks():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 50, 200)
    rows[17] = 5000
    asked = rows // 5
    p = curves.plan(rows, asked, 120, 7, piece=300, asks=40)
    behind = np.cumsum(rows)
    for f in range(200):
        assert p.lo[f] <= f <= p.hi[f]
        assert p.lo[f] == 0 or behind[f] - rows[f] - (behind[p.lo[f]] - rows[p.lo[f]]) >= 120 or rows[: p.lo[f]].sum() == 0
        assert p.hi[f] == 199 or behind[p.hi[f]] - behind[f] >= 120
    held = np.bincount(p.piece, rows)
    assert (held / p.parts <= 300).all() and p.slot[0] == 7 and (np.diff(p.slot) == (p.parts * p.asks)[:-1]).all()


PAGE = """<!DOCTYPE html><html><head><title>T {n}</title><script>var x = "<p>no</p>";</script><style>p{{}}</style></head><body>
<header>Site name</header><nav><ul><li><a href="/a">Menu {n}</a></li></ul></nav><div class="ad">Buy {n}</div><div id="cookie-notice">We use cookies</div>
<article><h1>Title {n}</h1><p>Body  of\n{n} &amp; more<br>next <b>bo</b>ld <p>open</p><form><input><label>Mail</label></form><div class="comments"><p>Reader {n}</p></div></article>
<aside>Side {n}</aside><!-- note --><footer>&copy; {n}</footer></body></html>"""


def test_extraction(spark):
    pages = [(i, f"http://h{i % 2}.org/p{i}", PAGE.format(n=f"no{i}")) for i in range(8)]
    pages += [(20, "http://h0.org/x", None), (21, None, ""), (22, "http://solo.org/", PAGE.format(n="solo")[:-60]), (23, "http://h1.org/", "<article>cut off <b>here</b> &am"), (24, "http://h1.org/", "<article>cut <di")]
    plain = "<html><body><div class='menu'><a href='/'>Home page of us</a></div><div><h1>Head {n}</h1><p>Some longer prose of number {n} that goes on.</p></div><div>All rights reserved by us</div></body></html>"
    pages += [(30 + i, "http://plain.org/", plain.format(n=i)) for i in range(4)]
    d = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in templates.articles(d).collect()}
    for i, url, _ in pages[:8]:
        assert got[i] == (url, text := f"Title no{i} Body of no{i} & more next bold open", len(text))
    assert got[20][1] == got[21][1] == "" and got[22][1] == "Title solo Body of solo & more next bold open"
    assert got[23][1] == "cut off here &am" and got[24][1] == "cut"
    assert got[32][1] == "Head 2 Some longer prose of number 2 that goes on."
    assert templates.articles(d.limit(0)).count() == 0


def test_templates_hold_below_main_and_nest(spark):
    part = "<li class='zq{k}'><h3>Mark</h3><b>Item {n} {k}</b></li>"
    page = "<html><body><main><h1>Title {n}</h1><div class='zq'>Buy now</div><p>Prose of number {n}.</p>{some}<ul>{parts}</ul><div class='zz'>{n} said</div></main></body></html>"
    make = lambda n: page.format(n=n, some="<section class='qq'>Half of us</section>" if n % 4 else "", parts="".join(part.format(n=n, k=k) for k in range(n % 3 + 1)))
    group = [make(n) for n in range(10)]
    assert templates.extract(group)[4] == "Title 4 Prose of number 4. Item 4 0 Item 4 1 4 said"
    classes = templates.deduce([templates.tokens(p) for p in group])
    assert [t for t in classes[0] if t.startswith("<div")] and any(len(c) == 2 and c[0].startswith("<section") for c in classes[1:])
    # Copies of one page show no template, nor do few pages.
    assert templates.extract([make(4)] * 10) == templates.extract([make(4)]) * 10 and "Buy now" in templates.extract(group[:2])[0]
    # The rest of a host is a group of its own only with half a group's pages.
    d = spark.createDataFrame([(i, "http://one.org/", make(i)) for i in range(templates.PAGES + 1)], "page_id bigint, url string, html string").coalesce(1)
    assert not [r for r in templates.articles(d).collect() if "Buy now" in r["text"]]


def plain_tags(page):
    """The page with nothing that tells what its elements are for."""
    page = re.sub(r"<(/?)(?:article|nav|footer|header|aside)\b", r"<\1div", page)
    return page.replace('class="ad"', 'class="q7"')


def by_host(spark, sf_dir):
    out = collections.defaultdict(list)
    for r in queries.table(spark, sf_dir, "pages").collect():
        out[re.sub(r"^https?://([^/]*).*", r"\1", r["url"] or "")].append(r["html"] or "")
    return out


def test_the_template_finds_the_article_without_telling_names(spark, monkeypatch):
    hosts = [g[: templates.PAGES] for g in by_host(spark, "/root/testdata/sf0.01").values() if len(g) >= 3]
    assert len(hosts) >= 10
    want = [re.findall(r"<article>(.*?)</article>", p, re.S) for g in hosts for p in g]
    named = [x for g in hosts for x in templates.extract(g)]
    assert all(set(x.split()) == set(templates.blocks(t := templates.tokens(" ".join(w)), [True] * len(t)).split()) for x, w in zip(named, want, strict=True))
    plain = [x for g in hosts for x in templates.extract([plain_tags(p) for p in g])]
    # Nothing but slots tells them apart now; a short article beside a longer footer may be missed.
    assert sum(a == b for a, b in zip(plain, named, strict=True)) >= 0.95 * len(named)
    # Without its template the article can't be told from the rest.
    monkeypatch.setattr(templates, "deduce", lambda pages: [[]])
    assert sum(a != b for a, b in zip([x for g in hosts for x in templates.extract([plain_tags(p) for p in g])], named, strict=True)) > len(named) / 2


def brute_template(pages):
    """Tokens found once on every page, longest common order by trying all runs page by page."""
    names = [[x.token for x in templates.tokens(p) if isinstance(x, templates.Tag) and x.name in templates.BLOCK and x.name not in templates.VOID] for p in pages]
    once = [t for t in names[0] if all(n.count(t) == 1 for n in names)]
    for other in names[1:]:
        best = [[]]
        for t in once:
            best.append(max(([*b, t] for b in best if not b or other.index(b[-1]) < other.index(t)), key=len))
        once = max(best, key=len)
    return once


def test_templates_equal_a_brute_force_deduction(spark):
    for group in list(by_host(spark, "/root/testdata/sf0.01").values())[:25]:
        group = group[:20]
        root = templates.deduce([templates.tokens(p) for p in group])[0]
        assert root == brute_template(group)
    rng = random.Random(5)
    for _ in range(200):
        a = [f"t{i}" for i in range(9)]
        order = [a] + [rng.sample(a, 9) for _ in range(2)]
        got = templates.in_order(order)
        assert all([t for t in o if t in got] == got for o in order)


def test_extraction_of_odd_tables(spark):
    rows = [(1, "http://a.org/", PAGE.format(n="one"), "x")] * 3 + [(None, "http://a.org/", None, None), (2, None, "", ""), (3, "no url", "plain words", "")]
    rows += [(4, "http://b.org/", "<body><p>" + "long text " * 200_000 + "</p></body>", "")]
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    d = d.selectExpr("*", "text as _host", "text as _salt", "text as n_chars")
    got = templates.articles(d)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert len(by[1]) == 3 and len(set(by[1])) == 1 and by[1][0].startswith("Title one Body of one") and by[None] == by[2] == [""]
    assert by[3] == ["plain words"] and len(by[4][0]) == 10 * 200_000 - 1


def test_shards(spark, tmp_path):
    texts = [None, "", "é" * 50, *[f"text {i % 50} " * (i % 40 + 1) for i in range(600)], *["hot copy of a text"] * 300]
    d = docs_of(spark, texts)
    d = d.unionByName(d.limit(3))
    got = sharding.shard(d, 4, map_path=str(tmp_path / "map")).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    sizes = [sum(r["size"] for r in x) for x in by.values()]
    assert len(by) == 4 and max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 4 + 600
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    old = sharding.load_map(spark, str(tmp_path / "map"))
    sharding.save_map(sharding.grow(old.drop("version")), str(tmp_path / "map"), 2)
    before = {r["vslot"]: r["shard"] for r in sharding.load_map(spark, str(tmp_path / "map"), 1).collect()}
    after = sharding.load_map(spark, str(tmp_path / "map")).collect()
    moved = [r for r in after if before[r["vslot"]] != r["shard"]]
    assert {r["shard"] for r in moved} == {4} and {r["version"] for r in after} == {2}
    assert 0.5 / 5 < sum(r["bytes"] for r in moved) / sum(r["bytes"] for r in after) <= 1 / 5
    assert sharding.shard(d.limit(0), 4).count() == 0


def test_equal_rows_are_dealt_out(spark):
    """One repeated row makes up most of the bytes; loads stay near equal."""
    rows = [(7, "the same row " * 20)] * 4000 + [(None, "no id")] * 500 + [(i, f"row {i}") for i in range(100, 400)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6), 16).collect()
    assert len(got) == len(rows)
    loads, places = {}, {}
    for r in got:
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert max(loads.values()) - min(loads.values()) <= 0.02 * sum(loads.values()) / 16 + 261
    assert all(sorted(x) == list(range(len(x))) for x in places.values())


def test_shards_equal_a_greedy_assignment(spark):
    got = queries.op5_shard(spark, "/root/testdata/sf0.001").collect()
    weight = collections.defaultdict(lambda: [0, 0])
    for r in got:
        weight[r["vslot"]][0] += r["size"]
        weight[r["vslot"]][1] += 1
    loads, of = [0] * queries.SHARDS, {}
    for size, v, _ in sorted(((b, v, n) for v, (b, n) in weight.items()), reverse=True):
        of[v] = loads.index(min(loads))
        loads[of[v]] += size
    assert all(r["shard"] == of[r["vslot"]] for r in got)
    place = collections.Counter()
    for r in sorted(got, key=lambda r: (r["shard"], r["vslot"], r["doc_id"], r["text_crc32"], r["size"])):
        assert r["slot"] == place[r["shard"]]
        place[r["shard"]] += 1
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in texts.items()}


def test_pipeline_stages(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "n-gram Jaccard join", "substring dedup", "secret scans", "packing"]
    seen = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.spill(stage(spark, now, "/root/testdata/sf0.001"), "test")
        seen[name] = now
        if name != "packing":
            assert now.columns == docs.columns
    kept = seen["quality rules"].collect()
    ids, texts = [r["doc_id"] for r in kept], [r["text"] for r in kept]
    one = {c for _, _, c in brute_components(texts, ids)}
    after = seen["n-gram Jaccard join"].collect()
    assert {r["doc_id"] for r in after} == one and len(after) == len(one)
    left = {r["doc_id"]: r["text"] for r in seen["substring dedup"].collect()}
    want = brute_removed([r["text"] for r in after])
    for r, (n, gone, digest) in zip(after, want, strict=True):
        assert (r["doc_id"] in left) == (gone < n or n == 0)
        if r["doc_id"] in left:
            assert hashlib.sha256(" ".join(words_of(left[r["doc_id"]])).encode()).hexdigest() == digest
    clean = {r["doc_id"]: r for r in seen["secret scans"].collect()}
    assert set(clean) == set(left) and all(r["n_chars"] == len(r["text"]) for r in clean.values())
    assert not any(re.search(r'token = "[0-9a-f]{20}', r["text"]) for r in clean.values())
    assert {r["doc_id"] for r in seen["packing"].collect()} == set(clean)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0


def test_sweep_deletes_what_queries_left(spark):
    from brindle.llm.common import spill, sweep

    spill(spark.range(3), "test")
    assert sweep(spark) >= 1 and sweep(spark) == 0
