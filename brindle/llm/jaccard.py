"""N-gram Jaccard join with signature trees: links, and classes of linked documents.

Documents are sets of 5-word shingles; two link when their Jaccard similarity is at least
the threshold. All links between different sets count; equal sets are one class from the
start. Steps, each over all data:

1. Every set gets a content key (64 bits, held against a second 64; sets whose keys clash take the
   second). Tasks count frequent shingles, as hints for an order.
2. Two sets can link only if the first ``n - ceil(t n) + 1`` shingles of each, in one common
   order with frequent shingles last, share a shingle; how many they must share follows from
   the sizes. Sets with a rare shingle are paired, and pairs that share too few are dropped;
   sets with a common one hang on the least set of their size range (sizes up to 1 / t apart), and
   neighbouring ranges on each other, so k sets give less than 2 k edges. Hot shingles are dealt
   out by set. Components of this graph are blocks: no link leaves one.
3. In a block, sets are the leaves of a signature tree: a node holds the OR of its sets'
   token bitmaps and its range of sizes. A dual traversal of the tree with itself prunes
   node pairs whose largest possible overlap is too small or whose sets are linked already,
   and compares the remaining leaves exactly. Blocks of more than ``BYTES`` are cut by size range
   and hash into parts, and pairs of parts whose sizes fit are traversed by themselves.

A text without words, or null, has no shingle and links with nothing; a text of fewer than
5 words has its whole sequence as its one shingle. Repeated rows and rows with equal ids
belong to one class. An empty table gives no rows. Shingles are 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.llm.common import chunks, map_rows, own_names, pick, release, spill, texts_of
from brindle.llm.components import Union, components
from brindle.llm.words import MASK, OTHER_BASE, Words, mix, runs, signed
from brindle.operators.ordered import ordered

WIDTH, THRESHOLD = 5, 0.75
#: Frequent shingles that are put last in the order: at most so many (an order, not a filter).
FREQUENT, LEAST = 200_000, 16
#: Sets that have a shingle, up to which they are paired; more common shingles chain their sets.
RARE = 128
#: Bytes of sets (8 a shingle) that one traversal takes, at most twice; sets of a unit of small blocks.
BYTES, GROUP = 16 << 20, 500
#: Tasks that a hot shingle is dealt over, and sets (by the hints) from which it counts as hot.
SALTS, HOT = 64, 1 << 16
#: Sets in blocks up to which their table (some 40 bytes a row) is broadcast.
BROADCAST = 500_000
#: Bits of a signature; children of a node.
BITS, FANOUT = 4096, 8
#: Words of the bitmap with which scans leave out sets that are in no block (512 KB at any size).
SIEVE = 1 << 16


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = Words(texts, lower=True)
    whole = runs(w.hash, width)
    out = []
    for a, b in w.ranges:
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for x in w.hash[a:b].tolist():
                h = np.uint64((int(h) * OTHER_BASE + x) & ((1 << 64) - 1))
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_keys(s: np.ndarray) -> tuple[int, int]:
    """Two content keys of a set, from its size and two sums of mixed hashes."""
    a = int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    b = int(mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64))
    own = np.array([a ^ (b * 3 + len(s)) & MASK, b ^ (a * 5 + len(s)) & MASK], np.uint64)
    return tuple(mix(own).view(np.int64).tolist())


def set_key(s: np.ndarray, clash: frozenset = frozenset()) -> int:
    """A set's content key: the first, or the second where different sets have equal first ones."""
    one, other = set_keys(s)
    return other if one in clash else one


def need(a: int, b: int, t: float = THRESHOLD) -> int:
    """The least overlap with which sets of a and b shingles link."""
    return math.ceil(t * (a + b) / (1 + t) - 1e-9)


def linked(x: np.ndarray, y: np.ndarray, t: float = THRESHOLD) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= round(100 * t) * (len(x) + len(y) - both)


class Node:
    __slots__ = ("bits", "few", "kids", "least", "most", "slack")

    def __init__(self, bits, least, most, slack, kids, few):
        self.bits, self.least, self.most, self.slack, self.kids, self.few = bits, least, most, slack, kids, few


def signature(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS // 8, np.uint8)
    at = (s % np.uint64(BITS)).astype(np.int64)
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits


def tree(sets: list[np.ndarray]) -> Node:
    """Signature tree over sets; leaves hold the index of a set."""
    level = []
    for i in sorted(range(len(sets)), key=lambda i: (len(sets[i]), sets[i][:1].tolist())):
        b, n = signature(sets[i]), len(sets[i])
        level.append(Node(b, n, n, n - int(np.bitwise_count(b).sum()), i, [i]))
    while len(level) > 1:
        up = []
        for i in range(0, len(level), FANOUT):
            kids = level[i : i + FANOUT]
            up.append(Node(np.bitwise_or.reduce([k.bits for k in kids]), min(k.least for k in kids), max(k.most for k in kids), max(k.slack for k in kids), kids, sum((k.few for k in kids), [])))
        level = up
    return level[0]


def traverse(sets: list[np.ndarray], t: float = THRESHOLD, links: list | None = None) -> tuple[Union, int]:
    """Union of linked sets (by index) and the number of exact comparisons made.

    With a list for ``links`` no pair is passed over because its sets are in one class already,
    and every linked pair of indices is put into it.
    """
    union, compared = Union(), 0
    for i in range(len(sets)):
        union.find(i)
    if len(sets) < 2:
        return union, 0
    root = tree(sets)
    todo = [(root, root)]
    while todo:
        a, b = todo.pop()
        if a is b:
            if isinstance(a.kids, list):
                todo += [(x, y) for i, x in enumerate(a.kids) for y in a.kids[i:]]
            continue
        if a.least > b.least:
            a, b = b, a
        if a.most < t * b.least - 1e-9:
            continue
        one = union.find(a.few[0]) if links is None else None
        if links is None and all(union.find(i) == one for i in a.few) and all(union.find(i) == one for i in b.few):
            continue
        if int(np.bitwise_count(a.bits & b.bits).sum()) + min(a.slack, b.slack) < need(a.least, b.least, t):
            continue
        split_a, split_b = isinstance(a.kids, list), isinstance(b.kids, list)
        if split_a and (not split_b or len(a.few) >= len(b.few)):
            todo += [(x, b) for x in a.kids]
        elif split_b:
            todo += [(a, y) for y in b.kids]
        else:
            compared += 1
            if linked(sets[a.kids], sets[b.kids], t):
                union.join(a.kids, b.kids)
                if links is not None:
                    links.append((a.kids, b.kids))
    return union, compared


def _first_pass(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """kind 0: id, size and key of each document. kind 1: a frequent shingle and its count in a task."""

    def frequent(held: list[np.ndarray]):
        u, n = np.unique(np.concatenate(held), return_counts=True)
        few = n >= 2
        u, n = u[few], n[few]
        return {"kind": np.ones(len(u), np.int32), "a": signed(u), "n": n.astype(np.int64), "key": np.zeros(len(u), np.int64), "other": np.zeros(len(u), np.int64)}

    def run(batches):
        held, total, seen = [], 0, set()
        for b in batches:
            ids, texts = b[id_col], texts_of(b[text_col])
            for lo, hi in chunks([len(x) for x in texts]):
                sets = shingle_sets(texts[lo:hi])
                keys = [set_keys(s) for s in sets]
                yield {"kind": [0] * len(sets), "a": ids[lo:hi].cast(pa.int64()), "n": [len(s) for s in sets], "key": [k for k, _ in keys], "other": [k for _, k in keys]}
                for s, k in zip(sets, keys, strict=True):
                    if k not in seen:
                        seen.add(k)
                        held.append(s)
                        total += len(s)
                if total > 2_000_000:
                    yield frequent(held)
                    held, total = [], 0
        if held:
            yield frequent(held)

    return map_rows(pick(docs, id_col, text_col), "kind int, a bigint, n bigint, key bigint, other bigint", run)


def _prefixes(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], text_col: str, t: float, clash: frozenset) -> DataFrame:
    """(token, n, key, salt) for the first shingles of each set; a task gives equal sets once.

    ``salt`` deals a hot shingle's sets over ``SALTS`` tasks (1 and up; 0 for all others).
    """
    heavy, level = frequent
    hot = heavy[level >= HOT.bit_length()]

    def run(batches):
        seen = set()
        for b in batches:
            texts = texts_of(b[text_col])
            for lo, hi in chunks([len(x) for x in texts]):
                toks, sizes, keys = [], [], []
                for s in shingle_sets(texts[lo:hi]):
                    k = set_key(s, clash)
                    if not len(s) or k in seen:
                        continue
                    seen.add(k)
                    p = len(s) - math.ceil(t * len(s) - 1e-9) + 1
                    order = np.zeros(len(s), np.uint8)
                    if len(heavy):
                        at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                        order = np.where(heavy[at] == s, level[at], 0)
                    first = s[np.lexsort((s, order))[:p]] if order.any() else s[:p]
                    toks.append(first)
                    sizes.append(np.full(p, len(s), np.int64))
                    keys.append(np.full(p, k, np.int64))
                if toks:
                    tok, key = np.concatenate(toks), np.concatenate(keys)
                    salt = np.where(np.isin(tok, hot), 1 + key % SALTS, 0).astype(np.int32)
                    yield {"token": signed(tok), "n": np.concatenate(sizes), "key": key, "salt": salt}

    return map_rows(docs.select(F.col(f"`{text_col}`")), "token bigint, n bigint, key bigint, salt int", run)


def _shared(prefixes: DataFrame, t: float) -> DataFrame:
    """What sets share in their prefixes.

    kind 0: a pair of sets of compatible sizes that share a shingle which at most ``RARE``
    sets have. kind 1: a set (u) with a more common shingle (v). A task reads its shingles in
    order and holds one shingle's sets, until it knows that they are more than ``RARE``.
    """

    def out(kind: int, u, v, nu, nv) -> dict:
        return {"kind": np.full(len(u), kind, np.int32), "u": u, "v": v, "nu": nu, "nv": nv}

    def common_ones(tok, n, key) -> dict:
        return out(1, key, tok, n, np.zeros(len(tok), np.int64))

    def run(batches):
        held = (np.empty(0, np.int64),) * 3
        common, last = None, None  # the common shingle being read, and its last set
        for b in batches:
            tok, n, key, salt = (b[c].to_numpy() for c in ("token", "n", "key", "salt"))
            if (salted := salt > 0).any():
                yield common_ones(tok[salted], n[salted], key[salted])
                tok, n, key = tok[~salted], n[~salted], key[~salted]
            if common is not None:
                here = tok == common
                k, size = key[here], n[here]
                if len(k):
                    new = np.ones(len(k), bool)
                    new[1:] = k[1:] != k[:-1]
                    new[0] = k[0] != last
                    last = k[-1]
                    yield common_ones(np.full(int(new.sum()), common), size[new], k[new])
                tok, n, key = tok[~here], n[~here], key[~here]
                if not len(tok):
                    continue
                common = None
            tok, n, key = (np.concatenate(x) for x in zip(held, (tok, n, key), strict=True))
            new = np.ones(len(tok), bool)
            new[1:] = (tok[1:] != tok[:-1]) | (key[1:] != key[:-1])
            tok, n, key = tok[new], n[new], key[new]
            stop = int(np.searchsorted(tok, tok[-1])) if len(tok) else 0
            if len(tok) - stop > RARE:
                common, last, stop = tok[-1], key[-1], len(tok)
            held = (tok[stop:], n[stop:], key[stop:])
            yield from compare(tok[:stop], n[:stop], key[:stop])
        yield from compare(*held)

    def compare(tok, n, key):
        if not len(tok):
            return
        first = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
        many = np.diff(np.append(first, len(tok)))
        left = np.repeat(many, many) - (np.arange(len(tok)) - np.repeat(first, many)) - 1  # sets of the shingle still to come
        rare = np.repeat(many <= RARE, many)
        if not rare.all():
            yield common_ones(tok[~rare], n[~rare], key[~rare])
        at = np.flatnonzero(rare & (left > 0))
        step = 1
        while len(at):
            i, j = at, at + step
            fits = n[i] >= t * n[j] - 1e-9
            yield out(0, key[i[fits]], key[j[fits]], n[i[fits]], n[j[fits]])
            step += 1
            at = at[fits & (left[at] >= step)]  # sizes ascend: once too large, always too large

    rows = prefixes.repartition("token", "salt").sortWithinPartitions("salt", "token", "n", "key")
    return map_rows(rows, "kind int, u bigint, v bigint, nu bigint, nv bigint", run)


def _size_range(n: str, t: float) -> Column:
    """Sets of sizes in one range, or in neighbouring ones, may link; others can't."""
    return F.floor(F.log(F.col(n).cast("double")) / math.log(1 / t) + 1e-9).cast("int")


def _edges(shared: DataFrame, t: float) -> DataFrame:
    """(u, v): edges whose components hold every link.

    If two sets link, the set whose prefix ends first in the order has at most
    ``ceil(t n) - 1`` shingles behind its prefix, so they share at least
    ``need - (ceil(t n) - 1)`` prefix shingles. A pair without a common shingle shares rare ones
    only, so its count is complete and is held against the bound. Sets with a common shingle
    hang on the least of their size range; minima combine before the shuffle, and the join back
    has both sides shuffled for it alone, so that a hot range can be split.
    """
    rare = shared.where("kind = 0")
    behind = lambda n: F.ceil(F.lit(t) * F.col(n) - 1e-9) - 1
    least = F.ceil(F.lit(t) * (F.col("nu") + F.col("nv")) / (1 + t) - 1e-9) - F.greatest(behind("nu"), behind("nv"))
    pairs = rare.where(F.col("count") >= least).select("u", "v")
    common = shared.where("kind = 1").select("u", "v", _size_range("nu", t).alias("range"))
    heads = spill(common.groupBy("v", "range").agg(F.min("u").alias("head")), "jaccard-heads")
    stars = common.join(heads, ["v", "range"]).select("u", F.col("head").alias("v"))
    below = heads.select("v", (F.col("range") + 1).alias("range"), F.col("head").alias("under"))
    steps = heads.join(below, ["v", "range"]).select(F.col("under").alias("u"), F.col("head").alias("v"))
    return pairs.unionByName(stars).unionByName(steps).where("u <> v").distinct()


def _payload(docs: DataFrame, sieve: np.ndarray, text_col: str, clash: frozenset) -> DataFrame:
    """(key, n, tokens) of sets that may be in a block; a task gives equal sets once."""

    def run(batches):
        seen = set()
        for b in batches:
            texts = texts_of(b[text_col])
            for lo, hi in chunks([len(x) for x in texts]):
                keys, sizes, toks = [], [], []
                for s in shingle_sets(texts[lo:hi]):
                    k = set_key(s, clash)
                    u = k & MASK
                    if len(s) and k not in seen and int(sieve[(u >> 6) % SIEVE]) >> (u & 63) & 1:
                        seen.add(k)
                        keys.append(k)
                        sizes.append(len(s))
                        toks.append(s.tobytes())
                if keys:
                    yield {"key": keys, "n": sizes, "tokens": toks}

    return map_rows(docs.select(F.col(f"`{text_col}`")), "key bigint, n bigint, tokens binary", run)


def _sieve(nodes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of the nodes' keys: at most SIEVE numbers reach the driver."""
    bit = F.expr("shiftleft(1L, cast(key & 63 as int))")
    word = F.pmod(F.shiftrightunsigned("key", 6), F.lit(SIEVE))
    out = np.zeros(SIEVE, np.uint64)
    for r in nodes.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        out[r["w"]] = np.uint64(r["b"] & ((1 << 64) - 1))
    return out


def _units(nodes: DataFrame, sizes: DataFrame, t: float) -> tuple[DataFrame, bool, int]:
    """(key, unit, root): which traversals take a set; whether a block had to be cut; the number of sets.

    ``nodes``: key, root. ``sizes``: key, n.
    """
    sized = spill(nodes.join(sizes, "key"), "jaccard-sized").withColumn("range", _size_range("n", t))
    blocks = spill(sized.groupBy("root").agg(F.count("*").alias("members"), (8 * F.sum("n")).alias("bytes")), "jaccard-roots")
    n = blocks.agg(F.sum("members")).first()[0] or 0
    # Small blocks fill units in order of their roots: by bytes, and so that no unit has more than about GROUP sets.
    weight = F.greatest("bytes", F.col("members") * (BYTES // GROUP)).cast("bigint")
    filled = ordered(blocks.where(F.col("bytes") <= BYTES).select("root", weight.alias("weight")), ["root"], [], sums=("weight",)).rows
    filled = filled.select("root", F.concat(F.lit("g"), F.floor((F.col("sum_weight") - 1) / BYTES).cast("string")).alias("unit"))
    small = nodes.join(filled, "root").select("key", "unit", "root")
    large = spill(blocks.where(F.col("bytes") > BYTES).select("root"), "jaccard-large")
    if large.isEmpty():
        return small, False, n
    held = spill(sized.join(large, "root", "left_semi").groupBy("root", "range").agg((8 * F.sum("n")).alias("bytes")), "jaccard-ranges")
    # Parts of half a traversal's bytes: two of them are one unit.
    parts = held.select("root", "range", F.ceil(2 * F.col("bytes") / BYTES).cast("int").alias("parts"))
    above = parts.select("root", (F.col("range") - 1).alias("range"), F.col("parts").alias("above"))
    below = parts.select("root", (F.col("range") + 1).alias("range"), F.col("parts").alias("below"))
    parts = parts.join(above, ["root", "range"], "left").join(below, ["root", "range"], "left").na.fill(0)
    rows = sized.join(parts, ["root", "range"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    name = lambda lo, p, hi, q: F.concat_ws("-", F.lit("b"), F.col("root"), lo, p, hi, q)
    here, part = F.col("range"), F.col("part")
    many = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    own = F.transform(many(F.col("parts")), lambda q: name(here, F.least(part, q), here, F.greatest(part, q)))
    up = F.transform(many(F.col("above")), lambda q: name(here, part, here + 1, q))
    down = F.transform(many(F.col("below")), lambda q: name(here - 1, q, here, part))
    cut = rows.select("key", "root", F.explode(F.array_distinct(F.concat(own, up, down))).alias("unit"))
    return small.unionByName(cut.select("key", "unit", "root")), True, n


def _links(docs: DataFrame, text_col: str, threshold: float, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(a, n_shingles, key) of every row, and (u, v): sets and a set of their class, or all linked pairs (``every``)."""
    first = spill(_first_pass(docs, "a", text_col), "jaccard-sets")
    rows = first.where("kind = 0").select("a", F.col("n").alias("n_shingles"), "key", "other")
    twin = rows.groupBy("key").agg(F.min("other").alias("x"), F.max("other").alias("y")).where("x <> y").select("key")
    clash = frozenset(r["key"] for r in twin.collect())  # different sets with equal 64-bit keys: none but by chance
    if clash:
        rows = rows.withColumn("key", F.when(F.col("key").isin(list(clash)), F.col("other")).otherwise(F.col("key")))
    rows = rows.drop("other")
    top = first.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).orderBy(F.desc("n"), "a").limit(FREQUENT).collect()
    heavy = np.array([r["a"] for r in top], np.int64).view(np.uint64)
    level = np.array([min(255, r["n"].bit_length()) for r in top], np.uint8)
    by = np.argsort(heavy)
    pre = _prefixes(docs, (heavy[by], level[by]), text_col, threshold, clash)
    shared = spill(_shared(pre, threshold).groupBy("kind", "u", "v", "nu", "nv").count(), "jaccard-shared")
    release(docs.sparkSession)
    nodes = spill(components(spill(_edges(shared, threshold), "jaccard-edges")).select(F.col("node").alias("key"), "root"), "jaccard-blocks")
    units, cut, n = _units(nodes, rows.where("n_shingles > 0").select("key", F.col("n_shingles").alias("n")).distinct(), threshold)
    # Up to a checked size the table of blocks goes to the sets; beyond it both are shuffled.
    units = F.broadcast(units) if n <= BROADCAST and not cut else units
    given = _payload(docs, _sieve(nodes), text_col, clash).join(units, "key")

    def link(block: pa.Table) -> pa.Table:
        keys, in_block = block["key"].to_pylist(), block["root"].to_pylist()
        tokens = block["tokens"].to_pylist()
        by_root: dict[int, dict[int, np.ndarray]] = {}
        for k, r, x in zip(keys, in_block, tokens, strict=True):
            by_root.setdefault(r, {}).setdefault(k, np.frombuffer(x, np.uint64))
        us, vs = [], []
        for own in by_root.values():
            names = sorted(own)
            if every:
                found: list[tuple[int, int]] = []
                traverse([own[k] for k in names], threshold, found)
                us += [names[min(x)] for x in found]
                vs += [names[max(x)] for x in found]
                continue
            union, _ = traverse([own[k] for k in names], threshold)
            us += names
            vs += [names[union.find(i)] for i in range(len(names))]
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    found = spill(given.groupBy("unit").applyInArrow(link, "u bigint, v bigint"), "jaccard-links")
    if every:
        return rows, found.distinct()
    if cut:
        found = components(found).select(F.col("node").alias("u"), F.col("root").alias("v"))
    return rows, found.where("u <> v")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, n_shingles and component_id, the least id reachable by links (its own included)."""
    rows, found = _links(docs.select(F.col(f"`{id_col}`").alias("a"), F.col(f"`{text_col}`").alias("t")), "t", threshold)
    # Both sides of these joins are shuffled for the join alone, so a hot set or class can be split.
    label = spill(found.select(F.col("u").alias("key"), F.col("v").alias("class")).distinct(), "jaccard-labels")
    named = rows.join(label, "key", "left").withColumn("class", F.coalesce("class", "key"))
    least = spill(named.where("n_shingles > 0").groupBy("class").agg(F.min("a").alias("least")), "jaccard-least")
    out = named.join(least, "class", "left")
    return out.select(F.col("a").alias(id_col), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("a")).alias("component_id"))


def pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The join itself: (one, other) for each link between different sets, each named by the least id of its rows (one < other).

    Rows of equal sets are not expanded; ``classes`` tells which class they are of. A cluster of m
    different sets that all link gives m (m - 1) / 2 rows, since those are its links.
    """
    rows, found = _links(docs.select(F.col(f"`{id_col}`").alias("a"), F.col(f"`{text_col}`").alias("t")), "t", threshold, every=True)
    name = spill(rows.where("n_shingles > 0").groupBy("key").agg(F.min("a").alias("a")), "jaccard-names")
    out = found.join(name.select(F.col("key").alias("u"), F.col("a").alias("x")), "u").join(name.select(F.col("key").alias("v"), F.col("a").alias("y")), "v")
    return out.select(F.least("x", "y").alias("one"), F.greatest("x", "y").alias("other"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents without near-duplicates: of each class one row of the least id stays.

    Rows without an id stay. Of several rows with a class's least id the one of the least text hash stays.
    """
    found = classes(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), id_col=id_col, text_col=text_col, threshold=threshold)
    own_id, goes, place = own_names(docs, "own_id", "goes", "place")
    i = F.col(f"`{id_col}`")
    per_id = found.where(i.isNotNull()).groupBy(i.alias(own_id)).agg(F.count("*").alias("n"), F.bool_or(i != F.col("component_id")).alias(goes))
    marks = spill(per_id.where(F.col(goes) | (F.col("n") > 1)).select(own_id, goes), "jaccard-marks")
    # What goes is sent to the documents up to a checked size; beyond it both are shuffled.
    side = F.broadcast(marks) if marks.count() <= BROADCAST else marks
    rows = docs.join(side, i == F.col(own_id), "left").drop(own_id)
    out = rows.where(F.col(goes).isNull()).drop(goes)
    if marks.where(~F.col(goes)).isEmpty():
        return out
    w = W.partitionBy(i).orderBy(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    again = rows.where(~F.col(goes)).drop(goes).withColumn(place, F.row_number().over(w)).where(F.col(place) == 1)
    return out.unionByName(again.drop(place))
