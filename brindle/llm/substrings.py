"""Substring dedup by prefix-partitioned, sparse suffix trees.

A window is ``width`` consecutive words. The tree is sparse: suffixes begin at anchors, and the
anchor of a window is the least hash among its runs of ``prefix`` words, so equal windows have
equal anchors at equal places. The windows of one anchor occurrence are a block: the anchor's
suffix with the words to its left that its windows need.

1. Suffixes are split by prefix. The first prefix is the anchor's run of words; one that occurs
   once is a leaf, has no internal node and goes no further. Edges without branches are contracted:
   blocks of equal content are one leaf with a count, and if the count is two or more, all their
   windows repeat.
2. A prefix with more than ``GROUP`` different blocks is lengthened: its suffixes are split anew by
   the first 16 words of their windows, then 24, until a group fits into memory; each time suffixes
   alone in their group are leaves and go. At full ``width`` a group is one deep node, and counting
   its suffixes is all there is to do.
3. Each group that fits becomes a suffix array by prefix doubling, which is its subtree in order:
   neighbours that agree on ``width`` words lie below one internal node that deep. Windows below
   such nodes repeat; overlapping ones join to the maximal repeats that are removed.

Groups are dealt out by prefix and worked on one after the other, so that a task holds one group
of bounded size. A passage that a third of all documents share is one contracted leaf. Suffixes
are counted with minima and maxima by key, which combine before each shuffle. Equal texts are one
text with a count. Texts are worked on whole.

Null texts have no words; texts under ``width`` words keep all. Repeated rows are repeats of
each other: a repeated text of ``width`` words or more loses all its words. Empty tables
give no rows. Extra columns, whatever their names, pass through ``cut`` as they are. Texts are
told apart by 128-bit hashes, blocks by two 64-bit hashes, words inside a group by 64-bit ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from brindle.llm.common import chunks, map_rows, own_names, release, spill, texts_of
from brindle.llm.words import OTHER_BASE, Words, run_hash, runs, signed

WIDTH, PREFIX = 35, 8
#: Suffixes of a group that one task turns into a tree (some 2 MB), and words of the groups it takes at once.
GROUP, BATCH_WORDS = 4_000, 500_000
#: Lengths, in words, to which the prefixes of larger groups grow.
LONGER = (16, 24)
#: Words of the bitmap that lets scans pass by texts without repeats (512 KB at any size).
SIEVE = 1 << 16


class Blocks:
    """Blocks of windows with one anchor, for several texts.

    ``first``, ``last``: their window starts (last included), as indices of words; ``key``:
    the anchor's prefix; ``at``: its place; ``owner``, ``number``: the text, and the block's
    number in it.
    """

    def __init__(self, w: Words, width: int = WIDTH, prefix: int = PREFIX) -> None:
        span = width - prefix + 1
        g = runs(w.hash, prefix)
        starts = [np.arange(a, b - width + 1) for a, b in w.ranges]
        self.windows = np.concatenate(starts) if starts else np.empty(0, np.int64)
        if not len(self.windows):
            self.first = self.last = self.at = self.owner = self.number = np.empty(0, np.int64)
            self.key = np.empty(0, np.uint64)
            return
        value, place, have = g, np.arange(len(g)), 1
        while have < span:
            step = min(have, span - have)
            right = value[step:] < value[: len(value) - step]
            place = np.where(right, place[step:], place[: len(place) - step])
            value = np.where(right, value[step:], value[: len(value) - step])
            have += step
        at = place[self.windows]
        text = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
        i = np.flatnonzero(new)
        self.first, self.last = self.windows[i], self.windows[np.append(i[1:], len(at)) - 1]
        self.at, self.owner, self.key = at[i], text[i], g[at[i]]
        self.number = np.arange(len(i)) - np.searchsorted(self.owner, self.owner)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    tid = F.unhex(F.md5(text))
    return docs.select(text.alias("text"), tid.alias("tid"), F.xxhash64(tid).alias("bit"))


def _blocks(texts: DataFrame, width: int, prefix: int) -> DataFrame:
    """Blocks of texts of ``width`` words or more: text id, number, prefix and content; a task gives equal texts once."""

    def run(batches):
        seen = set()
        for b in batches:
            every, tids = texts_of(b["text"]), b["tid"].to_pylist()
            for lo, hi in chunks([len(t) for t in every]):
                fresh = []
                for i in range(lo, hi):
                    if tids[i] not in seen:
                        seen.add(tids[i])
                        fresh.append(i)
                w = Words([every[i] for i in fresh])
                s = Blocks(w, width, prefix)
                if not len(s.first):
                    continue
                own = np.array(fresh, np.int64)[s.owner]
                content = run_hash(w.hash, s.first, s.last + width)
                yield {"tid": b["tid"].take(pa.array(own)), "key": signed(s.key), "content": signed(content), "number": s.number.astype(np.int64)}

    return map_rows(texts.select("text", "tid"), "tid binary, key bigint, content bigint, number bigint", run)


def _twice(rows: DataFrame, *by: str) -> DataFrame:
    """By key the least and the greatest occurrence: they differ where there are two or more."""
    return rows.groupBy(*by).agg(F.min("oid").alias("_one"), F.max("oid").alias("_other"))


def _bits(tids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of text ids: at most SIEVE numbers reach the driver."""
    word = F.pmod(F.shiftrightunsigned(F.xxhash64("tid"), 6), F.lit(SIEVE))
    bit = F.expr("shiftleft(1L, cast(xxhash64(tid) & 63 as int))")
    out = np.zeros(SIEVE, np.uint64)
    for r in tids.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        out[r["w"]] = np.uint64(r["b"] & ((1 << 64) - 1))
    return out


def _in(bits: np.ndarray, column: pa.Array) -> np.ndarray:
    u = column.to_numpy(zero_copy_only=False).view(np.uint64)
    return (bits[(u >> np.uint64(6)) % np.uint64(SIEVE)] >> (u & np.uint64(63)) & np.uint64(1)).astype(bool)


def _sift(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """(tid, text) of texts that the bitmap lets pass; a task gives equal texts once."""

    def run(batches):
        seen = set()
        for b in batches:
            tids, take = b["tid"].to_pylist(), []
            for i in np.flatnonzero(_in(bits, b["bit"])).tolist():
                if tids[i] not in seen:
                    seen.add(tids[i])
                    take.append(i)
            at = pa.array(take, pa.int64())
            yield {"tid": b["tid"].take(at), "text": b["text"].take(at)}

    return map_rows(texts, "tid binary, text string", run)


#: A string of a group: where it lies, the first of its windows, whether its windows are in question, its words.
STRING = "grp bigint, tid binary, at bigint, first bigint, single boolean, words binary"


def _strings(rows: DataFrame, width: int, prefix: int, whole: bool) -> DataFrame:
    """What the asked blocks of each text (``blocks``: number, single, large) put into groups.

    ``whole``: blocks of prefixes that fit, as ``STRING``. Otherwise the windows of the others
    with hashes of their first words, at the lengths of ``LONGER`` and at ``width``.
    """

    def run(batches):
        for b in batches:
            every, asked = texts_of(b["text"]), b["blocks"].to_pylist()
            for lo, hi in chunks([len(t) for t in every]):
                w = Words(every[lo:hi])
                s = Blocks(w, width, prefix)
                begin = np.searchsorted(s.owner, np.arange(hi - lo))
                want: dict[int, bool] = {}
                for i, x in enumerate(asked[lo:hi]):
                    for r in x:
                        if r["large"] != whole:
                            k = int(begin[i]) + r["number"]
                            want[k] = want.get(k, False) or r["single"]
                if not want:
                    continue
                k = np.array(sorted(want))
                single = np.array([want[x] for x in k.tolist()])
                base = np.array([a for a, _ in w.ranges], np.int64)[s.owner[k]]
                if whole:
                    data = w.hash.tobytes()
                    words = [data[8 * x : 8 * y] for x, y in zip(s.first[k].tolist(), (s.last[k] + width).tolist(), strict=True)]
                    yield {"grp": signed(s.key[k]), "tid": b["tid"].take(pa.array(s.owner[k] + lo)), "at": s.number[k].astype(np.int64), "first": s.first[k] - base, "single": single, "words": words}
                    continue
                n = s.last[k] - s.first[k] + 1
                of = np.repeat(np.arange(len(k)), n)
                win = np.repeat(s.first[k], n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                out = {"key": signed(s.key[k][of]), "tid": b["tid"].take(pa.array(s.owner[k][of] + lo)), "start": win - base[of], "single": single[of]}
                for m in (*LONGER, width):
                    out[f"h{m}"] = signed(runs(w.hash, min(m, width), OTHER_BASE | 1)[win])
                yield out

    longer = "".join(f", h{m} bigint" for m in dict.fromkeys((*LONGER, width)))
    return map_rows(rows, STRING if whole else f"key bigint, tid binary, start bigint, single boolean{longer}", run)


def suffix_array(codes: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``starts`` in the order of their first ``width`` codes, and which agree on all with the one before.

    Prefix doubling: ranks by one code, two, four and so on; the last step makes up the width.
    """
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    done = 1
    while done < width:
        step = min(done, width - done)
        pair = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.append(np.unique(pair, return_inverse=True)[1], np.zeros(step, np.int64))
        done += step
    order = np.argsort(rank[starts], kind="stable")
    ordered = rank[starts][order]
    return order, np.append(False, ordered[1:] == ordered[:-1])


def below_deep_nodes(words: list[np.ndarray], count: np.ndarray, width: int) -> list[np.ndarray]:
    """For each string which of its windows lie below a node at least ``width`` deep that has two leaves.

    Strings of several groups may go together, since equal windows have equal prefixes. ``count``:
    leaves that a string stands for (2 for two or more).
    """
    size = np.array([len(x) for x in words])
    begin = np.cumsum(size) - size
    codes = np.concatenate(words)
    n = size - width + 1
    of = np.repeat(np.arange(len(words)), n)
    starts = np.repeat(begin, n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    order, same = suffix_array(codes, starts, width)
    node = np.cumsum(~same)
    leaves = np.bincount(node, count[of[order]])
    deep = np.zeros(len(of), bool)
    deep[order] = leaves[node] >= 2
    return np.split(deep, np.cumsum(n)[:-1])


def _trees(strings: DataFrame, width: int) -> DataFrame:
    """(tid, lo, hi): first and last start of runs of windows in question that lie below deep nodes."""

    def done(held: list[tuple]) -> dict:
        words = [np.frombuffer(x[4], np.uint64) for x in held]
        deep = below_deep_nodes(words, np.array([1 if x[3] else 2 for x in held]), width)
        tid, lo, hi = [], [], []
        for (_, t, first, single, _), d in zip(held, deep, strict=True):
            if single and d.any():
                edge = np.flatnonzero(np.diff(d.view(np.int8), prepend=np.int8(0), append=np.int8(0))).reshape(-1, 2)
                tid += [t] * len(edge)
                lo += (first + edge[:, 0]).tolist()
                hi += (first + edge[:, 1] - 1).tolist()
        return {"tid": tid, "lo": lo, "hi": hi}

    def run(batches):
        held, total, last = [], 0, None
        for b in batches:
            for g, t, at, first, single, words in zip(*(b[c].to_pylist() for c in ("grp", "tid", "at", "first", "single", "words")), strict=True):
                if last == (g, t, at):  # an equal text of another task
                    continue
                if total > BATCH_WORDS and last[0] != g:
                    yield done(held)
                    held, total = [], 0
                last = (g, t, at)
                held.append((g, t, first, single, words))
                total += len(words) // 8
        if held:
            yield done(held)

    rows = strings.repartition("grp").sortWithinPartitions("grp", "tid", "at")
    return map_rows(rows, "tid binary, lo bigint, hi bigint", run)


def _lengthened(windows: DataFrame, width: int) -> DataFrame:
    """(tid, lo, hi) for the windows of prefixes that were too large, by longer prefixes."""
    left = spill(windows.withColumn("oid", F.xxhash64("tid", "start")), "substring-windows")
    out, path = [], [f"h{m}" for m in dict.fromkeys((*LONGER, width))]
    one = F.col("start")
    for m in LONGER:
        groups = left.groupBy("key", f"h{m}").agg(F.min("oid").alias("_one"), F.max("oid").alias("_other"), F.count("*").alias("_n")).where("_one <> _other")
        groups = spill(groups.select("key", f"h{m}", "_n"), "substring-longer")
        fits = left.join(groups.where(F.col("_n") <= GROUP), ["key", f"h{m}"], "left_semi")
        # The suffix as the path of its nodes at the sampled depths.
        words = F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in path])
        strings = fits.select(F.xxhash64("key", f"h{m}").alias("grp"), "tid", one.alias("at"), one.alias("first"), "single", words.alias("words"))
        out.append(_trees(strings, len(path)))
        left = spill(left.join(groups.where(F.col("_n") > GROUP), ["key", f"h{m}"], "left_semi"), "substring-windows")
        if left.isEmpty():
            break
    else:
        deep = _twice(left, "key", f"h{width}").where("_one <> _other").select("key", f"h{width}")
        out.append(left.where("single").join(deep, ["key", f"h{width}"], "left_semi").select("tid", one.alias("lo"), one.alias("hi")).distinct())
    return _union(out)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def repeats(docs: DataFrame, *, text_col: str = "text", width: int = WIDTH, prefix: int = PREFIX) -> DataFrame:
    """(tid, copied, blocks, ranges): texts with repeated windows, and which.

    ``blocks`` are numbers of blocks all of whose windows repeat, ``ranges`` are runs of
    window starts (lo to hi); ``copied``: the whole text occurs twice or more.
    """
    spark = docs.sparkSession
    texts = _texts(docs, text_col)
    blocks = _blocks(texts, width, prefix).withColumn("oid", F.xxhash64("tid", "number"))
    # Written first, so that the join shuffles both sides for itself and a hot prefix can be split.
    again = spill(_twice(blocks, "key").where("_one <> _other").select("key"), "substring-prefixes")
    kept = spill(blocks.join(again, "key", "left_semi").select("key", "content", "tid", "number", "oid"), "substring-blocks")
    release(spark)
    leaves = spill(_twice(kept, "key", "content").withColumn("single", F.col("_one") == F.col("_other")), "substring-contents")
    full = kept.join(leaves.where("not single").select("key", "content"), ["key", "content"], "left_semi").select("tid", "number").distinct()
    # Prefixes with a block that occurs once, and how many leaves they have.
    sizes = leaves.groupBy("key").agg(F.count("*").alias("n"), F.bool_or("single").alias("open")).where("open and n > 1")
    mixed = leaves.join(spill(sizes.select("key", (F.col("n") > GROUP).alias("large")), "substring-open"), "key")
    wanted = kept.join(mixed.select("key", "content", F.col("_one").alias("oid"), "single", "large"), ["key", "content", "oid"]).select("tid", "number", "single", "large").distinct()
    wanted = spill(wanted.groupBy("tid").agg(F.collect_list(F.struct("number", "single", "large")).alias("blocks")), "substring-wanted")
    # A merge join ends the first scan's stage, so that a task never holds two Python workers.
    rows = _sift(texts, _bits(wanted)).join(wanted.hint("merge"), "tid")
    starts = _trees(_strings(rows, width, prefix, True), width)
    if not wanted.where(F.exists("blocks", lambda x: x["large"])).isEmpty():
        starts = starts.unionByName(_lengthened(_strings(rows, width, prefix, False), width))
    copied = texts.groupBy("tid").agg(F.count("*").alias("n")).where("n > 1")
    none, run = F.lit(None).cast("bigint"), F.lit(None).cast("struct<lo:bigint,hi:bigint>")
    marks = full.select("tid", "number", run.alias("run"), F.lit(False).alias("all"))
    marks = marks.unionByName(starts.select("tid", none.alias("number"), F.struct("lo", "hi").alias("run"), F.lit(False).alias("all")))
    marks = marks.unionByName(copied.select("tid", none.alias("number"), run.alias("run"), F.lit(True).alias("all")))
    out = spill(marks.groupBy("tid").agg(F.max("all").alias("copied"), F.collect_list("number").alias("blocks"), F.collect_list("run").alias("ranges")), "substring-marks")
    release(spark)
    return out


def _kept(words: Words, i: int, s: Blocks | None, mark: dict | None, width: int) -> np.ndarray:
    """Which words of text i stay."""
    a, b = words.ranges[i]
    stay = np.ones(b - a, bool)
    if mark is None or b - a < width:
        return stay
    if mark["copied"]:
        return ~stay
    edge = np.zeros(b - a + 1, np.int64)
    begin = int(np.searchsorted(s.owner, i))
    for k in mark["blocks"]:
        edge[s.first[begin + k] - a] += 1
        edge[s.last[begin + k] - a + width] -= 1
    for r in mark["ranges"]:
        edge[r["lo"]] += 1
        edge[r["hi"] + width] -= 1
    return np.cumsum(edge)[:-1] == 0


def _runs(stay: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true values, as (first, one behind the last)."""
    return np.flatnonzero(np.diff(stay.astype(np.int8), prepend=np.int8(0), append=np.int8(0))).reshape(-1, 2).tolist()


def remove(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, prefix: int = PREFIX, digest: bool = False) -> DataFrame:
    """id, n_words, n_removed and the kept words joined by spaces (``kept``, or its SHA-256)."""
    last = "kept_sha256" if digest else "kept"
    finish = (lambda x: hashlib.sha256(x).hexdigest()) if digest else (lambda x: x.decode("utf-8", "surrogatepass"))

    def rest(w: Words, i: int, stay: np.ndarray) -> tuple:
        a = w.ranges[i][0]
        return len(stay), int(len(stay) - stay.sum()), finish(b" ".join([w.text(a + j) for j in np.flatnonzero(stay).tolist()]))

    return _apply(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), text_col, width, prefix, rest, f"n_words bigint, n_removed bigint, {last} string").drop(text_col)


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, prefix: int = PREFIX) -> DataFrame:
    """id and the maximal repeats of each text, as spans of words (start, stop)."""

    def rest(w: Words, i: int, stay: np.ndarray) -> tuple:
        return ([{"start": a, "stop": b} for a, b in _runs(~stay)],)

    return _apply(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), text_col, width, prefix, rest, "spans array<struct<start:bigint,stop:bigint>>").drop(text_col)


def cut(docs: DataFrame, *, text_col: str = "text", width: int = WIDTH, prefix: int = PREFIX) -> DataFrame:
    """All columns of ``docs``, repeats cut out of the text; white space between kept words stays.

    Rows that had words and lose all of them go.
    """
    left, some = own_names(docs, "rest", "some")

    def rest(w: Words, i: int, stay: np.ndarray) -> tuple:
        a, b = w.ranges[i]
        if stay.all():
            return (None, True)
        out = [w.data[w.start[a + x] : w.start[a + y] if a + y < b else w.stop[b - 1]] for x, y in _runs(stay)]
        return b"".join(out).decode("utf-8", "surrogatepass"), bool(stay.any())

    out = _apply(docs, text_col, width, prefix, rest, f"`{left}` string, `{some}` boolean")
    out = out.where(F.col(f"`{some}`")).withColumn(text_col, F.coalesce(F.col(f"`{left}`"), F.col(f"`{text_col}`")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _apply(docs: DataFrame, text_col: str, width: int, prefix: int, rest, schema: str) -> DataFrame:
    """The rows with the columns of ``schema``, which ``rest(words, i, stay)`` gives for each text."""
    marks = repeats(docs, text_col=text_col, width=width, prefix=prefix)
    bits = _bits(marks)
    given, more = docs.schema, _parse_datatype_string(schema)
    tid, bit, copied, blocks, ranges = own_names(docs, "tid", "bit", "copied", "blocks", "ranges")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.withColumns({tid: F.unhex(F.md5(text))}).withColumn(bit, F.xxhash64(tid))
    out = StructType([*given.fields, *more.fields])
    names = more.names

    def plain(batches):
        for b in batches:
            take = pa.array(~_in(bits, b[bit]))
            own = {n: b[n].filter(take) for n in given.names}
            every = texts_of(own[text_col])
            got = []
            for lo, hi in chunks([len(t) for t in every]):
                w = Words(every[lo:hi])
                got += [rest(w, i, np.ones(y - x, bool)) for i, (x, y) in enumerate(w.ranges)]
            yield own | {n: [g[k] for g in got] for k, n in enumerate(names)}

    def passing(batches):
        for b in batches:
            take = pa.array(_in(bits, b[bit]))
            yield {k: v.filter(take) for k, v in b.items()}

    def marked(batches):
        for b in batches:
            every = texts_of(b[text_col])
            mark = [None if c is None else {"copied": c, "blocks": k, "ranges": s} for c, k, s in zip(b[copied].to_pylist(), b[blocks].to_pylist(), b[ranges].to_pylist(), strict=True)]
            got = []
            for lo, hi in chunks([len(t) for t in every]):
                w = Words(every[lo:hi])
                s = Blocks(w, width, prefix)
                got += [rest(w, i, _kept(w, i, s, mark[lo + i], width)) for i in range(hi - lo)]
            yield {n: b[n] for n in given.names} | {n: [g[k] for g in got] for k, n in enumerate(names)}

    found = marks.select(F.col("tid").alias(tid), F.col("copied").alias(copied), F.col("blocks").alias(blocks), F.col("ranges").alias(ranges))
    hard = map_rows(rows, rows.schema, passing).join(found.hint("merge"), tid, "left")
    return map_rows(rows, out, plain).unionByName(map_rows(hard, out, marked))
