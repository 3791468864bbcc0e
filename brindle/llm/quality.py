"""Quality rules: gradient-boosted trees over statistics of a document.

The trees are trained on the driver from a bounded sample of labelled documents, with
monotonic constraints on chosen statistics (more symbols, repeats or capitals never raise
quality), and flattened into numpy node arrays, with which whole batches are scored.

Words are ``[^\\x20\\x09-\\x0D]+``. Null texts have no words and fail the base rules, as do
empty and very short ones. Texts are read whole. Repeated rows get equal verdicts. Labels
that are null or lie on missing documents are left out of the training; without labels of
both classes every document that passes the base rules is kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import chunks, map_rows, pick, texts_of, thin

#: Labelled documents that the training sees at most, least hash of the id first.
SAMPLE = 8000
#: Trees, their depth, learning rate, least rows of a leaf and L2 penalty.
TREES, DEPTH, RATE, LEAF, L2 = 40, 4, 0.2, 8, 1.0
#: Log-odds of bad quality from which a document is rejected.
REJECT = 0.0
WINDOW = 8
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics of the model (words and the longest word's bytes as logarithms); the sign says which way more of it may move log-odds of bad quality.
STATS = {
    "symbols_per_char": 1, "dup_line_share": 1, "repeat_share": 1, "upper_share": 1, "bang_share": 1,
    "pipe_share": 1, "word_length": 0, "words": -1, "line_length": 0, "distinct_share": 0,
    "digit_share": 0, "stop_share": 0, "longest_word": 0,
}


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text.

    Windows get exact numbers by doubling: pairs, then fours, then eights.
    """
    n = len(words)
    if n <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    done = 1
    while done < width:
        more = min(done, width - done)
        pairs = ids[: len(ids) - more] * (int(ids.max()) + 1) + ids[more:]
        uniq, ids = np.unique(pairs, return_inverse=True)
        if len(uniq) == len(pairs):
            return 0
        done += more
    twice = np.bincount(ids)[ids] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The base counts and the model's statistics of one text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    white = sum(text.count(c) for c in "\x20\x09\x0a\x0b\x0c\x0d")
    chars = len(text) - white
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x and x.encode().split()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    c, w = max(chars, 1), max(n, 1)
    b = np.frombuffer(raw, np.uint8)
    upper = int(((b >= 65) & (b <= 90)).sum())
    letters = int((((b | 32) >= 97) & ((b | 32) <= 122)).sum())
    digits = int(((b >= 48) & (b <= 57)).sum())
    bang = text.count("!")
    distinct = len(set(words))
    short = sum(1 for x in words if len(x) <= 3)
    model = [symbols / c, dup / max(len(lines), 1), repeat / w, upper / max(letters, 1), bang / w, text.count("|") / w, chars / w, math.log1p(n), n / max(len(lines), 1), distinct / w, digits / c, short / w, math.log1p(max(map(len, words), default=0))]
    return [n, chars, symbols, dup, repeat], model


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 20 or 100 * n_repeat > 30 * n_words


@dataclass
class Trees:
    """Nodes of all trees in one set of arrays; leaves point to themselves."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of bad quality, for a matrix of statistics."""
        if not len(self.roots) or not len(x):
            return np.full(len(x), self.base)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)


def fit(x: np.ndarray, bad: np.ndarray, signs: list[int], *, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = 64) -> Trees:
    """Boost trees for the logistic loss on histograms, keeping to the signs.

    A split on a constrained statistic is allowed only if the children's values are in
    order; their midpoint then bounds all values below either child.
    """
    n, d = x.shape
    nodes: list[list] = []
    roots: list[int] = []
    p = bad.mean() if n else 0.0
    base = float(np.log(p / (1 - p))) if 0 < p < 1 else -20.0
    if n and 0 < p < 1:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        score = np.full(n, base)

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, lo: float, hi: float, level: int) -> int:
            sg, sh = g[rows].sum(), h[rows].sum()
            value = float(np.clip(-sg / (sh + L2), lo, hi))
            me = len(nodes)
            nodes.append([0, np.inf, me, me, rate * value])
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * LEAF:
                for j in range(d):
                    b, k = binned[rows, j], len(edges[j]) + 1
                    if k < 2:
                        continue
                    gl = np.bincount(b, g[rows], k).cumsum()[:-1]
                    hl = np.bincount(b, h[rows], k).cumsum()[:-1]
                    nl = np.bincount(b, minlength=k).cumsum()[:-1]
                    vl, vr = np.clip(-gl / (hl + L2), lo, hi), np.clip(-(sg - gl) / (sh - hl + L2), lo, hi)
                    worth = lambda gg, hh, v: -(gg * v + 0.5 * (hh + L2) * v * v)
                    gain = worth(gl, hl, vl) + worth(sg - gl, sh - hl, vr) - worth(sg, sh, value)
                    gain[(nl < LEAF) | (len(rows) - nl < LEAF) | (signs[j] * (vr - vl) < 0)] = -1
                    if len(gain) and (i := int(gain.argmax())) >= 0 and gain[i] > best[0]:
                        best = (gain[i], (j, i, vl[i], vr[i]))
            if best[1]:
                j, i, vl, vr = best[1]
                mid = (vl + vr) / 2
                left_bound, right_bound = ((lo, mid), (mid, hi)) if signs[j] > 0 else ((mid, hi), (lo, mid)) if signs[j] < 0 else ((lo, hi), (lo, hi))
                under = binned[rows, j] <= i
                nodes[me][:2] = [j, float(edges[j][i])]
                nodes[me][2] = grow(rows[under], g, h, *left_bound, level + 1)
                nodes[me][3] = grow(rows[~under], g, h, *right_bound, level + 1)
            return me

        for _ in range(trees):
            q = 1 / (1 + np.exp(-score))
            first = len(nodes)
            roots.append(grow(np.arange(n), q - bad, q * (1 - q), -np.inf, np.inf, 0))
            one = _flat(nodes, [first], 0.0, depth)
            score += one.score(x)
    return _flat(nodes, roots, base, depth)


def _flat(nodes: list[list], roots: list[int], base: float, depth: int) -> Trees:
    cols = list(zip(*nodes, strict=True)) if nodes else [[]] * 5
    return Trees(np.array(cols[0], np.int64), np.array(cols[1]), np.array(cols[2], np.int64), np.array(cols[3], np.int64), np.array(cols[4]), np.array(roots, np.int64), base, depth)


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: Trees | None = None) -> DataFrame:
    """id, base counts, and the statistics (without a model) or ``badness``, ``base_failed`` and ``kept``."""
    rows = pick(docs, id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, texts = b[id_col], texts_of(b[text_col])
            for lo, hi in chunks([len(t) for t in texts]):
                got = [statistics(t) for t in texts[lo:hi]]
                out = {id_col: ids[lo:hi]} | {k: [g[0][i] for g in got] for i, k in enumerate(BASE)}
                if model is None:
                    yield out | {"stats": [g[1] for g in got]}
                    continue
                failed = [base_failed(g[0][0], g[0][4]) for g in got]
                score = model.score(np.array([g[1] for g in got], float))
                yield out | {"badness": score.tolist(), "base_failed": failed, "kept": [not f and s < REJECT for f, s in zip(failed, score.tolist(), strict=True)]}

    counts = ", ".join(f"{k} bigint" for k in BASE)
    return map_rows(rows, f"`{id_col}` {kind}, {counts}, " + ("stats array<double>" if model is None else "badness double, base_failed boolean, kept boolean"), run)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Trees:
    """Fit on at most ``sample`` labelled documents (label 1: good, 0: bad)."""
    few = labels.select(id_col, label_col).where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    few = thin(few, sample, id_col).orderBy(F.xxhash64(id_col), id_col, label_col).limit(sample)
    rows = pick(docs, id_col, text_col).join(F.broadcast(few), id_col)  # at most ``sample`` labels
    one = measure(rows.select(id_col, text_col), id_col=id_col, text_col=text_col)
    got = one.join(F.broadcast(few), id_col).select(id_col, label_col, "n_words", "n_repeat_words", "stats").collect()
    got = sorted((r for r in got if not base_failed(r["n_words"], r["n_repeat_words"])), key=lambda r: (r[0], r[1], r["stats"]))
    x = np.array([r["stats"] for r in got], float).reshape(len(got), len(STATS))
    return fit(x, np.array([1 - r[1] for r in got], float), list(STATS.values()))


def keep(docs: DataFrame, model: Trees, *, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that pass the base rules and the model."""

    def run(batches):
        for b in batches:
            texts, stay = texts_of(b[text_col]), []
            for lo, hi in chunks([len(t) for t in texts]):
                got = [statistics(t) for t in texts[lo:hi]]
                score = model.score(np.array([g[1] for g in got], float))
                stay += [not base_failed(g[0][0], g[0][4]) and x < REJECT for g, x in zip(got, score.tolist(), strict=True)]
            take = pa.array(stay, pa.bool_())
            yield {k: v.filter(take) for k, v in b.items()}

    return map_rows(docs, docs.schema, run)
