"""Secret scans: base patterns and a likelihood-ratio test of two character Markov models.

One model is trained on random strings (generated), one on ordinary names: all transitions within
the words of all texts, outside base spans, and between words joined to names. The counts are
scaled to one weight, so that more text makes the model exact and not its rare transitions rarer.
A candidate is a run of 20 or more characters of ``[A-Za-z0-9+/_=-]``, or what base spans leave
of one; the logarithm of its likelihood ratio under the two models, per character, must
reach ``THRESHOLD`` and it needs a digit and a letter. Of a run that doesn't reach it, stretches
of 20 or more characters count that do and that exceed it by ``EXCESS`` in all: a key among the
words of a path is found at any length of the path. Such a stretch is taken from joint to joint
(``/_=-``); stretches are disjoint, and what follows one is scanned on its own. Base spans always
stay. Time is linear in a text's length and its base spans.

Positions are code points, ends exclusive. Null texts count as empty: no spans. Texts are
scanned whole; repeated rows are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import random
import re
import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import chunks, map_rows, pick, texts_of

KINDS = ("assign", "access", "hex", "markov")
#: Words, and names made of words, that the ordinary model's counts are scaled to.
WEIGHT = 8000
#: Mean log-likelihood ratio of a character from which a candidate counts as random.
THRESHOLD = 0.6
#: Log-likelihood ratio above THRESHOLD, summed over a stretch, by which part of a run counts as random.
EXCESS = 4.0
#: Characters of a candidate at least; joints of names.
LEAST, JOINTS = 20, "/_=-"

# The base rules and the lengths that their values need.
ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of base matches, by start and then kind."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sort(out)


def sort(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


ALPHABET = string.ascii_letters + string.digits + "+/_=-"
#: Characters of the alphabet, and one place for all others.
SIZE = len(ALPHABET) + 1
PLACE = np.full(128, len(ALPHABET), np.int64)
PLACE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


class Markov:
    """Transition log-probabilities of order 1 over the candidates' alphabet, smoothed."""

    def __init__(self, strings: list[str] | np.ndarray, smooth: float = 0.5) -> None:
        """From strings, or from the counts of their transitions."""
        counts = np.full((SIZE, SIZE), smooth)
        if isinstance(strings, np.ndarray):
            counts += strings
            strings = []
        for s in strings:
            at = self.places(s)
            np.add.at(counts, (at[:-1], at[1:]), 1.0)
        self.logp = np.log(counts / counts.sum(1, keepdims=True))

    @staticmethod
    def places(s: str) -> np.ndarray:
        return PLACE[np.minimum(np.frombuffer(s.encode("latin-1", "replace"), np.uint8), 127)]


def mixed(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


class Scanner:
    def __init__(self, ordinary: list[str] | np.ndarray, randoms: list[str], threshold: float = THRESHOLD) -> None:
        self.ratio = Markov(randoms).logp - Markov(ordinary).logp
        self.threshold = threshold

    def score(self, s: str) -> float:
        at = Markov.places(s)
        return float(self.ratio[at[:-1], at[1:]].mean()) if len(at) > 1 else 0.0

    def stretches(self, s: str) -> list[tuple[int, int]]:
        """The whole of a run, if it counts as random, or else the parts of it that do, disjoint and in order."""
        if not mixed(s):
            return []
        if self.score(s) >= self.threshold:
            return [(0, len(s))]
        at = Markov.places(s)
        gains = [*(self.ratio[at[:-1], at[1:]] - self.threshold).tolist(), -math.inf]
        out: list[tuple[int, int]] = []
        total, start, best, peak, floor, i = 0.0, 0, 0.0, 0, 0, 0
        # A stretch begins where the sum leaves zero and ends at its peak, once the sum falls EXCESS below.
        # Whatever is widened to its joints is done with, so each character is passed a few times at most.
        while i < len(gains):
            total += gains[i]
            if total > best:
                best, peak = total, i + 1
            if total <= 0 or total < best - EXCESS:
                if best >= EXCESS:
                    a, b = start, min(peak + 1, len(s))
                    while a < b and s[a] in JOINTS:
                        a += 1
                    while a > floor and s[a - 1] not in JOINTS:
                        a -= 1
                    while b > a and s[b - 1] in JOINTS:
                        b -= 1
                    while b < len(s) and s[b] not in JOINTS:
                        b += 1
                    if b - a >= LEAST and mixed(s[a:b]):
                        out.append((a, b))
                    floor = b
                    i = max(i, b - 1)
                total, start, best = 0.0, i + 1, 0.0
            i += 1
        return out

    def spans(self, text: str) -> list[Span]:
        out = base_spans(text)
        taken = [(a, b) for a, b, _ in out]
        more = []
        k = 0  # base spans before it end before the candidate
        for m in CANDIDATE.finditer(text):
            at, end = m.start(), m.end()
            while k < len(taken) and taken[k][1] <= at:
                k += 1
            j = k
            while at < end:
                x, y = taken[j] if j < len(taken) and taken[j][0] < end else (end, end)
                if x - at >= LEAST:
                    more += [(at + a, at + b, "markov") for a, b in self.stretches(text[at:x])]
                at = max(at, y)
                j += 1
        return sort(out + more)


def random_strings(n: int = 4000, seed: int = 7) -> list[str]:
    """Labelled samples of the random class: hexadecimal, base-36, base-62 and base-64 keys."""
    r = random.Random(seed)
    kinds = [string.digits + "abcdef", string.digits + string.ascii_lowercase, string.digits + string.ascii_uppercase, string.ascii_letters + string.digits, ALPHABET[:64]]
    return ["".join(r.choices(kinds[i % len(kinds)], k=r.randint(20, 64))) for i in range(n)]


def identifiers(words: list[str], n: int = 8000, seed: int = 11) -> list[str]:
    """Labelled samples of the ordinary class: words, and names made of them with joints and numbers."""
    r = random.Random(seed)
    words = sorted({w for w in words if w.isascii() and w.isalpha()}) or ["name", "value", "index", "count"]
    out = list(words)
    for i in range(n):
        w = r.choices(words, k=r.randint(2, 5))
        name = ["_".join(w), "-".join(w), "/".join(w), w[0] + "".join(x.title() for x in w[1:]), "_".join(w).upper()][i % 5]
        out.append(name + (f"_{r.randint(0, 2030)}" if i % 3 == 0 else ""))
    return out


#: Parts of a word count: its first transition, its later ones, its last letter (as a transition to itself).
FIRST, LATER, LAST = range(3)


def word_counts(text: str) -> np.ndarray:
    """Counts by part, letter and next letter of words of two or more ASCII letters that no base span touches."""
    at = Markov.places(text)
    letter = np.zeros(len(at) + 2, bool)
    letter[1:-1] = at < 52
    spans = base_spans(text)
    if spans:
        edge = np.diff(letter.astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # Runs of letters that end at a span's start or later and start at its end or earlier are touched.
        touched = np.zeros(len(starts) + 1, np.int64)
        np.add.at(touched, np.searchsorted(ends, [a for a, _, _ in spans], "left"), 1)
        np.add.at(touched, np.searchsorted(starts, [b for _, b, _ in spans], "right"), -1)
        gone = np.cumsum(touched[:-1]) > 0
        size = (ends - starts)[gone]
        letter[np.repeat(starts[gone] - np.cumsum(size) + size, size) + np.arange(size.sum()) + 1] = False
    before, here, after = letter[:-2], letter[1:-1], letter[2:]
    out = np.zeros((3, SIZE * SIZE), np.int64)
    for part, i in ((FIRST, np.flatnonzero(~before & here & after)), (LATER, np.flatnonzero(before & here & after))):
        out[part] = np.bincount(at[i] * SIZE + at[i + 1], minlength=SIZE * SIZE)
    i = np.flatnonzero(before & here & ~after)
    out[LAST] = np.bincount(at[i] * (SIZE + 1), minlength=SIZE * SIZE)
    return out.reshape(3, SIZE, SIZE)


def ordinary(counts: np.ndarray) -> np.ndarray:
    """Expected transitions of ``WEIGHT`` words and of as many names as ``identifiers`` makes of words."""
    first, later, last = counts / counts[FIRST].sum()
    start, end, words = first.sum(1), last.diagonal(), first + later
    code = Markov.places
    lower, upper = np.eye(SIZE), np.eye(SIZE)
    small, large = code(string.ascii_lowercase), code(string.ascii_uppercase)
    lower[large, large] = upper[small, small] = 0
    lower[large, small] = upper[small, large] = 1

    def joint(c: str, case: np.ndarray | None = None) -> np.ndarray:
        own = np.eye(SIZE) if case is None else case
        out = np.zeros((SIZE, SIZE))
        out[:, code(c)[0]] += end @ own
        out[code(c)[0]] += start @ own
        return out

    n = 3.5  # words of a name on average
    names = sum(n * words + (n - 1) * joint(c) for c in "_-/")
    names = names + words + (n - 1) * (upper.T @ first @ lower + lower.T @ later @ lower + np.outer(end, start @ upper))
    names = names + n * upper.T @ words @ upper + (n - 1) * joint("_", upper)
    numbers = np.zeros((SIZE, SIZE))
    for i in range(2031):
        at = code(f"_{i}")
        np.add.at(numbers, (at[:-1], at[1:]), 1 / 2031)
    numbers[:, code("_")[0]] += 0.8 * end + 0.2 * (end @ upper)
    return WEIGHT * (words + names / 5 + numbers / 3)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Scanner:
    """Fit both models; the driver gets the counts of pairs of letters, summed over all whole texts."""

    def run(batches):
        total = np.zeros((3, SIZE, SIZE), np.int64)
        for b in batches:
            texts = texts_of(b[text_col])
            for i, j in chunks([len(t) for t in texts]):
                # No word and no base span goes beyond a line.
                total += word_counts("\n".join(texts[i:j]))
        cell = np.flatnonzero(total)
        yield {"cell": cell, "n": total.ravel()[cell]}

    cells = map_rows(pick(docs, text_col), "cell bigint, n bigint", run).groupBy("cell").agg(F.sum("n")).collect()
    counts = np.zeros(3 * SIZE * SIZE)
    for cell, n in cells:
        counts[cell] = n
    return Scanner(ordinary(counts.reshape(3, SIZE, SIZE)) if cells else identifiers([]), random_strings())


def scan(docs: DataFrame, scanner: Scanner, *, id_col: str = "doc_id", text_col: str = "text", work=None, schema: str = "spans array<struct<start:bigint,stop:bigint,kind:string>>") -> DataFrame:
    """Per row its id and its spans, or what ``work(text, spans)`` gives for ``schema``."""
    rows = pick(docs, id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    import pyspark.sql.types as T

    names = T._parse_datatype_string(schema).names
    work = work or (lambda _, spans: ([{"start": a, "stop": b, "kind": k} for a, b, k in spans],))

    def run(batches):
        for b in batches:
            got = [work(t, scanner.spans(t)) for t in texts_of(b[text_col])]
            yield {id_col: b[id_col]} | {n: [g[i] for g in got] for i, n in enumerate(names)}

    return map_rows(rows, f"`{id_col}` {kind}, {schema}", run)


def redact(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with each span, or chain of overlapping spans, replaced by ``mark``."""
    out, at, stop = [], 0, -1
    for a, b, _ in spans:
        if a >= max(stop, 0) and a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
        stop = at
    return "".join([*out, text[at:]])


def clean(docs: DataFrame, scanner: Scanner, *, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, secrets in the text replaced; null texts stay null."""

    def run(batches):
        for b in batches:
            yield b | {text_col: [None if t is None else redact(t, scanner.spans(t)) for t in b[text_col].to_pylist()]}

    return map_rows(docs, docs.schema, run)
