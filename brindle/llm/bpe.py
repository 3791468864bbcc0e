"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

A text becomes an array of code points, each of which a table maps to a class (letter,
number, white space, other). The splitting rule is an automaton over these classes.
Every class is a function from state to state; the functions that arise by composition
are few, so they are numbered once (``Automaton``) and composed by table lookup. As
composition is associative, all prefixes are found by a blocked scan in numpy: no regular
expression and no loop over characters. Each slice between boundaries is merged by rank
once and kept in a bounded cache.

Null texts count as empty: no tokens. Repeated rows give equal results. Texts of any
length are worked on whole; long slices merge with a heap in O(n log n).
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from brindle.llm.common import chunks, held, map_rows, pick, texts_of

#: Entries of a worker's cache of slices; a full cache starts anew (results don't change).
CACHE_ENTRIES = 700_000

# The code points with the White_Space property.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Symbols of the automaton. A symbol says what a code point is and, for white space and
# apostrophes, what follows it, so that the automaton needs no look-ahead of its own.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACES, LAST_SPACE, LAST_WHITE = range(8)
# States: what a next code point could extend.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACES, AFTER_SPACE, ONE_MORE, TWO_MORE = range(8)


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a slice starts at this symbol."""
    if symbol == LETTER:
        if state == TWO_MORE:
            return ONE_MORE, False
        if state == ONE_MORE:
            return FREE, False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_SPACE)
    if symbol in (OTHER, SHORT, LONG):
        if symbol == OTHER or state in (IN_OTHER, AFTER_SPACE):
            return IN_OTHER, state not in (IN_OTHER, AFTER_SPACE)
        return (ONE_MORE if symbol == SHORT else TWO_MORE), True
    if symbol == SPACES:
        return IN_SPACES, state != IN_SPACES
    return (AFTER_SPACE if symbol == LAST_SPACE else FREE), True


class Automaton:
    """The monoid of transition functions, closed under composition.

    Symbols 0 to 7 are as above; 8 to 15 are the same at the start of a text, where the
    state before doesn't count.
    """

    def __init__(self) -> None:
        base = [tuple(step(s, k)[0] for s in range(8)) for k in range(8)]
        base += [(step(FREE, k)[0],) * 8 for k in range(8)]
        ids: dict[tuple[int, ...], int] = {}
        for f in base:
            ids.setdefault(f, len(ids))
        todo = list(ids)
        while todo:
            f = todo.pop()
            for g in list(ids):
                for h in (tuple(g[x] for x in f), tuple(f[x] for x in g)):
                    if h not in ids:
                        ids[h] = len(ids)
                        todo.append(h)
        every = list(ids)
        assert len(every) <= 16, "a pair of functions must fit in one byte"
        self.of_symbol = np.array([ids[f] for f in base], np.uint8)
        # then[a << 4 | b]: first a, then b
        self.then = np.zeros(256, np.uint8)
        for f in every:
            for g in every:
                self.then[ids[f] << 4 | ids[g]] = ids[tuple(g[x] for x in f)]
        self.from_free = np.array([f[FREE] for f in every], np.uint8)
        # starts[state << 4 | symbol]
        self.starts = np.array([[step(s, k)[1] for k in range(8)] + [True] * 8 for s in range(8)], bool).ravel()

    def scan(self, a: np.ndarray, width: int = 64) -> np.ndarray:
        """Inclusive prefix compositions: rows of a block in step, then the blocks' totals."""
        n = len(a)
        if n <= width:
            out = a.copy()
            for i in range(1, n):
                out[i] = self.then[out[i - 1] << 4 | a[i]]
            return out
        rows = -(-n // width)
        full = np.zeros(rows * width, np.uint8)
        full[:n] = a
        grid = np.ascontiguousarray(full.reshape(rows, width).T)
        for i in range(1, width):
            grid[i] = self.then[grid[i - 1] << 4 | grid[i]]
        before = self.scan(grid[-1].copy(), width)[:-1]
        grid[:, 1:] = self.then[before[None, :] << 4 | grid[:, 1:]]
        return grid.T.ravel()[:n]


@cache
def automaton() -> Automaton:
    return Automaton()


@cache
def class_table() -> np.ndarray:
    """For every code point: 0 letter, 1 number, 2 other, 3 white space."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[WHITE_SPACE] = 3
    return table


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where slices start, for code points of several texts; ``first``: their starts."""
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = class_table()[points]
    sym = kind.copy()
    begins = np.zeros(n + 1, bool)
    begins[first] = begins[n] = True
    white = kind == 3
    last = np.ones(n, bool)  # white space that something else follows
    last[:-1] = ~white[1:]
    last &= ~begins[1:]
    sym[white] = np.where(last[white], np.where(points[white] == 0x20, LAST_SPACE, LAST_WHITE), SPACES)
    at = np.flatnonzero(points == 0x27)
    if len(at):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        ends = np.concatenate([begins, [True]])
        one, two = padded[at + 1].copy(), padded[at + 2].copy()
        one[ends[at + 1]] = 0
        two[ends[at + 1] | ends[at + 2]] = 0
        # The contractions 's 't 'm 'd and 're 've 'll.
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(at), bool)
        for x, y in ("re", "ve", "ll"):
            long |= (one == ord(x)) & (two == ord(y))
        sym[at[short]] = SHORT
        sym[at[long]] = LONG
    sym[begins[:n]] += 8
    m = automaton()
    done = m.scan(m.of_symbol[sym])
    state = np.empty(n, np.uint8)
    state[0] = FREE
    state[1:] = m.from_free[done[:-1]]
    return np.flatnonzero(m.starts[state << 4 | sym])


def slices(texts: list[str]) -> list[list[str]]:
    """The slices of each text."""
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    first = np.array([e - len(t) for e, t in zip(ends, texts, strict=True) if t], np.int64)
    cut = boundaries(points, first)
    of = np.searchsorted(cut, ends).tolist()
    cut = cut.tolist()
    cut.append(len(whole))
    every = [whole[a:b] for a, b in zip(cut, cut[1:])]
    return [every[a:b] for a, b in zip([0, *of], of)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the pair of lowest rank, leftmost first, until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > 200:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get, none = ranks.get, 1 << 60
    pair = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pair:
        low = min(pair)
        if low == none:
            break
        i = pair.index(low)
        parts[i] += parts.pop(i + 1)
        pair.pop(i)
        if i < len(pair):
            pair[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(piece)
    end = list(range(1, n + 1))
    prev = list(range(-1, n - 1))
    alive = bytearray(b"\1" * n)
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or mid >= n or not alive[mid] or end[mid] != stop:
            continue
        alive[mid] = 0
        end[i] = stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[stop]))
        if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, i, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class SliceCache:
    """Ids of slices, as little-endian 32-bit bytes, kept up to a number of entries."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], most: int = CACHE_ENTRIES) -> None:
        self.encode, self.most, self.held = encode, most, {}

    def ids(self, pieces: list[list[str]]) -> list[bytes]:
        need = set().union(*pieces)
        new = need.difference(self.held)
        if len(self.held) + len(new) > self.most:
            self.held.clear()
            new = need
        new = list(new)
        self.held.update(zip(new, self.encode(new), strict=True))
        get = self.held.__getitem__
        return [b"".join(map(get, x)) for x in pieces]


class Codec:
    """A vocabulary of ranks with its cache; decoding joins the tokens' bytes."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        # The merge loop of the library is used where it is installed; ``merge`` gives the same ids.
        try:
            import tiktoken

            merges = tiktoken.Encoding("slices", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary
        except ImportError:
            merges = lambda x: merge(x.encode(), self.ranks)
        self.cache = SliceCache(lambda new: (array("I", merges(x)).tobytes() for x in new))

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.cache.ids(slices(texts))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> np.ndarray:
        """The byte at which each token starts, and the end: token i is bytes [o[i], o[i+1])."""
        n = [len(self.tokens[i]) for i in np.frombuffer(ids, "<u4").tolist()]
        return np.concatenate([[0], np.cumsum(n, dtype=np.int64)])


def codec(path: str) -> Codec:
    return held(("codec", path), lambda: Codec(path))


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", work: Callable | None = None, schema: str = "ids binary, offsets binary") -> DataFrame:
    """Per row: its id, ``ids`` (uint32, little-endian) and ``offsets`` (int64 byte offsets).

    ``work(codec, text, ids)`` may give other columns, named by ``schema``.
    """
    rows = pick(docs, id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in schema.split(", ")]
    work = work or (lambda c, _, ids: (ids, c.offsets(ids).tobytes()))

    def run(batches):
        own = codec(path)
        for b in batches:
            ids, texts = b[id_col], texts_of(b[text_col])
            for lo, hi in chunks([len(t) for t in texts]):
                part = texts[lo:hi]
                got = [work(own, t, e) for t, e in zip(part, own.encode(part), strict=True)]
                yield {id_col: ids[lo:hi]} | {n: [g[k] for g in got] for k, n in enumerate(names)}

    return map_rows(rows, f"`{id_col}` {kind}, {schema}", run, holds=True)


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: its id and ``text``, decoded from ``ids``; bytes that are no UTF-8 become U+FFFD."""
    rows = pick(encoded, id_col, ids_col)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        own = codec(path)
        for b in batches:
            yield {id_col: b[id_col], "text": [own.decode(x or b"").decode("utf-8", "replace") for x in b[ids_col].to_pylist()]}

    return map_rows(rows, f"`{id_col}` {kind}, text string", run, holds=True)


__all__ = ["Codec", "SliceCache", "boundaries", "codec", "decode", "encode", "merge", "slices"]
