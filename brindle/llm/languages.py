"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of signs. An n-gram is bound by multiplying its letters'
vectors, each rotated by its place; a text is the bundle (sum) of its n-grams, a language the bundle of
its documents. A text's language is the prototype of largest cosine.

N-grams are of ``N`` small letters; whatever is no letter separates words and stands as one space at their
ends. Prototypes grow by sums alone: a task adds up its documents by language, Spark adds up the tasks. The driver
holds one vector a language. Bundles are sums of integers, so they are exact and don't depend on the order of rows.

Texts are used whole. A text that is null or has no letter is ``und`` with score 0, as is every text where
nothing was learned. Rows without language don't teach; of languages at equal cosine the first in
order of code points is taken. Repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import chunks, map_rows, own_names, pick, texts_of

#: Dimensions of the vectors, letters of an n-gram.
DIM, N = 1024, 3
#: N-grams whose vectors a worker keeps, letters likewise.
GRAMS, LETTERS = 16_384, 4_096
#: Characters of a chunk of texts; a longer text is bundled a piece at a time.
PIECE = 200_000
UNKNOWN = "und"
SPACE = 32


@cache
def letter_table() -> np.ndarray:
    """Which code points are letters."""
    out = np.zeros(0x110000, bool)
    out[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return out


class Space:
    """Vectors of letters and n-grams, made from the seed when they are first met."""

    def __init__(self, dim: int = DIM, seed: int = 42) -> None:
        self.dim, self.seed = dim, seed
        self.letters: dict[int, np.ndarray] = {}
        self.codes = np.empty(0, np.int64)
        self.vectors = np.empty((0, dim), np.float32)

    def letter(self, point: int) -> np.ndarray:
        got = self.letters.get(point)
        if got is None:
            if len(self.letters) >= LETTERS:
                self.letters.clear()
            got = np.random.Generator(np.random.PCG64([self.seed, point])).integers(0, 2, self.dim, np.int8) * np.int8(2) - np.int8(1)
            self.letters[point] = got
        return got

    def bind(self, code: int) -> np.ndarray:
        """The vector of one n-gram: the product of its letters' vectors, rotated by their distance from the end."""
        out = np.ones(self.dim, np.int8)
        for back in range(N):
            out *= np.roll(self.letter(code >> 21 * back & 0x1FFFFF), back)
        return out

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of sorted distinct n-grams."""
        at = np.searchsorted(self.codes, codes)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == codes[known]
        fresh = codes[~known]
        if len(fresh):
            new = np.array([self.bind(int(c)) for c in fresh], np.float32)
            if len(self.codes) + len(fresh) > GRAMS:
                if len(codes) > GRAMS:
                    return np.concatenate([self.vectors[at[known]], new])[np.argsort(np.concatenate([np.flatnonzero(known), np.flatnonzero(~known)]))]
                keep = at[known]
                self.codes, self.vectors = self.codes[keep], self.vectors[keep]
            both = np.concatenate([self.codes, fresh])
            order = np.argsort(both)
            self.codes, self.vectors = both[order], np.concatenate([self.vectors, new])[order]
            at = np.searchsorted(self.codes, codes)
        return self.vectors[at]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams, and the text that each belongs to. An n-gram holds a letter at the place before its last."""
    raw = "\0".join(["", *[t.lower().replace("\0", " ") for t in texts], ""]).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(raw, "<u4").astype(np.int64)
    owner = np.cumsum(points == 0) - 1
    letter = letter_table()[points]
    keep = letter | np.concatenate([[True], letter[:-1]])  # of each gap its first place, as a space
    points, owner = np.where(letter, points, SPACE)[keep], owner[keep]
    here = points[1:-1] != SPACE
    codes = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
    return codes[here], owner[1:-1][here]


def pieces(text: str) -> list[str]:
    """A long text in pieces that end at a character that is no letter, where there is one."""
    if len(text) <= PIECE:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and text[end].isalpha() and end < at + 2 * PIECE:
            end += 1
        out.append(text[at:end])
        at = end
    return out


def bundles(texts: list[str], owners: np.ndarray, n: int, space: Space) -> np.ndarray:
    """The sums of the n-grams' vectors for each of n owners; ``owners`` says whose each text is."""
    codes, text = grams(texts)
    out = np.zeros((n, space.dim), np.float64)
    if not len(codes):
        return out
    distinct, inverse = np.unique(codes, return_inverse=True)
    owner = owners[text]
    step = GRAMS
    for a in range(0, len(distinct), step):
        vectors = space.grams(distinct[a : a + step])
        inside = (inverse >= a) & (inverse < a + step)
        # Counts by owner and n-gram times the n-grams' vectors: whole numbers far below 2**24, exact in float32.
        g = len(vectors)
        count = np.bincount(owner[inside] * g + inverse[inside] - a, minlength=n * g).reshape(n, g)
        out += count.astype(np.float32) @ vectors
    return out


def learn(docs: DataFrame, *, teaches: Column | None = None, lang_col: str = "lang", text_col: str = "text", dim: int = DIM, seed: int = 42) -> dict[str, np.ndarray]:
    """Prototypes of the languages of all rows that have one and where ``teaches`` holds."""
    rows = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    rows = pick(rows if teaches is None else rows.where(teaches), lang_col, text_col)

    def run(batches):
        space, total = Space(dim, seed), {}
        for b in batches:
            langs, texts = b[lang_col].to_pylist(), texts_of(b[text_col])
            names = sorted(set(langs))
            place = {x: i for i, x in enumerate(names)}
            parts = [(p, place[x]) for x, t in zip(langs, texts, strict=True) for p in pieces(t)]
            for lo, hi in chunks([len(p) for p, _ in parts], PIECE):
                got = bundles([p for p, _ in parts[lo:hi]], np.array([i for _, i in parts[lo:hi]]), len(names), space)
                for x, v in zip(names, got, strict=True):
                    if v.any():
                        total[x] = total[x] + v.astype(np.int64) if x in total else v.astype(np.int64)
        for x, v in total.items():
            yield {"lang": [x] * dim, "at": np.arange(dim, dtype=np.int32), "v": v}

    out: dict[str, np.ndarray] = {}
    for x, at, v in map_rows(rows, "lang string, at int, v bigint", run).groupBy("lang", "at").agg(F.sum("v")).collect():  # one vector a language
        out.setdefault(x, np.zeros(dim))[at] = v
    return out


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], *, text_col: str = "text", seed: int = 42) -> DataFrame:
    """The rows with the columns lang_pred and score (the cosine, at least 0) besides their own."""
    names = sorted(prototypes)
    pred, score = own_names(docs, "lang_pred", "score")
    dim = len(prototypes[names[0]]) if names else DIM
    base = np.array([prototypes[x] / np.linalg.norm(prototypes[x]) for x in names]) if names else np.zeros((0, dim))

    def run(batches):
        space = Space(dim, seed)
        for b in batches:
            texts = texts_of(b[text_col])
            langs, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
            parts = [(p, i) for i, t in enumerate(texts) for p in pieces(t)] if names else []
            held = None
            for lo, hi in chunks([len(p) for p, _ in parts], PIECE):
                own = np.array([i for _, i in parts[lo:hi]])
                first = int(own[0])
                got = bundles([p for p, _ in parts[lo:hi]], own - first, int(own[-1]) - first + 1, space)
                if lo and parts[lo - 1][1] == first:
                    got[0] += held  # the earlier pieces of a long text
                held = got[-1]
                size = np.linalg.norm(got, axis=1)
                like = got @ base.T / np.where(size > 0, size, 1)[:, None]
                for i in range(len(got)):
                    if size[i] > 0:
                        k = int(like[i].argmax())
                        langs[first + i], best[first + i] = names[k], min(max(float(like[i, k]), 0.0), 1.0)
            yield b | {pred: langs, score: best}

    return map_rows(docs, f"{_ddl(docs)}, `{pred}` string, `{score}` double".lstrip(", "), run)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


__all__ = ["Space", "bundles", "grams", "identify", "learn"]
