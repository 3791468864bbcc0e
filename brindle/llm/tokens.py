"""Ids of whole texts by a ``tokenizers`` file, with a bounded cache of text pieces.

``words``: for vocabularies that drop white space, so that no token crosses it: a text is
cut at ASCII white space, and new words are encoded many at a time. ``spaces``: for byte-level vocabularies whose slices may begin
with one space: a text is cut before single spaces and around single line feeds, where a
slice always starts; other texts are cut by ``bpe.slices``. The cuts of many texts are found
over their bytes at once and the pieces numbered in Arrow, so that Python sees each distinct
piece of a chunk once. Each new piece is encoded by the library once. Ids equal those of ``Tokenizer.encode`` on the whole text (the
strings of special tokens count as ordinary text). Null is the empty text.
"""

from __future__ import annotations

import os
from array import array
from itertools import batched, islice

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from brindle.llm import bpe
from brindle.llm.common import held

#: Entries of a worker's cache, by kind.
ENTRIES = {"words": 500_000, "spaces": 600_000}
#: Parts of words that the library gets as one text.
PARTS = 200

# The splitting rule of the word vocabulary, on lower-cased text.
WORD_RULE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


# A trailing run of ASCII punctuation (no apostrophe) behind an ASCII or Latin-1 letter or a
# digit is a part of its own in either rule: fewer distinct pieces.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
WHITE = b" \t\n\v\f\r"
SPACE, LINE = 0x20, 0x0A
#: Bytes of a trailing run; those of words with longer ones stay with their words.
RUN = 8
IS_MARK, IS_PLAIN, IS_LATIN = np.zeros((3, 256), bool)
IS_MARK[list(MARKS)] = True
IS_PLAIN[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True
IS_LATIN[[*range(0xA0, 0xB7), *range(0xB8, 0xC0)]] = True  # behind 0xC3: the lower-case letters of Latin-1


def byte_letters() -> dict[int, str]:
    """Byte-level alphabets write each byte as a letter: printable ones as themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class RecentPieces:
    """Ids of pieces in two halves: what is used moves to the newer one; once that is full, the older one is dropped."""

    def __init__(self, make, most: int) -> None:
        self.make, self.half = make, most // 2
        self.new, self.old = {}, {}

    def ids(self, pieces: list[str]) -> list[bytes | None]:
        """Of distinct pieces; None, which is not kept, where ``make`` gives it."""
        got = list(map(self.new.get, pieces))
        at = [i for i, x in enumerate(got) if x is None]
        for i in at:
            got[i] = self.old.get(pieces[i])
        unknown = [i for i in at if got[i] is None]
        for i, x in zip(unknown, self.make([pieces[i] for i in unknown]), strict=True):
            got[i] = x
        if len(self.new) + len(at) > self.half:
            self.old, self.new = self.new, {}
        self.new.update((pieces[i], got[i]) for i in at if got[i] is not None)
        return got


def piece_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces of ``spaces`` start in the UTF-8 bytes of several texts, which end at ``ends``."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[0] = True
    edge[ends] = True
    line = data == LINE
    at = edge.copy()
    at[:-1] |= line
    at[:-1] |= data == SPACE
    stop = at.copy()  # what may follow a trailing run
    at[1:] |= line
    mark = IS_MARK[data]
    first, last = mark.copy(), mark.copy()
    first[1:] &= ~(mark[:-1] & ~edge[1:n])
    last[:-1] &= ~(mark[1:] & ~edge[1:n])
    runs = np.flatnonzero(first)[stop[np.flatnonzero(last) + 1]]
    runs = runs[~edge[runs]]
    before = data[runs - 1]
    at[runs[IS_PLAIN[before] | (IS_LATIN[before] & (data[np.maximum(runs - 2, 0)] == 0xC3))]] = True
    return np.flatnonzero(at[:-1])


def word_starts(whole: bytes, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Of lower-cased bytes of texts, with white space at either end: what is left without it, where
    pieces of ``words`` start there, and how many there are up to each text's end."""
    data = np.frombuffer(whole, np.uint8)
    white = (data == SPACE) | (data - np.uint8(9) < 5)
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    first, stop = edges[::2], edges[1::2]
    bounds = np.concatenate([[0], np.cumsum(stop - first)])
    plain = whole.translate(None, WHITE)
    data = np.frombuffer(plain, np.uint8)
    marked = np.flatnonzero(IS_MARK[data[bounds[1:] - 1]])
    low, last = bounds[marked], bounds[marked + 1] - 1
    for _ in range(RUN):
        more = IS_MARK[data[last]] & (last >= low)
        if not more.any():
            break
        last -= more
    before = data[last]
    good = (last >= low) & (IS_PLAIN[before] | (IS_LATIN[before] & (last > low) & (data[np.maximum(last - 1, 0)] == 0xC3)))
    begins = np.zeros(len(data) + 1, bool)
    begins[bounds[:-1]] = True
    begins[last[good] + 1] = True
    starts = np.flatnonzero(begins)
    return plain, starts, np.searchsorted(starts, bounds[np.searchsorted(stop, ends, side="right")])


class TextEncoder:
    """``width``: bytes of an id, 2 where the vocabulary allows and the caller asks for it."""

    def __init__(self, path: str, kind: str, width: int = 4) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if kind not in ("words", "spaces"):
            raise ValueError(f"kind must be words or spaces, not {kind}")
        self.kind, self.width = kind, width
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.recent = RecentPieces(self._learn_words if kind == "words" else self._learn, ENTRIES[kind])
        # The model alone, for parts between spaces, and which ids end a part.
        self.bare = Tokenizer(self.model)
        self.bare.pre_tokenizer = CharDelimiterSplit(" ")
        vocab, suffix = self.tokenizer.get_vocab(with_added_tokens=False), getattr(self.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        self.slow = bpe.SliceCache(lambda new: (self._model(x) for x in new), ENTRIES[kind] // 4)

    def _pack(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def _model(self, part: str) -> bytes:
        space, core = ("\u0120", part[1:]) if part[:1] == " " else ("", part)
        plain = core if core.isascii() and core.isalnum() else core.encode().decode("latin-1").translate(self.letters)
        return self._pack([t.id for t in self.model.tokenize(space + plain)])

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of lower-case parts: many in one text, where each ends in a token that ends a part."""
        texts = [" ".join(x) for x in batched(parts, PARTS, strict=False)]
        texts = [x if x.isascii() and x.isprintable() else x.encode().decode("latin-1").translate(self.letters | {SPACE: " "}) for x in texts]
        ids = np.array([i for e in self.bare.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(parts):
            return [self._model(x) for x in parts]
        data, cut = ids.astype(f"<u{self.width}").tobytes(), (ends * self.width).tolist()
        return [data[a:b] for a, b in zip([0, *cut], cut)]

    def _learn_words(self, new: list[str]) -> list[bytes]:
        """Ids of new words or trailing runs."""
        out, parts = [], []
        for x in new:
            # Below U+02B0 text is its own composed form, and each letter lower-cases by itself.
            if not x.isascii() and (max(x) >= "ʰ" or "İ" in x):
                out.append(self._pack(self.tokenizer.encode(x, add_special_tokens=False).ids))
                continue
            low = x.lower()
            own = [low] if low.isalpha() else WORD_RULE.findall(low)
            out.append(len(own))
            parts += own
        ids = iter(self._parts(parts))
        return [x if isinstance(x, bytes) else next(ids) if x == 1 else b"".join(islice(ids, x)) for x in out]

    def _learn(self, new: list[str]) -> list[bytes | None]:
        """Ids of new pieces between spaces; None where the text around a piece decides."""
        out, hard = [], []
        for i, x in enumerate(new):
            core = x[1:] if x[0] == " " else x
            if core.isalpha() or x == "\n":
                out.append(self._model(x))
                continue
            out.append(None)
            if core and not core[0].isspace() and not core[-1].isspace():
                hard.append(i)
        for i, ids in zip(hard, self.slow.ids(bpe.slices([new[i] for i in hard])), strict=True):
            out[i] = ids
        return out

    def _known(self, whole: bytes, starts: np.ndarray) -> pa.Array:
        """Ids of all pieces; null where the text around a piece decides."""
        bounds = np.append(starts, len(whole))
        pieces = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(whole)]).dictionary_encode()
        return pa.array(self.recent.ids(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(pieces.indices)

    def _words(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        whole = b"\n".join([b"", *raw, b""]).lower()
        if whole.isspace():
            return [b""] * len(raw)
        plain, starts, of = word_starts(whole, np.cumsum([len(x) + 1 for x in raw]))
        return joined(self._known(plain, starts), of)

    def _spaces(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        ends = np.cumsum([len(x) for x in raw])
        whole = b"".join(raw)
        if not whole:
            return raw
        data = np.frombuffer(whole, np.uint8)
        starts = piece_starts(data, ends)
        of = np.searchsorted(starts, ends)  # pieces up to each text's end
        every = self._known(whole, starts)
        # Around line feeds in a row, and pieces that can't stand alone, the whole text decides.
        twice = np.flatnonzero((data[starts[:-1]] == LINE) & (data[starts[1:]] == LINE)) + 1
        twice = twice[~np.isin(twice, of)]
        open_ = np.flatnonzero(np.asarray(every.is_null())) if every.null_count else twice[:0]
        rest = np.unique(np.searchsorted(of, np.concatenate([twice, open_]), side="right")).tolist()
        out = joined(every, of)
        if rest:
            for i, x in zip(rest, self.slow.ids(bpe.slices([texts[i] for i in rest])), strict=True):
                out[i] = x
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as native (little-endian) unsigned integers of ``width`` bytes."""
        return self._words(texts) if self.kind == "words" else self._spaces(texts)


def joined(ids: pa.Array, of: np.ndarray) -> list[bytes]:
    """Ids of the pieces of each text; ``of``: pieces up to each text's end."""
    offsets = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1]
    data = memoryview(ids.buffers()[2])
    cut = offsets[of].tolist()
    return [bytes(data[a:b]) for a, b in zip([0, *cut], cut)]


def encoder(path: str, kind: str, width: int = 4) -> TextEncoder:
    return held(("encoder", path, kind, width), lambda: TextEncoder(path, kind, width))


def id_width(path: str, end_id: int) -> int:
    """Bytes that hold any id of a vocabulary file, and an end id."""
    ids = max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0)
    return 2 if max(ids, end_id) < 1 << 16 else 4
