"""Words of whole texts as 64-bit hashes, found and hashed in numpy over raw bytes.

Words are runs of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text. A word's hash is
its polynomial value modulo 2**64, mixed with its length; hashes of word sequences are
built the same way from word hashes. Equal sequences always have equal hashes.
"""

from __future__ import annotations

from functools import cache

import numpy as np

BYTE_BASE, WORD_BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
MASK = (1 << 64) - 1

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Bytes of a text that are hashed at a time, and powers that a worker keeps.
BLOCK, KEPT = 1 << 18, 1 << 17


@cache
def _kept_powers(base: int, size: int) -> np.ndarray:
    return _new_powers(base, size)


def _new_powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    return _kept_powers(base, KEPT)[:n] if n <= KEPT else _new_powers(base, n)


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sum(b: np.ndarray) -> int:
    """The polynomial value of one long word, a block at a time."""
    total, step = 0, KEPT
    for k, at in enumerate(range(0, len(b), step)):
        part = int(((b[at : at + step].astype(np.uint64) + np.uint64(1)) * powers(BYTE_BASE, step)[: len(b) - at]).sum())
        total += part * pow(BYTE_BASE, k * step, 1 << 64)
    return total & MASK


def _block(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, stops and values of the words of a block that white space ends."""
    edge = np.diff((~WHITE[b]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(b)
    total = np.zeros(n + 1, np.uint64)
    step = KEPT
    for at in range(0, n, step):
        m = min(step, n - at)
        shift = np.uint64(pow(BYTE_BASE, at, 1 << 64))
        np.cumsum((b[at : at + m].astype(np.uint64) + np.uint64(1)) * (powers(BYTE_BASE, m) * shift), out=total[at + 1 : at + m + 1])
        total[at + 1 : at + m + 1] += total[at]
    back = powers(inverse(BYTE_BASE), step)[start % step]
    for k in range(1, -(-n // step)):
        back[start // step == k] *= np.uint64(pow(inverse(BYTE_BASE), k * step, 1 << 64))
    return start, stop, (total[stop] - total[start]) * back


class Words:
    """Words of several texts: hashes, byte ranges in ``data``, and each text's range of words.

    Bytes are worked on in blocks of ``BLOCK`` that end at white space, so that a long text
    takes some 24 bytes a word besides itself.
    """

    def __init__(self, texts: list[str], lower: bool = False) -> None:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"\n".join(raw) + b"\n"
        every = np.frombuffer(self.data, np.uint8)
        starts, stops, hashes = [], [], []
        at, n = 0, len(every)
        while at < n:
            end = min(at + BLOCK, n)
            if end < n and not (white := WHITE[every[at:end]]).any():
                # A word longer than a block.
                while not (white := WHITE[every[end : end + BLOCK]]).any():
                    end += BLOCK
                end += int(white.argmax())
                word = every[at:end]
                starts.append(np.array([at]))
                stops.append(np.array([end]))
                value = np.array([_sum(LOWER[word] if lower else word)], np.uint64)
            else:
                if end < n:
                    end = at + len(white) - int(white[::-1].argmax())
                b = every[at:end]
                start, stop, value = _block(LOWER[b] if lower else b)
                starts.append(start + at)
                stops.append(stop + at)
            hashes.append(mix(value + (stops[-1] - starts[-1]).astype(np.uint64) * np.uint64(OTHER_BASE)))
            at = end
        self.start, self.stop, self.hash = (np.concatenate(x) for x in (starts, stops, hashes))
        ends = np.cumsum([len(r) + 1 for r in raw])
        cut = np.searchsorted(self.start, ends)
        self.ranges = list(zip(np.concatenate([[0], cut[:-1]]).tolist(), cut.tolist(), strict=True)) if texts else []

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.stop[i]]


def runs(hashes: np.ndarray, width: int, base: int = WORD_BASE) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive words."""
    n = len(hashes)
    if n < width:
        return np.empty(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(base, n), out=total[1:])
    return mix((total[width:] - total[:-width]) * powers(inverse(base), n)[: n - width + 1])


def run_hash(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, base: int = WORD_BASE) -> np.ndarray:
    """Hashes of the runs [first, last), which may differ in length."""
    n = len(hashes)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(base, n), out=total[1:])
    return mix((total[last] - total[first]) * powers(inverse(base), n + 1)[first] + (last - first).astype(np.uint64) * np.uint64(OTHER_BASE))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x
