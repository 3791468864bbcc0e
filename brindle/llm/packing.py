"""Packing by Karmarkar-Karp multiway differencing into windows of a fixed capacity.

Every document is cut into whole windows and a rest; a rest is cut into equal pieces of at
most ``piece`` tokens (small ones at the end of a group). Pieces are gathered, as they come, into groups that fill about
``group`` windows. In a group each piece starts as a partial partition of the windows; the
two partial partitions with the largest imbalance are merged, largest sums of one with the
smallest of the other, until one is left: windows of nearly equal load. If a window exceeds
the capacity, the window count rises and the group is partitioned again.

Groups are made within tasks, so no data is shuffled and a task holds one group of piece
lengths, not token ids. Null texts count as empty: they hold the end id alone. Repeated
rows are packed each by itself. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import zlib
from operator import itemgetter

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from brindle.llm.common import chunks, map_rows, pick, texts_of
from brindle.llm.tokens import encoder

CAPACITY = 1024
#: Windows of a group, pieces' largest length, and tokens left free in a window on average.
GROUP, PIECE, SLACK = 32, 256, 7
#: The last tokens of a group come in small pieces, with which differencing evens out loads.
FINE_TOKENS, FINE_PIECE = 2048, 32
#: Characters of texts that are encoded together: the more, the fewer look-ups of one piece.
CHUNK = 2_000_000


def differencing(lengths: list[int], k: int) -> list[tuple[int, list[int]]]:
    """k windows as (load, indices of lengths), the most loaded first."""
    if not lengths:
        return [(0, [])] * k
    free = [(0, None)] * (k - 1)
    heap = [(-n, i, [(n, i), *free]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    load, count = itemgetter(0), len(lengths)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heap[0]
        both = [(x + y, v if u is None else u if v is None else (u, v)) for (x, u), (y, v) in zip(a, reversed(b), strict=True)]
        both.sort(key=load, reverse=True)
        count += 1
        heapq.heapreplace(heap, (both[-1][0] - both[0][0], count, both))
    out = []
    for n, tree in heap[0][2]:
        items, todo = [], [] if tree is None else [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                items.append(x)
        out.append((n, sorted(items)))
    return out


def windows(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Indices of lengths (each at most the capacity) by window; as few windows as fit."""
    k = max(1, -(-sum(lengths) // capacity)) if lengths else 0
    while True:
        got = differencing(lengths, k) if k else []
        if not got or got[0][0] <= capacity:
            return [items for _, items in got if items]
        k += 1


def cut(n: int, piece: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole windows, then the rest in equal pieces."""
    out = [capacity] * (n // capacity)
    if rest := n % capacity:
        parts = -(-rest // piece)
        out += [rest // parts + (i < rest % parts) for i in range(parts)]
    return out


def pack(docs: DataFrame, vocabulary: str, *, end_id: int, kind: str = "spaces", capacity: int = CAPACITY, group: int = GROUP, piece: int = PIECE, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    rows = pick(docs, id_col, text_col)
    kind_of_id = rows.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    target, end = group * (capacity - slack), np.array([end_id], "<u4").tobytes()

    def placed(items: list[tuple], base: int):
        """Rows of a group of pieces; items: (id, start, length, crc, doc_tokens, ids)."""
        out = []
        for k, window in enumerate(windows([x[2] for x in items], capacity)):
            offset = 0
            for i in window:
                x = items[i]
                out.append((*x[:5], base + k, offset, x[5]))
                offset += x[2]
        return out

    def run(batches):
        enc = encoder(vocabulary, kind)
        task = TaskContext.get()
        at = (task.partitionId() if task else 0) << 32
        held, total = [], 0
        for b in batches:
            ids, texts = b[id_col].to_pylist(), texts_of(b[text_col])
            for lo, hi in chunks([len(t) for t in texts], CHUNK):
                done = []
                for row_id, x in zip(ids[lo:hi], enc.encode(texts[lo:hi]), strict=True):
                    data, start = memoryview(x + end), 0
                    size = len(data) // 4
                    lengths = cut(size, piece, capacity)
                    while start < size:
                        n = lengths.pop(0)
                        whole = n == capacity
                        if not whole:
                            most = min(FINE_PIECE if total >= target - FINE_TOKENS else n, target - total)
                            if n > most:
                                lengths.insert(0, n - most)
                                n = most
                        part = data[4 * start : 4 * (start + n)]
                        row = (row_id, start, n, zlib.crc32(part), size, np.frombuffer(part, "<u4").astype(np.int64) if with_ids else None)
                        start += n
                        if whole:
                            done.append((*row[:5], at, 0, row[5]))
                            at += 1
                            continue
                        held.append(row)
                        total += n
                        if total >= target:
                            got = placed(held, at)
                            at = got[-1][5] + 1
                            done += got
                            held, total = [], 0
                if done:
                    yield {n: [r[i] for r in done] for i, n in enumerate(names)}
        if held:
            got = placed(held, at)
            yield {n: [r[i] for r in got] for i, n in enumerate(names)}

    schema = f"`{id_col}` {kind_of_id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<bigint>" * with_ids
    return map_rows(rows, schema, run, holds=True)
