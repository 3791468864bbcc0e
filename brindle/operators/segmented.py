"""Folds over the ordered rows of each key, also where one key has any share of all rows.

A machine goes through a key's rows with a state. Keys of up to ``CHUNK`` rows are run whole, many a
task. A longer key is cut into chunks of ``CHUNK`` rows in its order: a first pass turns each chunk into the
function from the state before it to the state after it, the driver composes these functions, one
chunk at a time, and a second pass runs the chunks from their states, all in parallel.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from brindle.operators.ordered import changes, ordered
from brindle.session import spill

#: Rows of a key up to which one task runs it whole.
CHUNK = 1 << 20


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (rows of one key are neighbours) and where each group starts; last, the end."""
    held: list[pa.RecordBatch] = []
    before = None
    for b in batches:
        if not b.num_rows:
            continue
        new = np.flatnonzero(changes(b, key, before))
        before = tuple(b[c][b.num_rows - 1].as_py() for c in key)
        if len(new) and (held or new[-1]):
            cut = int(new[-1])
            yield _starts(pa.Table.from_batches([*held, *([b.slice(0, cut)] if cut else [])]), key)
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield _starts(pa.Table.from_batches(held), key)


def _starts(t: pa.Table, key: list[str]) -> tuple[pa.Table, np.ndarray]:
    whole = t.combine_chunks()
    return whole, np.append(np.flatnonzero(changes(whole.to_batches()[0], key, None)), whole.num_rows)


def settle(following: np.ndarray) -> np.ndarray:
    """Where each index ends up by going on to ``following``; an index whose following one lies beyond is an end."""
    n = len(following)
    at = np.where(following >= n, np.arange(n), following)
    while True:
        further = at[at]
        if np.array_equal(further, at):
            return at
        at = further


class Throttle:
    """Takes a row so many microseconds (or, if strict, more) after the last one taken; the state is that one's time."""

    fresh = None
    added: list[str] = []

    def __init__(self, micros: int, strict: bool = False) -> None:
        self.micros, self.strict = micros, strict

    def run(self, t: list, _: list | None, a: int, b: int, state: int | None) -> Iterator[tuple]:
        find = bisect_right if self.strict else bisect_left
        i = a if state is None else find(t, state + self.micros, a, b)
        while i < b:
            yield i, ()
            i = find(t, t[i] + self.micros, i + 1, b)

    def summary(self, t: list, _: list | None) -> tuple:
        """Times at which the first row taken changes the last one taken, and that one's time."""
        t = np.array(t, np.int64)
        last = t[settle(np.searchsorted(t, t + self.micros, "right" if self.strict else "left"))] if self.micros > 0 or self.strict else np.full(len(t), t[-1])
        edge = np.flatnonzero(last[1:] != last[:-1])
        return t[np.append(edge, len(t) - 1)], last[np.append(edge, len(t) - 1)]

    def apply(self, summary: tuple, state: int | None) -> int:
        times, last = summary
        i = 0 if state is None else int(np.searchsorted(times, state + self.micros, "right" if self.strict else "left"))
        return int(last[i]) if i < len(last) else state


class Batch:
    """Fires on a row so many microseconds after a batch's first one, or when the batch has so many files; the state is the open batch."""

    fresh = None
    added = ["n_files int"]

    def __init__(self, micros: int, files: int) -> None:
        self.micros, self.files = micros, files

    def run(self, t: list, x: list, a: int, b: int, state: tuple | None) -> Iterator[tuple]:
        first, got = (None, set()) if state is None else (state[0], set(state[1]))
        for i in range(a, b):
            first = t[i] if first is None else first
            got.add(x[i])
            if t[i] - first >= self.micros or len(got) >= self.files:
                yield i, (len(got),)
                first, got = None, set()

    def _fires(self, t: np.ndarray, x: list) -> np.ndarray:
        """Where a batch that begins at each row fires (the number of rows: not here)."""
        n, k = len(t), self.files
        by_time = np.searchsorted(t, t + self.micros, "left")
        by_time = np.maximum(by_time, np.arange(n)) if self.micros > 0 else np.arange(n)
        by_files = np.full(n, n)
        window: dict = {}
        j = 0
        for i in range(n):
            while j < n and len(window) < k:
                window[x[j]] = window.get(x[j], 0) + 1
                j += 1
            if len(window) >= k:
                by_files[i] = j - 1
            window[x[i]] -= 1
            if not window[x[i]]:
                del window[x[i]]
        return np.minimum(by_time, by_files)

    def summary(self, t: list, x: list) -> tuple:
        """What decides where an open batch fires, and the state after each row at which it may."""
        n, times = len(t), np.array(t, np.int64)
        fires = self._fires(times, x)
        ends = settle(np.where(fires < n, fires + 1, n))
        seen: dict = {}
        for i, f in enumerate(x):
            if f not in seen:
                seen[f] = i
                if len(seen) >= self.files:
                    break
        head = min(int(np.searchsorted(times, times[0] + self.micros, "left")), max(seen.values()) if len(seen) >= self.files else n) + 2
        states: dict[int, tuple | None] = {}
        for e in set(ends[: head + 1].tolist()):
            states[e] = None if fires[e] < n else (t[e], tuple(sorted(set(x[e:]), key=lambda f: (f is not None, f))))
        return times[:head], list(seen.items()), ends[: head + 1], states, n

    def apply(self, summary: tuple, state: tuple | None) -> tuple | None:
        times, seen, ends, states, n = summary
        if state is None:
            return states[int(ends[0])]
        first, files = state
        at = int(np.searchsorted(times, first + self.micros, "left"))
        more = [i for f, i in seen if f not in files]
        need = self.files - len(files)
        at = min(at if at < len(times) else n, more[need - 1] if len(more) >= need else n)
        if at >= n:
            return first, tuple(sorted({*files, *(f for f, _ in seen)}, key=lambda f: (f is not None, f)))
        return None if at + 1 >= n else states[int(ends[at + 1])]


class Budget:
    """Takes rows that fit what is left of a budget; the state is what is used."""

    fresh = 0
    added: list[str] = []

    def __init__(self, most: int) -> None:
        self.most = most

    def run(self, t: list, _: list | None, a: int, b: int, state: int) -> Iterator[tuple]:
        for i in range(a, b):
            if state + t[i] <= self.most:
                state += t[i]
                yield i, ()

    def summary(self, t: list, _: list | None) -> np.ndarray:
        """What is used afterwards, for everything that may be used before (sizes are none or more)."""
        used = np.arange(self.most + 1)
        sizes = np.array(t, np.int64)
        sizes = sizes[(sizes > 0) & (sizes <= self.most)]
        least = np.minimum.accumulate(sizes[::-1])[::-1]
        for i, n in enumerate(sizes.tolist()):
            if used[0] + least[i] > self.most and (used + least[i] > self.most).all():
                break
            used = np.where(used + n <= self.most, used + n, used)
        return used

    def apply(self, summary: np.ndarray, state: int) -> int:
        return int(summary[state]) if state <= self.most else state


def _same(a: DataFrame, b: DataFrame, key: list[str]):
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in key])


def split(rows: DataFrame, key: list[str], chunk: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys of up to ``chunk`` rows, and those of the others (None: there are none)."""
    hot = spill(rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > (chunk or CHUNK)).select(*key), "hot-keys")
    if hot.isEmpty():
        return rows, None
    return rows.join(hot, _same(rows, hot, key), "left_anti"), rows.join(hot, _same(rows, hot, key), "left_semi")


def fold(rows: DataFrame, key: list[str], order: list[str], value: str, keep: list[str], machine, extra: str | None = None, chunk: int | None = None) -> DataFrame:
    """The rows that ``machine`` takes, with the columns ``keep`` and those that it adds.

    ``value`` (a bigint; null counts as 0) and, where the machine wants it, ``extra`` are what it sees of a row, in order of ``order``.
    """
    chunk = chunk or CHUNK
    rows = rows.select(*dict.fromkeys([*key, *order, value, *keep, *([extra] if extra else [])]))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + machine.added)
    arrow = to_arrow_schema(rows.select(*keep).schema)
    added = [c.split()[0] for c in machine.added]

    def taken(t: pa.Table, ranges: list[tuple[int, int, object]]) -> pa.RecordBatch:
        values = [v or 0 for v in t[value].to_pylist()]
        more = t[extra].to_pylist() if extra else None
        got = [hit for a, b, state in ranges for hit in machine.run(values, more, a, b, state)]
        index = pa.array([i for i, _ in got], pa.int64())
        cols = {c: t[c].take(index).combine_chunks().cast(arrow.field(c).type) for c in keep}
        return pa.RecordBatch.from_pydict(cols | {c: pa.array([g[k] for _, g in got], pa.int32()) for k, c in enumerate(added)})

    def run_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, key):
            yield taken(t, [(a, b, machine.fresh) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)])

    def whole(part: DataFrame) -> DataFrame:
        return part.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run_whole, schema)

    cold, hot = split(rows, key, chunk)
    cold = whole(cold)
    if hot is None:
        return cold
    numbered = ordered(hot, key, order).rows
    numbered = numbered.withColumn("chunk", F.floor(F.col("at") / chunk)).select(*rows.columns, "chunk", "at")
    by = [*key, "chunk"]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, by):
            values, more = [v or 0 for v in t[value].to_pylist()], t[extra].to_pylist() if extra else None
            ranges = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
            out = [pickle.dumps(machine.summary(values[a:b], more[a:b] if more else None)) for a, b in ranges]
            first = pa.array([a for a, _ in ranges], pa.int64())
            yield pa.RecordBatch.from_pydict({c: t[c].take(first).combine_chunks() for c in by} | {"summary": pa.array(out, pa.binary())})

    keys = ", ".join(f"`{k}` {kinds[k]}" for k in key)
    dealt = numbered.repartition(*by).sortWithinPartitions(*by, "at")
    functions = spill(dealt.mapInArrow(summarise, f"{keys}, chunk bigint, summary binary"), "chunks")
    enter, last, state = [], None, machine.fresh
    for r in functions.orderBy(*by).toLocalIterator():  # one chunk at a time
        own = tuple(r[k] for k in key)
        if own != last:
            last, state = own, machine.fresh
        enter.append((*own, r["chunk"], pickle.dumps(state)))
        state = machine.apply(pickle.loads(r["summary"]), state)
    # A chunk's state stands before its rows.
    states = rows.sparkSession.createDataFrame(enter, f"{keys}, chunk bigint, state binary").withColumn("at", F.lit(-1).cast("bigint"))
    both = numbered.unionByName(states, allowMissingColumns=True).repartition(*by).sortWithinPartitions(*by, "at")

    def run_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, by):
            yield taken(t, [(a + 1, b, pickle.loads(t["state"][a].as_py())) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)])

    return cold.unionByName(both.mapInArrow(run_chunks, schema))
