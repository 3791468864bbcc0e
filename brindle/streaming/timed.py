"""Stateful streams with timers, on transformWithState: events in order of event time, and what happens when none come.

Streams of event time hold events back until the watermark has passed them, then take them in
order of (ts, seq), so the order of arrival inside the watermark's delay changes nothing. Streams
of arrival time go by the clock of the machine: they fire although no event moves a watermark.
Their states vanish by themselves once they are of no use (time to live). Input: key, seq, ts.

Sessions need the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass`` as in ``PROVIDER``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from brindle.functions import constants as C

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(ts) -> int:
    """Microseconds of a timestamp as Python gets it (local time) or of a bigint, as it is."""
    return ts if isinstance(ts, int) else int(round(ts.timestamp() * 1e6))


def up_to_ms(t: int) -> int:
    return -(-t // 1000)


class InOrder(StatefulProcessor):
    """Gives ``take`` the events that the watermark has passed, in order, and ``quiet`` what time it is."""

    columns: str = ""  # of an event besides t and seq, as a schema
    state_schema: str = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", f"t bigint, seq bigint{', ' if self.columns else ''}{self.columns}")
        self.state = handle.getValueState("state", self.state_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = [c.split()[0] for c in self.columns.split(", ")] if self.columns else []
        got = [(r["t"], r["seq"], *(r[n] for n in names)) for r in rows]
        self.held.appendList(got)
        for ms in {up_to_ms(t) for t, *_ in got}:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        held = list(self.held.get()) if self.held.exists() else []
        due = sorted((tuple(e) for e in held if e[0] <= now), key=lambda e: (e[0], e[1]))
        if due:
            rest = [tuple(e) for e in held if e[0] > now]
            self.held.put(rest) if rest else self.held.clear()
        state = tuple(self.state.get()) if self.state.exists() else None
        out = []
        for e in due:
            state = self.take(key[0], e, state, out)
        before = state
        state = self.quiet(key[0], now, state, out)
        self.state.update(state) if state is not None else self.state.clear()
        if state is not None and (due or before != state):
            if (at := self.wakes(state)) is not None:
                self.handle.registerTimer(up_to_ms(at))
        return iter(out)

    def take(self, key, event: tuple, state: tuple | None, out: list) -> tuple | None:
        raise NotImplementedError

    def quiet(self, key, now: int, state: tuple | None, out: list) -> tuple | None:
        return state

    def wakes(self, state: tuple) -> int | None:
        """When ``quiet`` has to look again."""
        return None

    def close(self) -> None:
        pass


class _Idle(InOrder):
    state_schema = "t bigint, seq bigint"

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def take(self, key, event, state, out):
        if state is not None and event[0] - state[0] >= self.gap:
            out.append(Row(key=key, seq=state[1], stopped_at=state[0] + self.gap))
        return event[:2]

    def quiet(self, key, now, state, out):
        if state is not None and state[0] + self.gap <= now:
            out.append(Row(key=key, seq=state[1], stopped_at=state[0] + self.gap))
            return None
        return state

    def wakes(self, state):
        return state[0] + self.gap


class _Batches(InOrder):
    columns = "file string"
    state_schema = "first bigint, seq bigint, files array<string>"

    def __init__(self, span: int, files: int) -> None:
        self.span, self.files = span, files

    def fire(self, key, state, at, out):
        out.append(Row(key=key, seq=state[1], fired_at=at, n_files=len(state[2])))

    def take(self, key, event, state, out):
        state = self.quiet(key, event[0], state, out)
        t, seq, file = event
        first, _, files = state or (t, seq, [])
        state = (first, seq, list(files) if file in files else [*files, file])
        if len(state[2]) >= self.files:
            self.fire(key, state, t, out)
            return None
        return state

    def quiet(self, key, now, state, out):
        if state is not None and state[0] + self.span <= now:
            self.fire(key, state, state[0] + self.span, out)
            return None
        return state

    def wakes(self, state):
        return state[0] + self.span


class _AsOf(InOrder):
    columns = "searched boolean, results array<string>, tool string"
    state_schema = "seq bigint, results array<string>"

    def take(self, key, event, state, out):
        _, seq, searched, results, tool = event
        if searched:
            return seq, list(results or [])
        out.append(Row(project=key, seq=seq, search_seq=None if state is None else state[0], hit=state is not None and tool in state[1]))
        return state


def _marked(events: DataFrame, late: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return events.withColumn("ts", ts).withColumn("t", F.unix_micros(ts)).withWatermark("ts", late)


def _at(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, F.timestamp_micros(column).cast("timestamp_ntz"))


def idle_stops(events: DataFrame, seconds: float = 600, late: str = "10 seconds") -> DataFrame:
    """(key, seq, stopped_at) once a key has been unused for ``seconds``: the rows of the batch form."""
    got = _marked(events, late).groupBy("key").transformWithState(_Idle(int(seconds * 1e6)), "key bigint, seq bigint, stopped_at bigint", "append", "EventTime")
    return _at(got, "stopped_at")


def batches(events: DataFrame, seconds: float = C.BATCH_S, files: int = C.BATCH_FILES, late: str = "10 seconds") -> DataFrame:
    """(key, seq of the last edit, fired_at, n_files): so many files, or so long after the first edit, also when no other one comes."""
    got = _marked(events, late).groupBy("key").transformWithState(_Batches(int(seconds * 1e6), files), "key bigint, seq bigint, fired_at bigint, n_files int", "append", "EventTime")
    return _at(got, "fired_at")


def asof_selection(searches: DataFrame, selections: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Each selection (project, seq, ts, tool) with the last search (project, seq, ts, results) before it, whichever arrives first."""
    left = searches.select(F.col("project").alias("key"), "seq", "ts", F.lit(True).alias("searched"), "results", F.lit(None).cast("string").alias("tool"))
    right = selections.select(F.col("project").alias("key"), "seq", "ts", F.lit(False).alias("searched"), F.lit(None).cast("array<string>").alias("results"), "tool")
    return _marked(left.unionByName(right), late).groupBy("key").transformWithState(_AsOf(), "project bigint, seq bigint, search_seq bigint, hit boolean", "append", "EventTime")


class _Quiet(StatefulProcessor):
    """Arrival time: one timer a key, put off by every event; the state has a time to live."""

    def __init__(self, ms: int) -> None:
        self.ms = ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq bigint, due bigint, events bigint", ttlDurationMs=2 * self.ms + 60_000)

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        seqs = [r["seq"] for r in rows]
        old = self.last.get() if self.last.exists() else None
        if old is not None:
            self.handle.deleteTimer(old[1])
        due = timerValues.getCurrentProcessingTimeInMs() + self.ms
        self.handle.registerTimer(due)
        self.last.update((max(seqs), due, len(seqs) + (old[2] if old is not None else 0)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.last.get() if self.last.exists() else None
        if state is None:
            return iter(())
        self.last.clear()
        return iter([Row(key=key[0], seq=state[0], events=state[2])])

    def close(self) -> None:
        pass


def quiet(events: DataFrame, seconds: float = 600) -> DataFrame:
    """(key, seq of the last event, events) once nothing has arrived for a key for ``seconds`` of the clock."""
    return events.groupBy("key").transformWithState(_Quiet(int(seconds * 1000)), "key bigint, seq bigint, events bigint", "append", "ProcessingTime")


class _Newer(StatefulProcessor):
    """The state is the newest version given out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.given = handle.getValueState("given", "version bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        given = self.given.get()[0] if self.given.exists() else None
        best = max(((r["version"], r["body"]) for r in rows), key=lambda x: x[0])
        if given is not None and best[0] <= given:
            return iter(())
        self.given.update((best[0],))
        return iter([Row(project=key[0], id=key[1], version=best[0], body=best[1])])

    def close(self) -> None:
        pass


def newer_copies(requests: DataFrame, notes: DataFrame) -> DataFrame:
    """What each project that asks (stream of project) has to copy: notes (project, id, version, body) it has not got, or got older.

    ``notes`` is a table beside the stream; each micro-batch reads it as it then is, so a note that was
    written again goes out again with the project's next request, and no other does.
    """
    asked = requests.select("project").join(notes.where("version is not null"), "project")
    return asked.groupBy("project", "id").transformWithState(_Newer(), "project bigint, id string, version bigint, body string", "append", "None")
