"""Debounce, heat and idleness of projects as event-time timers of one stateful operator.

An event makes its project hot for a while; changes are flushed once no event has
come for ``quiet`` milliseconds, ``factor`` times that where the project was cold when
the last one came; a project without an event for ``idle`` is told of once.  Times
are those of the events: events wait in state until the watermark has passed them,
so they are taken in order however they arrive, and a deadline fires when the
watermark passes it.  ``temporal.activity_timers`` says the same of a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltstone.operators.temporal import COLD_FACTOR, HOT_MS, IDLE_MS, QUIET_MS

OUT = ["kind", "at", "n_events", "first_at"]


class Watch:
    """What a project remembers: its deadlines, the events not flushed, and when its last event was."""

    def __init__(self, quiet: int, factor: int, hot: int, idle: int, held: tuple | None = None):
        self.quiet, self.factor, self.hot, self.idle = quiet, factor, hot, idle
        # Deadlines (None: not set), and number and time of the first of the events that wait for a flush.
        self.flush_at, self.cold_at, self.idle_at, self.n, self.first = held or (None, None, None, 0, None)

    def state(self) -> tuple:
        return self.flush_at, self.cold_at, self.idle_at, self.n, self.first

    def deadline(self) -> int | None:
        return min((t for t in (self.flush_at, self.cold_at, self.idle_at) if t is not None), default=None)

    def fire(self, at: int) -> Iterator[tuple]:
        """What is due at a time."""
        if self.flush_at == at:
            yield "flush", at, self.n, self.first
            self.flush_at, self.n, self.first = None, 0, None
        if self.cold_at == at:
            yield "cold", at, None, None
            self.cold_at = None
        if self.idle_at == at:
            yield "idle", at, None, None
            self.idle_at = None

    def event(self, at: int) -> Iterator[tuple]:
        if self.cold_at is None:
            yield "hot", at, None, None
        self.flush_at = at + self.quiet * (1 if self.cold_at is not None else self.factor)
        self.cold_at, self.idle_at = at + self.hot, at + self.idle
        self.n, self.first = self.n + 1, at if self.first is None else self.first

    def advance(self, events: list[int], until: int) -> Iterator[tuple]:
        """Take the events (in order, those taken leave the list) and deadlines up to a time; a deadline comes before an event of its own time."""
        while True:
            due = self.deadline()
            if due is not None and due <= until and (not events or due <= events[0]):
                yield from self.fire(due)
            elif events and events[0] <= until:
                yield from self.event(events.pop(0))
            else:
                return


class _Timers(StatefulProcessor):
    def __init__(self, by: str, settings: tuple[int, int, int, int]):
        self.by, self.settings = by, settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.watch = handle.getValueState("watch", "flush_at long, cold_at long, idle_at long, n long, first long")
        self.waiting = handle.getListState("waiting", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        new = [int(t) for part in rows for t in part["at"]]
        if new:
            self.waiting.appendList([(t,) for t in new])
            for t in set(new):  # an event is taken when the watermark has passed it
                self.handle.registerTimer(t)
        yield pd.DataFrame(columns=[self.by, *OUT])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        until = timerValues.getCurrentWatermarkInMs()
        held = self.watch.get()
        watch = Watch(*self.settings, held=None if held is None else tuple(None if pd.isna(x) else int(x) for x in held))
        events = sorted(int(t) for (t,) in self.waiting.get())
        out = [(key[0], *row) for row in watch.advance(events, until)]
        if out or held is None:
            self.waiting.put([(t,) for t in events]) if events else self.waiting.clear()
            self.watch.update(watch.state())
            due = watch.deadline()
            if due is not None:
                self.handle.registerTimer(due)
        frame = pd.DataFrame(out, columns=[self.by, *OUT])
        yield frame.astype({"at": "Int64", "n_events": "Int64", "first_at": "Int64"})

    def close(self) -> None:
        pass


def activity(events: DataFrame, by: str, time: str = "ts", lateness: str = "10 minutes", quiet: int = QUIET_MS, factor: int = COLD_FACTOR, hot: int = HOT_MS, idle: int = IDLE_MS) -> DataFrame:
    """group, kind (hot, cold, flush, idle), at, n_events, first_at (milliseconds) of a stream of events.

    The session's state store must be the RocksDB one, which keeps timers.
    """
    rows = events.select(F.col(by), F.col(time).cast("timestamp").alias("__t")).withWatermark("__t", lateness).withColumn("at", F.unix_millis("__t"))
    kind = events.schema[by].dataType.simpleString()
    return rows.groupBy(by).transformWithStateInPandas(_Timers(by, (quiet, factor, hot, idle)), f"{by} {kind}, kind string, at long, n_events long, first_at long", "append", "EventTime")
