"""Event operators on streams: a bounded buffer per run with expiry, windowed counts with late data, cooldown state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textaudit.functions.lexicons import EVENT_BUFFER

#: Seconds after which a completed run is forgotten.
RUN_TTL = 1800
COOLDOWN_OUT = "run_id string, event_id long, streak int, cooldown int"


class _Buffer(StatefulProcessor):
    """One run's buffer. kept: its events by seq; last: the last event of each chunk that the buffer holds; span: numbers of the run. A batch
    reads and writes the entries that it touches, not the buffer."""

    def __init__(self, most: int, ttl_ms: int):
        self.most, self.ttl_ms = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("kept", "seq long", "event_id long, chunk string")
        self.last = handle.getMapState("last", "chunk string", "seq long, round int, open boolean")
        self.span = handle.getValueState("span", "next long, head long, size int, completed boolean")

    def _drop(self, seq: int) -> None:
        chunk = self.kept.getValue((seq,))[1]
        self.kept.removeKey((seq,))
        if self.last.containsKey((chunk,)) and self.last.getValue((chunk,))[0] == seq:
            self.last.removeKey((chunk,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        events, cursors, latest = [], [], timerValues.getCurrentWatermarkInMs()
        for r in rows:
            latest = max(latest, int(r.ts.timestamp() * 1000))
            (cursors if r.is_request else events).append(r)
        seq, head, size, completed = self.span.get() if self.span.exists() else (1, 1, 0, False)
        for e in sorted(events, key=lambda r: r.event_id):
            chunk, was = e.chunk or "", None
            if self.last.containsKey((chunk,)):
                was = self.last.getValue((chunk,))
            if e.stream and was is not None and was[2] and was[1] == (e.round or 0):
                self.kept.removeKey((was[0],))
                size -= 1
            self.kept.updateValue((seq,), (e.event_id, chunk))
            self.last.updateValue((chunk,), (seq, e.round or 0, bool(e.stream and not e.done)))
            seq, size, completed = seq + 1, size + 1, bool(e.completed)
            while size > self.most or (size and not self.kept.containsKey((head,))):
                if self.kept.containsKey((head,)):
                    self._drop(head)
                    size -= 1
                head += 1
        if events:
            self.span.update((seq, head, size, completed))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if completed:
                self.handle.registerTimer(latest + self.ttl_ms)
            yield Row(run_id=key[0], kind="buffer", cursor=None, seq=head, event_id=None, size=size, next=seq)
        for r in cursors:
            yield from self._reply(key[0], r.cursor, seq, head, size)

    def _reply(self, run: str, cursor: int | None, seq: int, head: int, size: int) -> Iterator[Row]:
        if not size:
            return
        seen, kind = head - 1 if cursor is None else min(cursor, seq - 1), "event"
        if seen < head - 1:
            seen, kind = seq - 2, "snapshot"
        for k in range(seen + 1, seq):
            if self.kept.containsKey((k,)):
                yield Row(run_id=run, kind=kind, cursor=cursor, seq=k, event_id=self.kept.getValue((k,))[0], size=size, next=seq)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seq, head, size, completed = self.span.get() if self.span.exists() else (1, 1, 0, False)
        if completed:
            self.kept.clear(), self.last.clear(), self.span.clear()
            yield Row(run_id=key[0], kind="expired", cursor=None, seq=head, event_id=None, size=size, next=seq)

    def close(self) -> None:
        pass


RUN_OUT = "run_id string, kind string, cursor long, seq long, event_id long, size int, next long"


def run_buffers(events: DataFrame, most: int = EVENT_BUFFER, ttl_seconds: int = RUN_TTL, late: str = "30 minutes") -> DataFrame:
    """Buffers of runs with coalesced progress, answers to cursors, and expiry, as operators/events.coalesced_buffer and replies have them in batch.

    events: run_id string, event_id long, ts timestamp, chunk string, round int, stream boolean, done boolean, completed boolean, is_request boolean,
    cursor long. A request asks for what lies behind its cursor and is answered behind the events of its batch; it is told the last event alone (kind
    snapshot) where some of these are gone. Each batch with events gives a row of kind buffer: seq of the oldest, size, next seq. A run whose
    last event is completed is forgotten ttl_seconds of event time later (kind expired); its watermark is set here.
    Events of a run must come in the order of their ids from batch to batch. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass); state and offsets come back from the checkpoint after a restart.
    """
    marked = events.withWatermark("ts", late)
    return marked.groupBy("run_id").transformWithState(_Buffer(most, ttl_seconds * 1000), RUN_OUT, "append", "EventTime")


def failure_cooldown(events: DataFrame, step: int = 3, most: int = 60) -> DataFrame:
    """events (run_id, event_id, failed) -> each failure's streak and cooldown; a success resets the run's streak."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        out = []
        for e in pd.concat(list(batches)).sort_values("event_id").itertuples():
            streak = streak + 1 if e.failed else 0
            if streak:
                out.append((key[0], e.event_id, streak, min(most, step * streak)))
        state.update((streak,))
        yield pd.DataFrame(out, columns=["run_id", "event_id", "streak", "cooldown"])

    return events.groupBy("run_id").applyInPandasWithState(update, COOLDOWN_OUT, "streak int", "append", GroupStateTimeout.NoTimeout)


def rate_windows(events: DataFrame, window: str = "1 hour", slide: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """Sliding counts per run; events later than `late` are dropped, windows close with the watermark."""
    return events.withWatermark("ts", late).groupBy("run_id", F.window("ts", window, slide)).agg(F.count("*").alias("n"))
