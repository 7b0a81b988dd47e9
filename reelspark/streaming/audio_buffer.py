"""Synchronised, bounded audio buffers as keyed state.

Events of a stream: ``audio`` adds n uncommitted samples, ``sync`` commits them at a
period, ``error`` loses all, ``play`` starts playback at a video time, ``read`` takes n.
Samples can be read only after a sync (a commit point). A full buffer drops its oldest
samples. A sync whose period goes back or disagrees with the samples since the last
is a soft loss of synchronisation: what was committed goes, new samples stay. An error
clears everything. ``play`` is refused while audio starts later or has ended, else the
samples before the video time are trimmed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

CAPACITY = 8192
OUTPUT = "stream long, seq long, status string, committed long, fresh long, dropped long"
STATE = "committed long, fresh long, period long, playing boolean, synced boolean"


class Buffer:
    """The state of one stream: counts of committed and fresh samples, and the last sync's period."""

    def __init__(self, capacity: int = CAPACITY, state: tuple | None = None):
        self.capacity = capacity
        self.committed, self.fresh, self.period, self.playing, self.synced = state or (0, 0, 0, False, False)

    def state(self) -> tuple:
        return self.committed, self.fresh, self.period, self.playing, self.synced

    def step(self, kind: str, value: int) -> tuple[str, int]:
        """Apply an event; returns a status and the samples that it dropped."""
        if kind == "audio":
            if value > self.capacity:
                self.committed = self.fresh = 0
                self.playing = False
                return "overrun", value
            over = max(0, self.committed + self.fresh + value - self.capacity)
            old = min(over, self.committed)
            self.committed -= old
            self.fresh += value - (over - old)
            if over and self.playing:
                self.committed = self.fresh = 0
                self.playing = False
                return "hard_desync", over
            return "buffered", over
        if kind == "sync":
            lost = 0
            status = "committed"
            if self.playing and (value < self.period or value - self.period != self.fresh):
                lost, self.committed, self.playing = self.committed, 0, False
                status = "soft_desync"
            self.committed += self.fresh
            self.fresh, self.period, self.synced = 0, value, True
            return status, lost
        if kind == "error":
            lost = self.committed + self.fresh
            self.committed = self.fresh = 0
            self.playing = False
            return "hard_desync", lost
        if kind == "play":
            start = self.period - self.committed
            if not self.synced or value < start or value >= self.period:
                return "refused", 0
            self.committed -= value - start
            self.playing = True
            return "playing", value - start
        if kind == "read":
            taken = min(value, self.committed) if self.playing else 0
            self.committed -= taken
            return "read" if taken == value else "underrun", 0
        return "unknown", 0


def replay(events: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The same over a whole table: events (stream, seq, kind, value) of each stream in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        buf, rows = Buffer(capacity), []
        for r in pdf.sort_values("seq").itertuples():
            status, dropped = buf.step(r.kind, int(r.value))
            rows.append((r.stream, r.seq, status, buf.committed, buf.fresh, dropped))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return events.groupBy("stream").applyInPandas(run, OUTPUT)


def follow(events: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A streaming query's output for each event; state is five numbers a stream.

    Events of a stream are applied in the order of ``seq`` within a micro-batch.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        buf = Buffer(capacity, tuple(state.get) if state.exists else None)
        rows = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            status, dropped = buf.step(r.kind, int(r.value))
            rows.append((key[0], r.seq, status, buf.committed, buf.fresh, dropped))
        state.update(buf.state())
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return events.groupBy("stream").applyInPandasWithState(run, OUTPUT, STATE, "append", "NoTimeout")
