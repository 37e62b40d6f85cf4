"""Compaction of a stream with timers: a key's buffered writes are flushed when it has been quiet, or at its deadline.

State lies in the state store (RocksDB), a key at a time; event time drives the
timers, so a rerun gives the same flushes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FLUSHED = "key string, first_seen_ms long, last_modified_ms long, writes long, last_seq long, reason string"
NAMES = [c.split()[0] for c in FLUSHED.split(", ")]


class Compactor(StatefulProcessor):
    """Counts a key's writes and keeps their bounds; one row out for each flush, one frame for all of a call."""

    def __init__(self, quiet_ms: int, cap_ms: int):
        self.quiet_ms, self.cap_ms = quiet_ms, cap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "first long, last long, n long, seq long")

    def _due(self, first: int, last: int) -> tuple[int, str]:
        quiet, cap = last + self.quiet_ms, first + self.cap_ms
        return (quiet, "quiet") if quiet <= cap else (cap, "deadline")

    @staticmethod
    def _rows(key, flushed: list[tuple]) -> Iterator[pd.DataFrame]:
        """One frame for all flushes of a call, as a frame costs far more than a row."""
        if flushed:
            yield pd.DataFrame([(key[0], *state, reason) for state, reason in flushed], columns=NAMES)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, flushed = self.pending.get() if self.pending.exists() else None, []
        writes = sorted(w for pdf in rows for w in zip(pdf["at_ms"].tolist(), pdf["seq"].tolist(), strict=True))
        for at, seq in writes:
            if state is not None:
                due, reason = self._due(state[0], state[1])
                if at >= due:  # a flush that fell due between two writes of one batch
                    flushed.append((tuple(state), reason))
                    state = None
            state = (at, at, 1, seq) if state is None else (state[0], at, state[2] + 1, max(seq, state[3]))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if state is not None:
            self.pending.update(tuple(state))
            self.handle.registerTimer(self._due(state[0], state[1])[0])
        else:
            self.pending.clear()
        yield from self._rows(key, flushed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.pending.exists():
            state = self.pending.get()
            due, reason = self._due(state[0], state[1])
            if due <= expiredTimerInfo.getExpiryTimeInMs():
                self.pending.clear()
                yield from self._rows(key, [(tuple(state), reason)])

    def close(self) -> None:
        pass


def compact_stream(writes: DataFrame, quiet_ms: int, cap_ms: int, late: str = "0 seconds") -> DataFrame:
    """Flushes (``FLUSHED``) of a stream ``key, seq, at_ms, ts`` with event time ``ts``; needs the RocksDB state store provider."""
    return (
        writes.withWatermark("ts", late).groupBy("key")
        .transformWithStateInPandas(Compactor(quiet_ms, cap_ms), FLUSHED, "Append", "EventTime")
    )
