"""Event extraction with hysteresis on an unbounded stream."""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schema import TRACK

EVENT_SCHEMA = "video_id string, target_id int, t_start double, t_end double, peak double, duration double"
STORE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW = np.dtype([("at_ms", "<i8"), ("row_ord", "<i8"), ("timestamp", "<f8"), ("score", "<f8")])
# State of a track without rows taken: see ``init``.
EMPTY = (None,) * 9


class HysteresisEvents(StatefulProcessor):
    """Per track: rows wait in slots of event time until the watermark has passed the slot,
    are then taken in time order and move a small state (current run, open event).

    Waiting rows are a map from slot to rows. A track has one timer: for its earliest waiting slot, or
    for the end of what is open when it has been silent for ``idle_ms``. It takes all slots that the
    watermark has passed, one after the other, and reads no other. Every call of the state is a
    message to the JVM: a slot costs two on the way in and two on the way out.
    """

    def __init__(self, hi: float, lo: float, min_duration: float, idle_ms: int, slot_ms: int):
        self.hi, self.lo, self.min_duration = hi, lo, min_duration
        self.idle_ms, self.slot_ms = idle_ms, slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long", "rows binary")
        self.state = handle.getValueState(
            "state", "run_start double, run_top double, t_start double, last double, peak double, "
                     "last_ms long, idle_at long, slot long, timer long")

    def _slot_end(self, at_ms: int) -> int:
        """First millisecond after the slot of ``at_ms``: no row of the slot arrives once the watermark is there."""
        return (at_ms // self.slot_ms + 1) * self.slot_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, first, added = self.state.get(), None, set()
        for frame in rows:
            scored = frame["scored"].to_numpy(dtype=bool)
            if not scored.any():
                continue
            packed = np.zeros(int(scored.sum()), ROW)
            for name in ROW.names:
                packed[name] = frame[name].to_numpy()[scored]
            slots = packed["at_ms"] // self.slot_ms
            order = np.argsort(slots, kind="stable")
            packed, slots = packed[order], slots[order]
            bounds = [0, *(np.flatnonzero(np.diff(slots)) + 1).tolist(), len(slots)]
            for low, high in zip(bounds, bounds[1:]):
                slot = int(slots[low])
                # A track without state has nothing waiting.
                known = self.waiting.getValue((slot,)) if state is not None or slot in added else None
                added.add(slot)
                self.waiting.updateValue((slot,), ((known[0] if known else b"") + packed[low:high].tobytes(),))
            first = int(slots[0]) if first is None else min(first, int(slots[0]))
        if first is not None:
            state = state or EMPTY
            at = (first + 1) * self.slot_ms
            if state[-1] is None or at < state[-1]:
                self._set_timer(state[-1], at)
                self.state.update((*state[:-1], at))
        return iter([])

    def _set_timer(self, old: int | None, new: int) -> None:
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        found = self._advance(at, timerValues.getCurrentWatermarkInMs())
        if found:
            yield pd.DataFrame(
                [(*key, b, e, p, e - b) for b, e, p in found],
                columns=["video_id", "target_id", "t_start", "t_end", "peak", "duration"])

    def _advance(self, at: int, passed: int) -> list[tuple[float, float, float]]:
        """Take the slots that the watermark has passed, end what is silent and set the next timer."""
        state = self.state.get()
        if state is None or state[-1] != at:
            return []
        found, state = [], state[:-1]
        slots = sorted(slot for slot, in self.waiting.keys())
        due = [slot for slot in slots if (slot + 1) * self.slot_ms <= passed]
        for slot in due:
            state = self._take(slot, state, found)
        later = slots[len(due):]
        t_start, last, peak, idle_at = state[2], state[3], state[4], state[6]
        if idle_at is not None and idle_at <= passed:
            if t_start is not None:
                found.append((t_start, last, peak))
            if not later:
                self.state.clear()
                return found
            state = (*EMPTY[:7], state[7])
            idle_at = None
        ends = [(slot + 1) * self.slot_ms for slot in later[:1]]
        timer = min(ends if idle_at is None else [*ends, idle_at])
        self.handle.registerTimer(timer)
        self.state.update((*state, timer))
        return found

    def _take(self, slot: int, state: tuple, found: list[tuple[float, float, float]]) -> tuple:
        """Move the state over the rows of one slot; events that end go to ``found``."""
        rows = np.frombuffer(self.waiting.getValue((slot,))[0], ROW)
        self.waiting.removeKey((slot,))
        run_start, run_top, t_start, last, peak, last_ms, _, seen = state
        if seen is not None and slot <= seen:
            raise ValueError("slots expired out of order")
        for at_ms, _, timestamp, score in rows[np.lexsort((rows["row_ord"], rows["at_ms"]))].tolist():
            silent = last_ms is not None and at_ms - last_ms > self.idle_ms
            last_ms = at_ms
            if silent or score < self.lo:
                if t_start is not None:
                    found.append((t_start, last, peak))
                run_start = run_top = t_start = last = peak = None
                if score < self.lo:
                    continue
            last = timestamp
            if score < self.hi:
                run_start = run_top = None
                continue
            run_start = timestamp if run_start is None else run_start
            run_top = score if run_top is None else _greater(run_top, score)
            if timestamp - run_start >= self.min_duration:
                t_start = run_start if t_start is None else t_start
                peak = run_top if peak is None else _greater(peak, run_top)
        # One past a slot end: a slot that ends with the silence is taken before.
        return run_start, run_top, t_start, last, peak, last_ms, self._slot_end(last_ms + self.idle_ms) + 1, slot

    def close(self) -> None:
        pass


def _greater(a: float, b: float) -> float:
    """The larger one; NaN is larger than all numbers, as in Spark."""
    return a if math.isnan(a) or a >= b else b


def stream_events(
    scored: DataFrame, hi: float, lo: float, min_duration: float, delay: str = "10 minutes",
    idle: float = 3600.0, slot: float = 60.0,
) -> DataFrame:
    """Stream form of ``extract_events(..., idle=idle, clock=<seconds of event_time>)``.

    ``scored`` is a stream with ``event_time``, track keys, ``timestamp``, ``row_ord`` and
    ``score``; rows of a track are ordered by (event_time in ms, row_ord), which is to agree
    with (timestamp, row_ord). An event is emitted when a score below ``lo`` ends it, or once
    the watermark shows that its track has been silent for ``idle`` seconds; then the track's
    state is dropped too. Rows wait for the watermark to pass their ``slot`` of so many seconds;
    a task holds one slot of one track at a time.

    Rows without a score and rows with a null event time take no part. A peak of NaN comes out as null. Rows later than the
    watermark are dropped by Spark. At the end of a finite input the events that are still open
    come out when a row without score (a tick) moves the watermark past idle time and delay.
    The session needs the RocksDB state store provider (``STORE_PROVIDER``).
    """
    if hi < lo:
        raise ValueError("hi must not be below lo")
    slot_ms = max(2, round(slot * 1000))
    return (
        scored.withWatermark("event_time", delay)
        .where(F.col("event_time").isNotNull())
        .withColumns({"at_ms": F.unix_millis("event_time"), "scored": F.col("score").isNotNull()})
        .groupBy(*TRACK)
        .transformWithStateInPandas(
            statefulProcessor=HysteresisEvents(hi, lo, min_duration, round(idle * 1000), slot_ms),
            outputStructType=EVENT_SCHEMA,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def tick(latest: datetime, delay: timedelta, idle: float, slot: float) -> datetime:
    """An event time that moves the watermark past all timers of rows up to ``latest``."""
    return latest + delay + timedelta(seconds=idle + 3 * slot + 1)
