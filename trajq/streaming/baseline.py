"""Change against the first frame of a rollout, as frames arrive."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = "rollout string, t_ns bigint, delta array<double>, is_baseline boolean, late boolean"
NS_PER_MS = 1_000_000


class Baseline(StatefulProcessor):
    """Per rollout its baseline and newest frame; once it ended, for a while, when that was."""

    def __init__(self, idle_ms: int | None, delay_ms: int):
        self.idle_ms, self.delay_ms = idle_ms, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("baseline", "t_ns bigint, value array<double>, newest bigint")
        self.ended = handle.getValueState("ended", "t_ns bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() if self.idle_ms is not None else 0
        was = self.first.get(), self.ended.get()
        base, ended = self.swept(*was, watermark)  # rows come before the timers of a batch
        newest = base[2] if base else None
        t, reset, values = zip(*((r["t_ns"], r["reset"], r["value"]) for r in rows))
        t, reset, values = np.array(t, np.int64), np.array(reset, bool), np.array(values, dtype=float)
        order = np.lexsort((~reset, t))
        t, reset, values = t[order], reset[order], values[order]
        gone = t[:0]
        if ended is not None:
            after = t <= ended[0]
            gone = t[after & ~reset]
            t, reset, values = t[~after], reset[~after], values[~after]
        delta, fresh, late = values.copy(), np.zeros(len(t), bool), np.zeros(len(t), bool)
        resets = np.flatnonzero(reset)
        for a, b in zip([0, *(resets + 1)], [*resets, len(t)]):  # the frames between two resets
            if a > 0:
                base = None
            if a == b:
                continue
            if base is None:
                base, fresh[a] = (int(t[a]), values[a].tolist()), True
            delta[a:b] -= np.asarray(base[1])
            late[a:b] = t[a:b] < base[0]
        if len(t):
            newest = int(t[-1]) if newest is None else max(newest, int(t[-1]))
        first = None if base is None else (base[0], list(base[1]), newest)
        self.keep(was, self.swept(first, ended, watermark))
        out = ~reset
        for at in gone.tolist():
            yield Row(rollout=key[0], t_ns=at, delta=None, is_baseline=False, late=True)
        for at, d, f, old in zip(t[out].tolist(), delta[out].tolist(), fresh[out].tolist(), late[out].tolist()):
            yield Row(rollout=key[0], t_ns=at, delta=d, is_baseline=f, late=old)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        was = self.first.get(), self.ended.get()
        self.keep(was, self.swept(*was, timerValues.getCurrentWatermarkInMs()), expiredTimerInfo.getExpiryTimeInMs())
        return iter(())

    def swept(self, first: tuple | None, ended: tuple | None, watermark: int) -> tuple[tuple | None, tuple | None]:
        """Baseline and end without what is due at this watermark (0: none yet)."""
        if watermark and first is not None and first[2] // NS_PER_MS + self.idle_ms - self.delay_ms < watermark:  # the stream is ``idle`` ahead of it
            first, ended = None, (first[2],)
        if watermark and ended is not None and ended[0] // NS_PER_MS < watermark:  # nothing older than the watermark arrives
            ended = None
        return first, ended

    def timers(self, first: tuple | None, ended: tuple | None) -> set[int]:
        """When a kept state is due: after the watermark it was swept at, so its timers need not be listed."""
        if self.idle_ms is None:
            return set()
        due = [] if first is None else [first[2] // NS_PER_MS + self.idle_ms - self.delay_ms + 1]
        return {max(at, 1) for at in ([*due, ended[0] // NS_PER_MS + 1] if ended is not None else due)}

    def keep(self, was: tuple, now: tuple, fired: int | None = None) -> None:
        """Write what differs; each call to the state is a round trip."""
        for state, a, b in zip((self.first, self.ended), was, now):
            if b is None and a is not None:
                state.clear()
            elif b is not None and (a is None or tuple(a) != b):
                state.update(b)
        old, new = self.timers(*was), self.timers(*now)
        for at in old - new - {fired}:
            self.handle.deleteTimer(at)
        for at in new - old:
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def stream_baseline_delta(frames: DataFrame, *, idle_ms: int | None = None, delay_ms: int = 600_000) -> DataFrame:
    """Value minus the rollout's baseline: the first frame, until a ``reset`` row clears it.

    ``frames``: rollout string, t_ns, value, reset. Within one micro-batch rows are taken in time order, a
    reset before a frame of the same time. Rows older than the baseline are kept and flagged ``late``.

    With ``idle_ms`` the stream has a watermark ``delay_ms`` behind its newest frame, and a rollout ends
    once the stream is ``idle_ms`` ahead of its newest frame: its state goes, and a later frame starts a new
    baseline. What still arrives of an ended rollout is flagged ``late`` and has no delta, until the
    watermark passes its end; from then on nothing is kept of it, and what is older than the watermark Spark drops
    and counts (``numRowsDroppedByWatermark``). Timers run on event time, so ``availableNow`` ends. Without
    ``idle_ms`` one vector stays per rollout that was not reset. A task holds the rows of one rollout
    of one micro-batch, which the source bounds (``maxBytesPerTrigger``, ``maxOffsetsPerTrigger``).
    """
    rows = frames.select("rollout", "t_ns", "value", F.coalesce("reset", F.lit(False)).alias("reset"))
    if idle_ms is not None:
        rows = rows.withColumn("at", F.timestamp_micros(F.expr("t_ns div 1000"))).withWatermark("at", f"{delay_ms} milliseconds")
    return rows.groupBy("rollout").transformWithState(
        statefulProcessor=Baseline(idle_ms, delay_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="None" if idle_ms is None else "EventTime")
