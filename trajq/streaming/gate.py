"""The sync gate over recordings that arrive in pieces."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from trajq.plans.lineage import checkpoint

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NS_PER_MS = 1_000_000
#: Samples that are taken from state at once.
CHUNK = 100_000


class Assembler(StatefulProcessor):
    """Holds the pieces of a recording until it is complete or overdue, then gives them out once."""

    def __init__(self, streams: Sequence[str], idle_ms: int, remember_ms: int):
        self.streams, self.idle_ms, self.remember_ms = frozenset(streams), idle_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "stream string, sample_idx array<bigint>, t_ns array<bigint>")
        self.status = handle.getValueState("status", "ended array<string>, closed boolean, newest bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        ended, closed, newest = self.status.get() if self.status.exists() else ([], False, None)
        ended, whole = set(ended), False
        for pdf in rows:
            top = int(pdf["t_ns"].max()) // NS_PER_MS
            newest = top if newest is None else max(newest, top)
            if closed:
                continue  # a piece of a recording that was judged
            marks = pdf[pdf["last"].astype(bool)]["stream"]
            whole |= bool(marks.isna().any())
            ended |= set(marks.dropna())
            for stream, g in pdf[pdf["stream"].notna()].groupby("stream", sort=True):
                g = g[g["sample_idx"].notna()]
                for at in range(0, len(g), CHUNK):
                    part = g.iloc[at : at + CHUNK]
                    self.pieces.appendValue((stream, part["sample_idx"].astype("int64").tolist(), part["t_ns"].astype("int64").tolist()))
        if not closed and (whole or ended >= self.streams):
            yield from self.given(key, True)
            closed = True
        self.status.update((sorted(ended), closed, newest))
        self.rearm(newest + (self.remember_ms if closed else self.idle_ms), timerValues)

    def given(self, key: Any, complete: bool) -> Iterator[pd.DataFrame]:
        for stream, index, t in self.pieces.get():
            yield pd.DataFrame({"recording_id": key[0], "stream": stream, "sample_idx": list(index), "t_ns": list(t), "complete": complete})
        self.pieces.clear()

    def rearm(self, at: int, timerValues: Any, fired: int | None = None) -> None:
        for old in list(self.handle.listTimers()):
            if old != fired:
                self.handle.deleteTimer(old)
        self.handle.registerTimer(max(at, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        ended, closed, newest = self.status.get()
        if closed:
            self.status.clear()
            return
        yield from self.given(key, False)
        self.status.update((ended, True, newest))
        self.rearm(newest + self.remember_ms, timerValues, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def assembled(samples: DataFrame, streams: Sequence[str], *, idle_ms: int = 3_600_000, remember_ms: int | None = None, delay_ms: int = 600_000, key: str = "recording_id") -> DataFrame:
    """The samples of each recording, all at once, when it has arrived.

    ``samples``: the key (any order, any number of files), stream, sample_idx, t_ns (epoch time), last. A stream is over with
    its row of ``last`` = true, which follows its other rows (a row without sample_idx only marks), a recording with all ``streams``, or with a row
    of ``last`` without stream: nothing more comes. One of which nothing came while the stream went ``idle_ms`` (plus
    the watermark's ``delay_ms``) on is given out as it is, ``complete`` = false. A recording is given out once: what
    arrives of it later, within ``remember_ms``, is ignored. State is the samples of open recordings and a
    flag for each closed one, gone after ``remember_ms``; a recording's samples leave in chunks.
    """
    rows = samples.select(F.col(key).alias("recording_id"), "stream", "sample_idx", "t_ns", F.coalesce("last", F.lit(False)).alias("last"))
    rows = rows.withColumn("at", F.timestamp_micros(F.expr("t_ns div 1000"))).withWatermark("at", f"{delay_ms} milliseconds")
    kind = rows.schema["recording_id"].dataType.simpleString()
    out = rows.groupBy("recording_id").transformWithStateInPandas(
        statefulProcessor=Assembler(streams, idle_ms, remember_ms if remember_ms is not None else 24 * idle_ms),
        outputStructType=f"recording_id {kind}, stream string, sample_idx bigint, t_ns bigint, complete boolean", outputMode="Append", timeMode="EventTime")
    return out.withColumnRenamed("recording_id", key)


def stream_gate(arrived: DataFrame, gate: Callable[[DataFrame], DataFrame], results: str) -> DataStreamWriter:
    """Judge the recordings of each micro-batch and append the results (parquet at ``results``).

    ``arrived`` holds whole recordings, each once (``assembled``, or a source whose files do). A micro-batch of a query writes its own
    folder, replaced when the batch is repeated, so a restart neither loses nor doubles a row, and no batch
    reads the results so far. The query's id is part of the folder, so a query with a new checkpoint,
    whose batches count from 0 again, leaves earlier results alone.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "query"
        rows = checkpoint(batch)  # the gate reads it more than once
        if not rows.isEmpty():
            gate(rows).write.mode("overwrite").parquet(f"{results}/query={query}/batch_id={batch_id}")

    return arrived.writeStream.foreachBatch(run)
