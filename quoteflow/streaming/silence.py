"""Alarms for sources that fall silent, by the clock and not by what other sources send.

Each source has one timer, set anew with every batch that hears from it. When it runs out the source is silent, also if
all others are; the first frame after that says so again. Frames are folded to a row for each source and Arrow batch
before the shuffle, so a source that sends a third of all frames costs a few rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quoteflow.operators.monitor import IDLE_TIMEOUT

SILENT, HEARD = "silent", "heard"

EVENTS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("at", T.TimestampType()),  # the last frame before the silence, or the first after it
        T.StructField("frames", T.LongType()),  # since the source was last heard again
    ]
)

# Instants are microseconds while they go through state.
_Event = Row("source", "event", "at", "frames")
_EVENT, _FOLDED = "source string, event string, at long, frames long", "source string, first long, last long, frames long"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch]).group_by("source").aggregate(
                [("at", "min"), ("at", "max"), ("at", "count")]
            )
            columns = [table.column(c).combine_chunks() for c in ("source", "at_min", "at_max", "at_count")]
            yield pa.RecordBatch.from_arrays(columns, ["source", "first", "last", "frames"])


class SilenceRule(StatefulProcessor):
    """One timer for each source, and whether it has run out."""

    def __init__(self, timeout: timedelta) -> None:
        self.millis = int(timeout.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "last long, frames long, silent boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        folded = list(rows)  # a row for each Arrow batch of one micro-batch
        first, last = min(r.first for r in folded), max(r.last for r in folded)
        state = self.known.get()
        before, frames, silent = state if state is not None else (last, 0, False)
        if silent:
            yield _Event(key[0], HEARD, first, 0)
        self.known.update((max(before, last), frames + sum(r.frames for r in folded), False))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.millis)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        last, frames, _ = self.known.get()
        self.known.update((last, 0, True))
        yield _Event(key[0], SILENT, last, frames)

    def close(self) -> None:
        pass


def silence_events(frames: DataFrame, timeout: timedelta = IDLE_TIMEOUT) -> DataFrame:
    """A streaming row when a source has sent nothing for ``timeout`` by the clock, and one when it is heard again.

    Run it with a trigger that goes on, shorter than the timeout: batches without frames are what finds silence.
    """
    folded = frames.select("source", F.unix_micros("arrival_ts").alias("at")).mapInArrow(_fold, _FOLDED)
    events = folded.groupBy("source").transformWithState(SilenceRule(timeout), _EVENT, "Append", "ProcessingTime")
    return events.withColumn("at", F.timestamp_micros("at"))
