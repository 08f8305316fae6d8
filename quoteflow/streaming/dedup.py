"""Streaming deduplication.

``exact`` follows the generation rule of ``operators.dedup``, gives the same decisions on ticks that
arrive in order, and drops none for its age. ``within_watermark`` is the JVM-only operator: cheaper, and
it remembers a key for at least the retention, with eviction trailing behind by a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quoteflow.operators import dedup
from quoteflow.schemas import KEY, TICKS
from quoteflow.streaming.combine import combine

# What each policy says of a tick. ``copies`` counts what was offered, whichever row it is said in.
DECISIONS = T.StructType(
    [TICKS[c] for c in KEY]
    + [
        T.StructField("gen", T.LongType()),
        T.StructField("arrival_ts", T.TimestampType()),
        T.StructField("frame_seq", T.LongType()),
        T.StructField("copies", T.LongType()),
        T.StructField("accepted", T.BooleanType()),
    ]
)

_Decision = Row(*DECISIONS.fieldNames())

# Decisions as they leave the state operator, which builds no decimals, instants or other objects for each row.
_PLAIN = ("price", "volume", "ts", "ts_sub_us")
_DECIDED = T.StructType(
    [T.StructField(f.name, T.StringType() if f.name in _PLAIN else T.LongType() if f.name == "arrival_ts" else f.dataType) for f in DECISIONS]
)
_ROWS_OUT = 50_000


# Keys are kept in this many groups unless a flow is started with another number. It is part of the state
# layout, so it stays the same for the life of a checkpoint, and it should be well above the number of
# shuffle partitions.
BUCKETS = 256


class GenerationRule(StatefulProcessor):
    """Remembers, per bucket, the keys accepted in each of the last ``keep`` generations.

    Each generation is a map state of its own. A micro-batch looks up and adds the keys that arrived and no others, so
    what it writes grows with the arrivals and not with what is remembered. A generation that falls behind is
    cleared as a whole, and its place is taken by a new one.

    No tick is turned away for its age. One that comes out of order is a re-send if its key was accepted
    in its own generation or a neighbouring one, before or after, as far as that is still remembered.
    """

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "gens array<bigint>")
        self.places = [handle.getMapState(f"place{i}", "key string", "seen boolean") for i in range(self.keep)]

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for row in self._decide(pd.DataFrame([r.asDict() for r in rows])).itertuples(index=False):
            yield _Decision(*row)

    def _decide(self, offered: pd.DataFrame) -> pd.DataFrame:
        """One row per generation and key, however many copies arrive, and whether it is accepted.

        A key's generations fall into stretches that begin after a gap, at one that is remembered, and after it. Inside
        a stretch every second one is accepted, starting with the first, unless it is remembered.
        """
        code = pd.factorize(offered["identity"], use_na_sentinel=False)[0]
        gen, copies = offered["gen"].to_numpy(np.int64), offered["copies"].to_numpy(np.int64)
        order = np.lexsort((offered["frame_seq"], offered["first_ts"], gen, code))
        code, gen = code[order], gen[order]
        starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (gen[1:] != gen[:-1])])
        copies = np.add.reduceat(copies[order], starts)
        code, gen, first = code[starts], gen[starts], offered.iloc[order[starts]]
        identity = first["identity"].to_numpy()

        state = self.held.get()
        before = list(state[0]) if state is not None else [None] * self.keep  # which generation is in which place
        held = list(before)
        known = [g for g in held if g is not None]
        newest = max([*known, int(gen.max())])
        remembered = np.zeros(len(gen), bool)
        for i in np.flatnonzero(np.isin(gen, [g + d for g in known for d in (-1, 0, 1)])):
            g = int(gen[i])
            remembered[i] = any(self._remembered(before, x, identity[i]) for x in (g, g - 1, g + 1))

        apart = np.r_[True, (code[1:] != code[:-1]) | (gen[1:] - gen[:-1] > 1) | remembered[:-1]] | remembered
        at = np.arange(len(gen))
        accepted = ((at - np.maximum.accumulate(np.where(apart, at, 0))) % 2 == 0) & ~remembered

        taken = np.flatnonzero(accepted & (gen > newest - self.keep))
        for i in taken[np.argsort(gen[taken], kind="stable")]:
            self._add(held, int(gen[i]), identity[i])
        for place, g in enumerate(held):
            if g is not None and g <= newest - self.keep:
                self.places[place].clear()
                held[place] = None
        if held != before:
            self.held.update((held,))
        out = first.assign(arrival_ts=first["first_ts"], copies=copies, accepted=accepted)
        return out[DECISIONS.fieldNames()]

    def close(self) -> None:
        pass

    def _remembered(self, held: list, gen: int, identity: str) -> bool:
        place = gen % self.keep
        return held[place] == gen and self.places[place].containsKey((identity,))

    def _add(self, held: list, gen: int, identity: str) -> None:
        # What the batch's ticks can meet was looked up before.
        place = gen % self.keep
        if held[place] != gen:
            if held[place] is not None:
                self.places[place].clear()
            held[place] = gen
        self.places[place].updateValue((identity,), (True,))


class GenerationRuleInFrames(GenerationRule):
    """The same over pandas frames; a row's numbers, times and decimals are plain numbers and text there."""

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        decided = self._decide(pd.concat(list(rows), ignore_index=True))
        for begin in range(0, len(decided), _ROWS_OUT):
            yield decided.iloc[begin : begin + _ROWS_OUT]


def _identity() -> Column:
    """The key as one text, different for different keys."""
    lengths = [F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)) for c in ("source", "ticker")]
    numbers = [F.col("price"), F.col("volume"), F.unix_micros("ts"), F.col("ts_sub_us")]
    return F.concat(*lengths, *[F.concat(F.lit("|"), n.cast("string")) for n in numbers])


def exact(
    ticks: DataFrame,
    window: timedelta = dedup.DEFAULT_WINDOW,
    lateness: timedelta | None = None,
    fold: bool = True,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Decisions as in ``operators.dedup.decisions``, as ticks stream in.

    ``lateness`` is how far behind the newest arrival a tick may be and still meet everything it would
    have met in order; the window by default. Later ones are judged by what is still remembered.
    """
    window_ms = dedup.window_millis(window)
    late_ms = dedup.window_millis(window if lateness is None else lateness)
    offered = (
        combine(ticks, window, fold)
        .withColumn("identity", _identity())
        .withColumn("bucket", F.pmod(F.xxhash64("identity"), F.lit(buckets)))
        .select(
            "bucket", "identity", "source", "ticker", F.col("price").cast("string"), F.col("volume").cast("string"),
            F.unix_micros("ts").cast("string").alias("ts"), F.col("ts_sub_us").cast("string"),
            "gen", F.unix_micros("first_ts").alias("first_ts"), "frame_seq", "copies",
        )
    )
    rule = GenerationRuleInFrames(2 + -(-late_ms // window_ms))
    instants = {"ts": F.timestamp_micros(F.col("ts").cast("bigint")), "arrival_ts": F.timestamp_micros("arrival_ts")}
    decided = offered.groupBy("bucket").transformWithStateInPandas(rule, _DECIDED, "Append", "None")
    return decided.select(*[instants.get(f.name, F.col(f.name).cast(f.dataType)).alias(f.name) for f in DECISIONS])


def within_watermark(
    ticks: DataFrame, retention: timedelta = 2 * dedup.DEFAULT_WINDOW, window: timedelta = dedup.DEFAULT_WINDOW
) -> DataFrame:
    """Decisions by the JVM's own operator: accepted ticks, none rejected. ``window`` is the grid of ``gen``.

    A key is accepted unless it arrived within ``retention`` before. All of it runs in the JVM. Re-sends
    show as the operator's dropped duplicates.

    The operator drops ticks that are ``retention`` or further behind the newest arrival. Ticks of the landed table
    know how far behind they landed; those are taken out before the operator would drop them and come out as rows
    that are ``late``. Every tick also gives a row that only counts it, so that the flow's counters are whole.
    """
    retention_ms = dedup.window_millis(retention)

    def rows(df: DataFrame, *, copies: int, accepted: bool = False, late: bool = False, known: bool = True) -> DataFrame:
        return df.select(
            *[F.col(c) if known or c == "source" else F.lit(None).cast(TICKS[c].dataType).alias(c) for c in KEY],
            dedup.generation(F.col("arrival_ts"), window).alias("gen"),
            "arrival_ts",
            "frame_seq",
            F.lit(copies).cast("bigint").alias("copies"),
            F.lit(accepted).alias("accepted"),
            *([F.lit(late).alias("late")] if landed else []),
        )

    def survivors(df: DataFrame) -> DataFrame:
        return df.withWatermark("arrival_ts", f"{retention_ms} milliseconds").dropDuplicatesWithinWatermark(KEY)

    landed = "heard" in ticks.columns
    if not landed:
        return rows(survivors(ticks), copies=1, accepted=True)
    # the watermark is in whole milliseconds, and what lies on it is dropped
    mark = F.timestamp_millis(F.unix_millis("heard") - retention_ms)
    late = F.coalesce(F.col("arrival_ts") <= mark, F.lit(False))
    out = rows(survivors(ticks.filter(~late).drop("heard")), copies=0, accepted=True)
    return out.unionByName(rows(ticks.filter(late), copies=0, late=True)).unionByName(rows(ticks, copies=1, known=False))
