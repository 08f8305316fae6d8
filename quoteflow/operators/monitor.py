"""Counters, gauges and rates of the flow, as tables.

Everything here reduces the frames to small summaries first: per source and generation, per source
and time cell, or per interval. How many rows those have depends on the time covered and not on the
traffic, and only they are ever ordered by time within a source or a run.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.functions.numbers import safe_ratio
from quoteflow.operators import dedup
from quoteflow.operators.spans import carry
from quoteflow.schemas import KEY, METRICS, STATUS_IGNORED, STATUS_PARSE_ERROR, STATUS_TICK

OUTBOUND_CAPACITY = 10_000
GENERATIONS_IN_A_SPAN = 720
IDLE_TIMEOUT = timedelta(seconds=10)


# ---- counters ---------------------------------------------------------------------------------


def source_counters(classified: DataFrame) -> DataFrame:
    """Per source: frames received as ticks, refused, and ignored."""
    return classified.groupBy("source").agg(
        F.count_if(F.col("status") == STATUS_TICK).alias("received"),
        F.count_if(F.col("status") == STATUS_PARSE_ERROR).alias("parse_errors"),
        F.count_if(F.col("status") == STATUS_IGNORED).alias("ignored"),
    )


def flow_by_generation(classified: DataFrame, window: timedelta = dedup.DEFAULT_WINDOW) -> DataFrame:
    """Per source and generation, what became of every frame, in one pass over the frames.

    Frames that are not ticks have no key and so collapse to a row per source, status and
    generation on their way through the dedup.
    """
    decided = dedup.decisions(classified, window, ["status", *KEY])
    is_tick = F.col("status") == STATUS_TICK
    copies = lambda status: F.sum(F.when(F.col("status") == status, F.col("copies")).otherwise(0))
    accepted = F.count_if(is_tick & F.col("accepted"))
    return decided.groupBy("source", "gen").agg(
        copies(STATUS_TICK).alias("received"),
        copies(STATUS_PARSE_ERROR).alias("parse_errors"),
        copies(STATUS_IGNORED).alias("ignored"),
        accepted.alias("accepted"),
        (copies(STATUS_TICK) - accepted).alias("deduplicated"),
        F.max("last_arrival_ts").alias("last_arrival_ts"),
    )


def flow_by_source(flow: DataFrame) -> DataFrame:
    sums = ["received", "parse_errors", "ignored", "accepted", "deduplicated"]
    return flow.groupBy("source").agg(
        *[F.sum(c).alias(c) for c in sums], F.max("last_arrival_ts").alias("last_arrival_ts")
    )


# ---- snapshots --------------------------------------------------------------------------------


def metrics(
    flow: DataFrame,
    source_count: int,
    window: timedelta = dedup.DEFAULT_WINDOW,
    capacity: int = OUTBOUND_CAPACITY,
) -> DataFrame:
    """Cumulative snapshots of the whole flow, one at the end of every generation with traffic.

    ``flow`` has a row per source and generation. From ``jobs.flow`` it also has written, dropped, late and taken
    as the store query counted them, and ``outbound_count`` is what had landed and was not taken. From
    ``flow_by_generation`` alone there is no store: what is accepted stands for what is written, and for
    what waited for the store when the generation ended. ``connections_up`` counts the sources heard from.
    """
    live = "taken" in flow.columns
    if not live:
        none = F.lit(0).cast("bigint")
        flow = flow.withColumns({"written": F.col("accepted"), "dropped": none, "taken": none, "late_dropped": none})
    sums = ["received", "parse_errors", "ignored", "deduplicated", "written", "dropped", "taken", "late_dropped"]
    per_generation = flow.groupBy("gen").agg(
        F.sum("accepted").alias("accepted"),
        *[F.sum(c).alias(c) for c in sums],
        F.count(F.lit(1)).alias("connections_up"),
    )
    added = carry(
        dedup.tracked_keys(per_generation), [], F.floor(F.col("gen") / GENERATIONS_IN_A_SPAN), ["gen"],
        running={f"{c}_so_far": ("sum", c) for c in sums},
    )
    waiting = F.col("received_so_far") - F.col("taken_so_far") if live else F.col("accepted")
    return added.select(
        F.timestamp_millis((F.col("gen") + 1) * dedup.window_millis(window)).alias("ts"),
        F.col("received_so_far").alias("received"),
        F.col("parse_errors_so_far").alias("parse_errors"),
        F.col("ignored_so_far").alias("ignored"),
        F.col("late_dropped_so_far").alias("late_dropped"),
        F.col("deduplicated_so_far").alias("deduplicated"),
        F.col("written_so_far").alias("written"),
        F.col("dropped_so_far").alias("dropped"),
        "tracked_keys",
        waiting.alias("outbound_count"),
        F.lit(capacity).cast("bigint").alias("outbound_capacity"),
        "connections_up",
        F.lit(source_count).cast("bigint").alias("source_count"),
    ).select(METRICS.fieldNames())


def snapshot(metrics_df: DataFrame) -> DataFrame:
    """The latest snapshot as one row, with the derived fill."""
    names = METRICS.fieldNames()
    latest = F.max_by(F.struct(*names), "ts").alias("m")
    return metrics_df.agg(latest).select("m.*").withColumn("outbound_fill", fill())


def fill() -> Column:
    """Share of the outbound capacity in use; 0 if there is none."""
    return safe_ratio(F.col("outbound_count"), F.col("outbound_capacity"))


def received_rate(metrics_df: DataFrame, run: list[str] | None = None) -> DataFrame:
    """Add ``received_per_second`` since the previous snapshot of the run; 0 if no time passed.

    The first snapshot has nothing to compare with and has no rate.
    """
    before = {"_ts_before": "ts", "_received_before": "received"}
    known = carry(metrics_df, run or [], F.to_date("ts"), ["ts", "received"], lagged=before)
    seconds = (F.unix_micros("ts") - F.unix_micros("_ts_before")) / 1_000_000
    delta = F.col("received") - F.col("_received_before")
    rate = F.when(seconds > 0, delta / seconds).when(seconds <= 0, F.lit(0.0))
    return known.withColumn("received_per_second", rate).drop(*before)


# The line operators read once per interval.
_STATS_LINE = (
    "stats recv/s=%.0f recv=%d parse=%d dedup=%d written=%d dropped=%d fill=%.0f%% keys=%d conns=%d/%d"
)


def stats_line(rated: DataFrame) -> DataFrame:
    """``received_rate`` output as one text line per snapshot after the first."""
    return rated.filter(F.col("received_per_second").isNotNull()).select(
        "ts",
        F.format_string(
            _STATS_LINE,
            "received_per_second",
            "received",
            "parse_errors",
            "deduplicated",
            "written",
            "dropped",
            fill() * 100,
            "tracked_keys",
            "connections_up",
            "source_count",
        ).alias("line"),
    )


def high_water(metrics_df: DataFrame) -> DataFrame:
    """Add the most rows that waited for the store up to each snapshot."""
    return carry(metrics_df, [], F.to_date("ts"), ["ts"], running={"high_water": ("max", "outbound_count")})


def waiting(changes: DataFrame) -> DataFrame:
    """Add how many rows wait after each change, and the most that did so far; ``changes`` has ``at`` and ``change``."""
    order = ["at", "change"]
    level = carry(changes, [], F.to_date("at"), order, running={"waiting": ("sum", "change")})
    return carry(level, [], F.to_date("at"), order, running={"high_water": ("max", "waiting")})


def throughput(classified: DataFrame, interval: str = "1 second") -> DataFrame:
    """Per interval and source: ticks, malformed and ignored frames that arrived. Batch or streaming."""
    return (
        classified.groupBy(F.window("arrival_ts", interval).alias("w"), "source")
        .agg(
            F.count_if(F.col("status") == STATUS_TICK).alias("received"),
            F.count_if(F.col("status") == STATUS_PARSE_ERROR).alias("parse_errors"),
            F.count_if(F.col("status") == STATUS_IGNORED).alias("ignored"),
        )
        .select(F.col("w.start").alias("interval_start"), "source", "received", "parse_errors", "ignored")
    )


# ---- silence ----------------------------------------------------------------------------------


def _cells(frames: DataFrame, width: timedelta) -> DataFrame:
    """Per source and time cell: first and last arrival, and frames.

    Two arrivals in one cell are closer than ``width``, so silence longer than that lies between
    cells and the frames themselves never need ordering.
    """
    micros = int(width.total_seconds() * 1_000_000)
    if micros <= 0:
        raise ValueError(f"the timeout must be positive, not {width}")
    arrival = F.unix_micros("arrival_ts")
    return (
        frames.groupBy("source", F.floor((arrival - F.pmod(arrival, F.lit(micros))) / micros).alias("cell"))
        .agg(F.min("arrival_ts").alias("first"), F.max("arrival_ts").alias("last"), F.count(F.lit(1)).alias("frames"))
    )


def _silence(cells: DataFrame) -> DataFrame:
    """Cells with the arrival before each, a day's cells of a source at a time."""
    return carry(cells, ["source"], F.to_date("first"), ["cell"], lagged={"heard_before": "last"})


def _longer_than(width: timedelta) -> Column:
    micros = int(width.total_seconds() * 1_000_000)
    return F.unix_micros("first") - F.unix_micros("heard_before") > micros


def idle_gaps(frames: DataFrame, timeout: timedelta = IDLE_TIMEOUT) -> DataFrame:
    """Stretches longer than ``timeout`` in which a source sent nothing."""
    return (
        _silence(_cells(frames, timeout))
        .filter(_longer_than(timeout))
        .select("source", F.col("heard_before").alias("idle_from"), F.col("first").alias("idle_until"))
    )


def idle_alarms(frames: DataFrame, timeout: timedelta = IDLE_TIMEOUT, lateness: timedelta = IDLE_TIMEOUT) -> DataFrame:
    """A streaming row for each source that fell silent: since when, and the frames it sent before.

    It comes once the stream as a whole is ``timeout`` and ``lateness`` past the source's last frame, so
    other sources have to be heard. Frames are folded into sessions before and after the shuffle.
    """
    width = f"{int(timeout.total_seconds() * 1_000_000)} microseconds"
    late = f"{int(lateness.total_seconds() * 1_000_000)} microseconds"
    return (
        frames.select("source", "arrival_ts").withWatermark("arrival_ts", late)
        .groupBy("source", F.session_window("arrival_ts", width))
        .agg(F.max("arrival_ts").alias("idle_from"), F.count(F.lit(1)).alias("frames"))
        .select("source", "idle_from", "frames")
    )


def sessions(frames: DataFrame, timeout: timedelta = IDLE_TIMEOUT) -> DataFrame:
    """Stretches in which a source was never silent for longer than ``timeout``."""
    starts = F.when(F.col("heard_before").isNull() | _longer_than(timeout), F.col("cell"))
    begun = _silence(_cells(frames, timeout)).withColumn("_starts", starts)
    return (
        carry(begun, ["source"], F.to_date("first"), ["cell"], running={"_session": ("max", "_starts")})
        .groupBy("source", "_session")
        .agg(F.min("first").alias("session_start"), F.max("last").alias("session_end"), F.sum("frames").alias("frames"))
        .drop("_session")
    )


def live_sources(frames: DataFrame, timeout: timedelta = IDLE_TIMEOUT) -> DataFrame:
    """Per source, whether it was heard from within ``timeout`` of the last frame of any source."""
    micros = int(timeout.total_seconds() * 1_000_000)
    heard = frames.groupBy("source").agg(F.max("arrival_ts").alias("last_arrival_ts"))
    # one row per source from here on
    latest = F.max("last_arrival_ts").over(Window.partitionBy(F.lit("all")))
    quiet = F.unix_micros(latest) - F.unix_micros("last_arrival_ts")
    return heard.select("source", "last_arrival_ts", (quiet <= micros).alias("connected"))
