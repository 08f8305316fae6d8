"""Table schemas and the column lists that give a tick its identity."""

from __future__ import annotations

from pyspark.sql import types as T

DECIMAL = T.DecimalType(38, 18)

SOURCES = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("format", T.StringType()),
    ]
)

# Raw wire text as it was landed. ``arrival_ts`` and ``frame_seq`` are recorded with the data so
# that "when" and "first" mean the same thing on every replay.
FRAMES = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("arrival_ts", T.TimestampType()),
        T.StructField("frame_seq", T.LongType()),
    ]
)

# One normalized frame, whatever became of it.
CLASSIFIED = T.StructType(
    FRAMES.fields
    + [
        T.StructField("status", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("price", DECIMAL),
        T.StructField("volume", DECIMAL),
        T.StructField("ts", T.TimestampType()),
        T.StructField("ts_sub_us", T.ByteType()),
        T.StructField("reason", T.StringType()),
    ]
)

TICKS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("price", DECIMAL),
        T.StructField("volume", DECIMAL),
        T.StructField("ts", T.TimestampType()),
        T.StructField("ts_sub_us", T.ByteType()),
        T.StructField("arrival_ts", T.TimestampType()),
        T.StructField("frame_seq", T.LongType()),
    ]
)

# The table operators query: five required columns, no key constraint.
STORE_COLUMNS = ["source", "ticker", "price", "volume", "ts"]

STORE = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("ticker", T.StringType(), False),
        T.StructField("price", DECIMAL, False),
        T.StructField("volume", DECIMAL, False),
        T.StructField("ts", T.TimestampType(), False),
    ]
)

# Physical layout of the store: pruned by event day; a batch's attempts lie side by side.
STORE_PARTITIONS = ["event_date", "batch_id", "attempt"]
STORE_LAYOUT = T.StructType(
    STORE.fields
    + [
        T.StructField("event_date", T.DateType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("attempt", T.StringType()),
    ]
)

# Two ticks are the same quote only if all of these match. The source is part of it, so one quote
# seen on two exchanges is two observations; price and volume are part of it, so two quotes in the
# same instant both survive. ``ts_sub_us`` carries the seventh fractional digit of a second.
KEY = ["source", "ticker", "price", "volume", "ts", "ts_sub_us"]

STATUS_TICK = "tick"
STATUS_IGNORED = "ignored"
STATUS_PARSE_ERROR = "parse_error"

METRICS = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("received", T.LongType()),
        T.StructField("parse_errors", T.LongType()),
        T.StructField("ignored", T.LongType()),
        T.StructField("late_dropped", T.LongType()),
        T.StructField("deduplicated", T.LongType()),
        T.StructField("written", T.LongType()),
        T.StructField("dropped", T.LongType()),
        T.StructField("tracked_keys", T.LongType()),
        T.StructField("outbound_count", T.LongType()),
        T.StructField("outbound_capacity", T.LongType()),
        T.StructField("connections_up", T.LongType()),
        T.StructField("source_count", T.LongType()),
    ]
)
