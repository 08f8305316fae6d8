"""Raw frames to normalized ticks, quarantined frames and ignored frames."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteflow.functions.encoders import encode
from quoteflow.functions.formats import FORMATS, UNKNOWN_FORMAT, WireFormat, unreadable
from quoteflow.schemas import DECIMAL, FRAMES, STATUS_IGNORED, STATUS_PARSE_ERROR, STATUS_TICK, TICKS


# Starts the rearranged text of a frame that has its format's usual layout; no layout lets a frame
# itself start with it.
_MARK = "\x01"


@lru_cache(maxsize=16)
def _full_reading(application_id: str, formats: tuple[tuple[str, WireFormat], ...]) -> Column:
    """Every format's full reading as one column; large, so built once per application."""
    fmt, raw = F.col("_format"), F.col("raw")
    full = F.when(fmt.isNull() | ~fmt.isin(*[name for name, _ in formats]), unreadable(UNKNOWN_FORMAT))
    for name, wire in formats:
        full = full.when(fmt == name, wire.read(raw))
    return full


def classify(frames: DataFrame, formats: dict[str, WireFormat] | None = None) -> DataFrame:
    """Parse every frame with its source's format and say what became of it.

    Narrow and shuffle-free, so it works the same on batch and streaming frames. A frame without a
    registered format, such as one of a source that is not in the registry, is malformed for that reason
    and does not stop the others.
    """
    formats = FORMATS if formats is None else formats
    base = [F.col(f.name) for f in FRAMES.fields]
    fmt, raw = F.col("_format"), F.col("raw")

    # Frames in the usual layout: price|volume|time|ticker out of one match.
    arranged = F.lit(None).cast("string")
    for name, wire in formats.items():
        if wire.layout is not None:
            order = "|".join(f"${group}" for group in wire.layout.groups)
            matched = F.regexp_replace(raw, wire.layout.pattern, _MARK + order)
            arranged = F.when(fmt == name, matched).otherwise(arranged)
    usual = F.col("_arranged").startswith(_MARK) & ~raw.startswith(_MARK)
    df = (
        frames.select(*base, F.upper("format").alias("_format"))
        .select(*base, fmt, arranged.alias("_arranged"))
        .select(*base, fmt, F.when(usual, F.split("_arranged", "[|]", 4)).alias("_parts"))
    )

    # All others: the format's own full reading.
    full = _full_reading(frames.sparkSession.sparkContext.applicationId, tuple(formats.items()))
    df = df.select(*base, fmt, "_parts", F.when(F.col("_parts").isNull(), full).alias("_read"))

    parts, read = F.col("_parts"), F.col("_read")
    time = F.lit(None).cast("struct<ts:timestamp,sub:tinyint>")
    for name, wire in formats.items():
        if wire.layout is not None:
            time = F.when(fmt == name, wire.layout.time(parts[2])).otherwise(time)
    df = df.select(*base, parts, read, F.when(parts.isNotNull(), time).alias("_time"))

    # In the usual layout only the time can still fail to be one, such as a thirteenth month.
    ts = F.when(parts.isNotNull(), F.col("_time.ts")).otherwise(read["ts"])
    ignored = F.coalesce(read["ignored"], F.lit(False))
    reason = F.when(parts.isNotNull() & F.col("_time.ts").isNull(), "bad_ts").otherwise(read["reason"])
    tick = ~ignored & reason.isNull()

    def number(index: int, field: str) -> Column:
        plain = F.substring(parts[index], 2, 2**31 - 1) if index == 0 else parts[index]
        return F.when(parts.isNotNull(), plain.cast(DECIMAL)).otherwise(read[field])

    outcome = F.struct(
        F.when(ignored, STATUS_IGNORED)
        .when(reason.isNotNull(), STATUS_PARSE_ERROR)
        .otherwise(STATUS_TICK)
        .alias("status"),
        F.when(tick, F.coalesce(parts[3], read["ticker"])).alias("ticker"),
        F.when(tick, number(0, "price")).alias("price"),
        F.when(tick, number(1, "volume")).alias("volume"),
        F.when(tick, ts).alias("ts"),
        F.when(tick, F.coalesce(F.col("_time.sub"), read["ts_sub_us"])).alias("ts_sub_us"),
        F.when(~ignored, reason).alias("reason"),
    )
    # Filters on the outcome must stay above it: pushed down, they would repeat the whole parse.
    # A generator stops them, and still lets those on source or arrival through.
    return df.select(*base, F.inline(F.array(outcome)))


def ticks(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("status") == STATUS_TICK).select(TICKS.fieldNames())


def quarantine(classified: DataFrame) -> DataFrame:
    """Malformed frames, whole, with the reason each was refused."""
    return classified.filter(F.col("status") == STATUS_PARSE_ERROR).select(
        "source", "format", "raw", "arrival_ts", "frame_seq", "reason"
    )


def ignored(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("status") == STATUS_IGNORED).select(FRAMES.fieldNames())


def encode_ticks(ticks_df: DataFrame) -> DataFrame:
    """Add ``raw``: each tick as wire text in the format named by its ``format`` column."""
    cols = ["ticker", "price", "volume", "ts", "ts_sub_us"]
    return ticks_df.withColumn("raw", encode(F.col("format"), *[F.col(c) for c in cols]))
