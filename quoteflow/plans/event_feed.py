"""Quote feeds derived from the ``events`` table.

Every event becomes one quote on one of three exchanges, sent in that exchange's wire format, plus
the disturbances a live feed shows: exact re-sends, heartbeats and malformed frames.

    source    exchange-a | -b | -c by event_id % 3, in format A | B | C
    ticker    EVENT_TYPE-<user_id % 10>
    price     value            volume    props.k + 1
    ts        event time, cut to the format's resolution: ms | us | s
    re-sends  event_id % 5 = 0: again after 30, 150 and 330 seconds
    heartbeat event_id % 11 = 0: one second later
    malformed event_id % 13 = 0: two seconds later, one of six kinds per format in turn
    frame_seq event_id * 10 + copy
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteflow.functions import strict_json, times
from quoteflow.functions.numbers import decimal_to_text
from quoteflow.operators.normalize import encode_ticks
from quoteflow.schemas import DECIMAL, FRAMES
from quoteflow.session import spread

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

EXCHANGES = [
    ("exchange-a", "feed://exchange-a", "A"),
    ("exchange-b", "feed://exchange-b", "B"),
    ("exchange-c", "feed://exchange-c", "C"),
]

RESEND_SECONDS = (30, 150, 330)
HEARTBEAT, MALFORMED = 4, 5  # copy numbers after the quote and its re-sends
KINDS_OF_MALFORMED = 6


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet"))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the pattern names just that entry, be it one file or a folder of them, which a plain path may not
    events = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parque[t]")
    return events.repartition(spark.sparkContext.defaultParallelism)  # as in spread; a stream's files are not known yet


def quotes(events: DataFrame) -> DataFrame:
    """One quote per event as its exchange means it, before encoding."""
    nth = F.col("event_id") % 3
    ts = F.col("ts").cast("timestamp")
    letter = F.when(nth == 0, "a").when(nth == 1, "b").otherwise("c")
    return events.select(
        "event_id",
        F.concat(F.lit("exchange-"), letter).alias("source"),
        F.upper(letter).alias("format"),
        F.concat(F.upper("event_type"), F.lit("-"), (F.col("user_id") % 10).cast("string")).alias("ticker"),
        F.col("value").cast("decimal(18,2)").cast(DECIMAL).alias("price"),
        (F.get_json_object("props", "$.k").cast("decimal(18,2)") + 1).cast(DECIMAL).alias("volume"),
        F.when(nth == 0, F.date_trunc("millisecond", ts))
        .when(nth == 1, ts)
        .otherwise(F.date_trunc("second", ts))
        .alias("ts"),
        F.lit(0).cast("tinyint").alias("ts_sub_us"),
        ts.alias("arrival_ts"),
    )


def _malformed(fmt: Column, kind: Column) -> Column:
    """Broken versions of the quote in its own format; ``MALFORMED_REASONS`` says how each fails."""
    ticker, price = strict_json.quote(F.col("ticker")), decimal_to_text(F.col("price"))
    volume, iso = decimal_to_text(F.col("volume")), times.to_iso(F.col("ts"))
    millis, seconds = F.unix_millis("ts").cast("string"), F.unix_seconds("ts").cast("string")

    def text(template: str, **parts: Column) -> Column:
        pieces = []
        for piece in template.replace("<", "\0<").replace(">", ">\0").split("\0"):
            pieces.append(parts[piece[1:-1]] if piece.startswith("<") else F.lit(piece))
        return F.concat(*pieces)

    fields = dict(t=ticker, n=F.col("ticker"), p=price, v=volume, ms=millis, s=seconds, iso=iso)
    texts = {
        "A": [
            '{"symbol":<t>,"size":<v>,"ts":<ms>}',
            '{"symbol":<t>,"price":[<p>],"size":<v>,"ts":<ms>}',
            '{"symbol":<t>,"price":<p>,"size":<v>,"ts":<ms>',
            '{"symbol":<t>,"price":<p>,"size":false,"ts":<ms>}',
            '{"symbol":<t>,"price":<p>,"size":<v>,"ts":<ms>7000000}',
            '{"symbol":<t>,"price":<p>,"size":3.0000000000000000000007,"ts":<ms>}',
        ],
        "B": [
            '{"s":<t>,"p":"<p>","t":"<iso>"}',
            '{"s":<t>,"p":"<p> per lot","v":"<v>","t":"<iso>"}',
            '"s":<t>,"p":"<p>","v":"<v>","t":"<iso>"',
            '{"s":<t>,"p":"<p>","v":{"lots":"<v>"},"t":"<iso>"}',
            '{"s":<t>,"p":"<p>","v":"<v>","t":"day <iso>"}',
            '{"s":<t>,"p":"<p>","v":"<v>E1","t":"<iso>"}',
        ],
        "C": [
            "<n>;<p>;<v>;<s>",
            "<n>|$<p>|<v>|<s>",
            "<n>|<p>|<v>|<s>|<s>",
            "<n>|<p>|-|<s>",
            "<n>|<p>|<v>|<s>s",
            "<n>|<p>|<v>|<s>7000000",
        ],
    }
    chosen = None
    for name, templates in texts.items():
        of_kind = F.element_at(F.array(*[text(x, **fields) for x in templates]), kind + 1)
        chosen = F.when(fmt == name, of_kind) if chosen is None else chosen.when(fmt == name, of_kind)
    return chosen


# The reason each kind of malformed frame is refused for.
MALFORMED_REASONS = {
    "A": ["missing_price", "bad_price", "invalid_json", "bad_volume", "ts_out_of_range", "decimal_out_of_range"],
    "B": ["missing_volume", "bad_price", "invalid_json", "bad_volume", "bad_ts", "bad_volume"],
    "C": ["field_count", "bad_price", "field_count", "bad_volume", "bad_ts", "ts_out_of_range"],
}


def frames(events: DataFrame) -> DataFrame:
    """All wire frames the events stand for, in one pass over the table."""
    event_id, fmt = F.col("event_id"), F.col("format")

    def copy(number: int, after_seconds: int, raw: Column) -> Column:
        return F.struct(
            F.lit(number).alias("copy"), F.lit(after_seconds).alias("after"), raw.alias("raw")
        )

    kind = (F.floor(event_id / 13) % KINDS_OF_MALFORMED).cast("int")
    heartbeat = F.when(fmt == "C", F.lit("   ")).otherwise(F.lit('{"alive":true}'))
    copies = F.array_compact(
        F.array(
            copy(0, 0, F.col("raw")),
            *[
                F.when(event_id % 5 == 0, copy(n, seconds, F.col("raw")))
                for n, seconds in enumerate(RESEND_SECONDS, start=1)
            ],
            F.when(event_id % 11 == 0, copy(HEARTBEAT, 1, heartbeat)),
            F.when(event_id % 13 == 0, copy(MALFORMED, 2, _malformed(fmt, kind))),
        )
    )
    return (
        encode_ticks(quotes(events))
        .select("event_id", "source", "format", "arrival_ts", F.explode(copies).alias("c"))
        .select(
            "source",
            "format",
            F.col("c.raw").alias("raw"),
            F.timestamp_micros(F.unix_micros("arrival_ts") + F.col("c.after") * 1_000_000).alias("arrival_ts"),
            (event_id * 10 + F.col("c.copy")).alias("frame_seq"),
        )
        .select(FRAMES.fieldNames())
    )
