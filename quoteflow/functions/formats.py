"""Wire formats as column functions of the raw text.

``read`` is the whole definition of a format: it decides for any text whether it is a tick, a frame
to ignore, or malformed, and why. ``layout`` is an optional shortcut for the text a well-behaved
producer sends. One regular expression recognizes such a frame and takes it apart; it matches
nothing that ``read`` would judge differently, and every other frame goes through ``read``.

To add a format, build a ``WireFormat`` and register it; nothing else changes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoteflow.functions import numbers, strict_json, times
from quoteflow.functions.binding import let

# Why a frame was refused. A field that is there but unusable is ``bad_<field>``, one
# that is not there ``missing_<field>``.
INVALID_JSON = "invalid_json"
FIELD_COUNT = "field_count"
UNKNOWN_FORMAT = "unknown_format"
DECIMAL_RANGE = "decimal_out_of_range"
TS_RANGE = "ts_out_of_range"


@dataclass(frozen=True)
class Layout:
    """The usual text of a format.

    ``pattern`` must match the whole frame and only values that convert: groups give the plain
    decimals, the time text and the ticker, in the order named by ``groups`` (price, volume, time,
    ticker). ``time`` turns the time text into ``struct(ts, sub)``.
    """

    pattern: str
    groups: tuple[int, int, int, int]
    time: Callable[[Column], Column]


@dataclass(frozen=True)
class WireFormat:
    id: str
    read: Callable[[Column], Column]  # raw text -> reading(...)
    layout: Layout | None = None


FORMATS: dict[str, WireFormat] = {}


def register_format(fmt: WireFormat) -> WireFormat:
    FORMATS[fmt.id.upper()] = fmt
    return fmt


def reading(
    *,
    ignored: Column,
    reason: Column,
    ticker: Column,
    price: Column,
    volume: Column,
    ts: Column,
    ts_sub_us: Column | None = None,
) -> Column:
    """What a format makes of a frame; ``price`` and ``volume`` are decimal text.

    ``ignored`` wins over ``reason``; a frame with neither is a tick if its numbers are exact. The
    number grammar and the exactness rule are the same for every format and are applied here.
    """
    sub = F.lit(0) if ts_sub_us is None else ts_sub_us
    texts = F.struct(
        ignored.alias("ignored"),
        reason.alias("reason"),
        ticker.alias("ticker"),
        numbers.number_text(price).alias("price"),
        numbers.number_text(volume).alias("volume"),
        ts.alias("ts"),
        sub.cast("tinyint").alias("ts_sub_us"),
    )
    return let(texts, _typed)


def unreadable(reason: str) -> Column:
    """The reading of a frame that no format could be asked about."""
    none = F.lit(None).cast("string")
    return reading(
        ignored=F.lit(False), reason=F.lit(reason), ticker=none, price=none, volume=none,
        ts=F.lit(None).cast("timestamp"),
    )


def _typed(t: Column) -> Column:
    price, volume = numbers.exact_decimal(t["price"]), numbers.exact_decimal(t["volume"])
    return F.struct(
        t["ignored"].alias("ignored"),
        F.coalesce(
            t["reason"],
            _first_failed(
                (t["price"].isNull(), "bad_price"),
                (t["volume"].isNull(), "bad_volume"),
                (t["ts"].isNull(), "bad_ts"),
                (price.isNull() | volume.isNull(), DECIMAL_RANGE),
            ),
        ).alias("reason"),
        t["ticker"].alias("ticker"),
        price.alias("price"),
        volume.alias("volume"),
        t["ts"].alias("ts"),
        t["ts_sub_us"].alias("ts_sub_us"),
    )


def _first_failed(*checks: tuple[Column, str]) -> Column:
    """The first check that holds names the reason; null if none does."""
    reason = None
    for failed, why in checks:
        reason = F.when(failed, why) if reason is None else reason.when(failed, why)
    return reason


def _members(raw: Column, names: dict[str, str], body: Callable[[Column], Column]) -> Column:
    """``body`` over the text and JSON type of the named members of the document's object."""

    def pick(parsed: Column) -> Column:
        members = {field: strict_json.member(parsed, name) for field, name in names.items()}
        return F.struct(
            strict_json.is_document(parsed, raw).alias("valid"),
            *[strict_json.text(m).alias(field) for field, m in members.items()],
            *[strict_json.type_name(m).alias(f"{field}_type") for field, m in members.items()],
        )

    return let(strict_json.parse(raw), lambda parsed: let(pick(parsed), body))


def _time(ts: Column) -> Column:
    return F.struct(ts.alias("ts"), F.lit(0).cast("tinyint").alias("sub"))


# The pieces layouts are made of. All of them convert without loss.
_WS = r"[ \t\r\n]*"
_SEP = rf"{_WS}:{_WS}"
_NEXT = rf"{_WS},{_WS}"
_SIMPLE_STRING = r'"([^"\\\x00-\x1f]*)"'
_DECIMAL = r"-?[0-9]{1,20}(?:\.[0-9]{1,18})?"
_JSON_DECIMAL = r"-?(?:0|[1-9][0-9]{0,19})(?:\.[0-9]{1,18})?"
_INSTANT = (
    r"(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,7})?(?:Z|\+00:00)"
)


# ---- A: JSON object, JSON numbers, Unix milliseconds ------------------------------------------

_NUMERIC = r"^(?:BIGINT|DOUBLE|DECIMAL)"
_JSON_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


def _read_a(raw: Column) -> Column:
    names = {"ticker": "symbol", "price": "price", "volume": "size", "ts": "ts"}

    def of_members(m: Column) -> Column:
        def number(field: str) -> Column:
            # Numbers with an exponent, or too long for a decimal, were parsed to doubles. Their digits are
            # still in the frame; a quote inside a text is escaped and so can't be mistaken for the name's.
            literals = F.regexp_extract_all(raw, F.lit(rf'"{names[field]}"{_SEP}({_JSON_NUMBER})'))
            value = m[field].try_cast("double")
            literal = F.get(F.reverse(F.filter(literals, lambda x: x.try_cast("double") == value)), 0)
            double = F.coalesce(numbers.plain_number(literal), F.when(literal.isNull(), numbers.json_double_text(m[field])))
            return F.when(m[f"{field}_type"] == "DOUBLE", double).otherwise(m[field])

        def number_checks(field: str) -> list[tuple[Column, str]]:
            return [
                (m[f"{field}_type"].isNull(), f"missing_{field}"),
                (~m[f"{field}_type"].rlike(_NUMERIC), f"bad_{field}"),
                (number(field).isNull(), DECIMAL_RANGE),
            ]

        millis = F.when(m["ts_type"] == "BIGINT", m["ts"].try_cast("bigint"))
        return reading(
            ignored=m["valid"] & m["ticker_type"].isNull(),
            reason=_first_failed(
                (~m["valid"], INVALID_JSON),
                (m["ticker_type"] != "STRING", "bad_ticker"),
                *number_checks("price"),
                *number_checks("volume"),
                (m["ts_type"].isNull(), "missing_ts"),
                (millis.isNull(), "bad_ts"),
                (~times.millis_in_range(millis), TS_RANGE),
            ),
            ticker=m["ticker"],
            price=number("price"),
            volume=number("volume"),
            ts=times.from_unix_millis(millis),
        )

    return _members(raw, names, of_members)


FORMAT_A = register_format(
    WireFormat(
        "A",
        _read_a,
        Layout(
            rf'^{_WS}\{{{_WS}"symbol"{_SEP}{_SIMPLE_STRING}{_NEXT}"price"{_SEP}({_JSON_DECIMAL})'
            rf'{_NEXT}"size"{_SEP}({_JSON_DECIMAL}){_NEXT}"ts"{_SEP}(0|[1-9][0-9]{{0,13}}){_WS}\}}{_WS}\z',
            (2, 3, 4, 1),
            lambda text: _time(F.timestamp_millis(text.cast("bigint"))),
        ),
    )
)


# ---- B: JSON object, every value a string, ISO-8601 time --------------------------------------


def _read_b(raw: Column) -> Column:
    def of_members(m: Column) -> Column:
        iso = times.iso_text(F.when(m["ts_type"] == "STRING", m["ts"]))
        time = F.struct(iso.alias("iso"), times.iso_sub_micro(m["ts"]).alias("sub"))
        return let(time, lambda t: with_time(m, t))

    def with_time(m: Column, t: Column) -> Column:
        def string_checks(field: str) -> list[tuple[Column, str]]:
            kind = m[f"{field}_type"]
            return [(kind.isNull(), f"missing_{field}"), (kind != "STRING", f"bad_{field}")]

        return reading(
            ignored=m["valid"] & m["ticker_type"].isNull(),
            reason=_first_failed(
                (~m["valid"], INVALID_JSON),
                (m["ticker_type"] != "STRING", "bad_ticker"),
                *string_checks("price"),
                *string_checks("volume"),
                *string_checks("ts"),
                (t["iso"].isNull(), "bad_ts"),
            ),
            ticker=m["ticker"],
            price=m["price"],
            volume=m["volume"],
            ts=times.from_iso(t["iso"], t["sub"]),
            ts_sub_us=t["sub"] % 10,
        )

    return _members(raw, {"ticker": "s", "price": "p", "volume": "v", "ts": "t"}, of_members)


FORMAT_B = register_format(
    WireFormat(
        "B",
        _read_b,
        Layout(
            rf'^{_WS}\{{{_WS}"s"{_SEP}{_SIMPLE_STRING}{_NEXT}"p"{_SEP}"({_DECIMAL})"'
            rf'{_NEXT}"v"{_SEP}"({_DECIMAL})"{_NEXT}"t"{_SEP}"({_INSTANT})"{_WS}\}}{_WS}\z',
            (2, 3, 4, 1),
            lambda text: F.struct(
                text.try_cast("timestamp").alias("ts"),
                # the seventh fractional digit, if there is one
                F.coalesce(F.substring(text, 27, 1).try_cast("tinyint"), F.lit(0).cast("tinyint")).alias("sub"),
            ),
        ),
    )
)


# ---- C: ticker|price|volume|Unix seconds ------------------------------------------------------

_BLANK = r"^(?U)\s*$"


def _read_c(raw: Column) -> Column:
    def of_parts(parts: Column) -> Column:
        part = lambda i: F.try_element_at(parts, F.lit(i))
        return let(numbers.long_from_text(part(4)), lambda seconds: with_seconds(parts, part, seconds))

    def with_seconds(parts: Column, part: Callable[[int], Column], seconds: Column) -> Column:
        return reading(
            ignored=F.coalesce(raw.rlike(_BLANK), F.lit(True)),
            reason=_first_failed(
                (F.size(parts) != 4, FIELD_COUNT),
                (numbers.number_text(part(2)).isNull(), "bad_price"),
                (numbers.number_text(part(3)).isNull(), "bad_volume"),
                (seconds.isNull(), "bad_ts"),
                (~times.seconds_in_range(seconds), TS_RANGE),
            ),
            ticker=part(1),
            price=part(2),
            volume=part(3),
            ts=times.from_unix_seconds(seconds),
        )

    return let(F.split(raw, r"[|]", -1), of_parts)


FORMAT_C = register_format(
    WireFormat(
        "C",
        _read_c,
        Layout(
            rf"^([^|\x01]*)\|({_DECIMAL})\|({_DECIMAL})\|([0-9]{{1,11}})\z",
            (2, 3, 4, 1),
            lambda text: _time(F.timestamp_seconds(text.cast("bigint"))),
        ),
    )
)
