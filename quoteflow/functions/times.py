"""Instants from Unix counts and ISO-8601 text, and back to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first and last representable instants, years 0001 to 9999.
MIN_SECONDS = -62_135_596_800
MAX_SECONDS = 253_402_300_799
MIN_MILLIS = MIN_SECONDS * 1_000
MAX_MILLIS = MAX_SECONDS * 1_000 + 999
MIN_MICROS = MIN_MILLIS * 1_000
MAX_MICROS = MAX_MILLIS * 1_000 + 999

_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_COMMON = (
    rf"^{_DATE}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(?:\.[0-9]{{1,18}})?"
    r"(?:Z|[+-](?:0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)$"
)
# Also legal: a blank for the T, no seconds, no time at all, no offset, an offset without a colon.
_ISO = (
    rf"^\s*{_DATE}"
    r"(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,18})?)?"
    r"\s*(?:Z|[+-](?:0[0-9]|1[0-3])(?::?[0-5][0-9])?|[+-]14(?::?00)?)?)?\s*$"
)


def millis_in_range(millis: Column) -> Column:
    return millis.between(MIN_MILLIS, MAX_MILLIS)


def seconds_in_range(seconds: Column) -> Column:
    return seconds.between(MIN_SECONDS, MAX_SECONDS)


def from_unix_millis(millis: Column) -> Column:
    """Null outside years 0001-9999; the built-in raises on overflow, so the guard comes first."""
    return F.when(millis_in_range(millis), F.timestamp_millis(millis))


def from_unix_seconds(seconds: Column) -> Column:
    return F.when(seconds_in_range(seconds), F.timestamp_seconds(seconds))


def iso_text(text: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss[.fraction]`` plus ``Z`` or ``+hh:mm``; null if it is not ISO-8601.

    Text without an offset is UTC.
    """
    full = F.regexp_replace(text, r"\s+$|^\s+", "")
    for pattern, replacement in (
        (rf"^({_DATE})$", "$1T00:00:00Z"),
        (rf"^({_DATE})[T ]([0-9:.]+)\s*(.*)$", "$1T$2$3"),
        (r"T([0-9]{2}:[0-9]{2})(?=$|[Z+-])", "T$1:00"),
        (r"(T[0-9:.]+)$", "$1Z"),
        (r"([+-][0-9]{2})([0-9]{2})$", "$1:$2"),
        (r"(T[0-9:.]+[+-][0-9]{2})$", "$1:00"),
    ):
        full = F.regexp_replace(full, pattern, replacement)
    return F.when(text.rlike(_COMMON), text).when(text.rlike(_ISO), full)


def iso_sub_micro(iso: Column) -> Column:
    """What ``iso_text`` output says beyond microseconds, in 100 ns units rounded to 0..10."""
    tail = F.regexp_extract(iso, r"\.[0-9]{6}([0-9]+)", 1)
    units = F.concat(F.substring(tail, 1, 1), F.lit("."), F.substring(tail, 2, 17))
    return F.when(tail != "", F.round(units.try_cast("decimal(18,17)")).cast("int")).otherwise(F.lit(0))


def from_iso(iso: Column, sub_micro: Column) -> Column:
    """The instant to microseconds; null outside years 0001-9999. Ten 100 ns units carry over."""
    micros = F.unix_micros(iso.try_cast("timestamp")) + F.when(sub_micro == 10, 1).otherwise(0)
    return F.when(micros.between(MIN_MICROS, MAX_MICROS), F.timestamp_micros(micros))


def to_iso(ts: Column, sub_us: Column | None = None) -> Column:
    """Round-trip ISO text with seven fractional digits, always ``+00:00``."""
    last = F.lit("0") if sub_us is None else F.coalesce(sub_us, F.lit(0)).cast("string")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), last, F.lit("+00:00"))
