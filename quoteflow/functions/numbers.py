"""Exact decimals from text, and back to text.

A value that does not fit DECIMAL(38,18) exactly is refused, never rounded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The invariant "number" grammar of decimal text. Outer blanks, one sign in front or
# behind, thousands commas before the point, no exponent.
_BODY = r"(?:[0-9][0-9,]*(?:\.[0-9]*)?|\.[0-9]+)"
_NUMBER = rf"^\s*(?:[+-]?{_BODY}|{_BODY}\s*[+-])\s*$"
_NUMBER_PARTS = rf"^\s*([+-]?)({_BODY})\s*([+-]?)\s*$"

_PLAIN = r"^-?[0-9]+(?:\.[0-9]+)?$"
_FITS = r"^-?0*[0-9]{0,20}(?:\.[0-9]{0,18}0*)?$"
_INTEGER = r"^\s*[+-]?[0-9]+\s*$"


def number_text(text: Column) -> Column:
    """Decimal text with its sign in front and no commas or blanks; null if it is not a number."""
    in_front = F.regexp_replace(text, _NUMBER_PARTS, "$1$3$2")
    return F.when(text.rlike(_PLAIN), text).when(text.rlike(_NUMBER), F.translate(in_front, ",+", ""))


def exact_decimal(number: Column) -> Column:
    """The value of ``number_text`` output; null if it needs more than 20 + 18 digits."""
    return F.when(number.rlike(_FITS), number.try_cast("decimal(38,18)"))


def plain_number(literal: Column) -> Column:
    """A JSON number literal without its exponent, digit for digit; null if that runs to absurd lengths."""
    whole, part = F.regexp_extract(literal, r"^-?([0-9]+)", 1), F.regexp_extract(literal, r"\.([0-9]+)", 1)
    power = F.regexp_extract(literal, r"[eE]\+?(-?[0-9]+)$", 1)
    shift = F.when(power == "", 0).otherwise(power.try_cast("int"))
    digits = F.concat(whole, part)
    point = F.length(whole) + shift
    moved = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= F.length(digits), F.concat(digits, F.repeat(F.lit("0"), point - F.length(digits))))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits))))
    )
    sign = F.regexp_extract(literal, "^(-?)", 1)
    nothing = F.regexp_replace(digits, "0", "") == ""
    return F.when(nothing, "0").when(F.abs(shift) <= 400, F.concat(sign, moved))


def json_double_text(text: Column) -> Column:
    """The text of a JSON number that was held as a double, without exponent.

    Null where a double may not be exact: more than 15 significant digits, or too small.
    """
    value = text.try_cast("double")
    exact = value.try_cast("decimal(38,18)")
    mantissa = F.regexp_replace(text, r"[eE].*$|[^0-9]", "")
    lossless = (exact.cast("double") == value) & (F.length(F.trim(mantissa, F.lit("0"))) <= 15)
    return F.when(lossless, exact.cast("string"))


def long_from_text(text: Column) -> Column:
    """A 64-bit integer with optional sign and outer blanks; null for anything else."""
    return F.when(text.rlike(_INTEGER), F.regexp_replace(text, r"[\s+]", "").try_cast("bigint"))


def decimal_to_text(value: Column) -> Column:
    """Plain digits without trailing zeros."""
    text = value.cast("string")
    return F.when(text.contains("."), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as a double, 0 where the denominator is not positive."""
    return F.when(
        denominator > 0, numerator.cast("double") / denominator.cast("double")
    ).otherwise(F.lit(0.0))
