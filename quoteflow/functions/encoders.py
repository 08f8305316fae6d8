"""Ticks back to wire text, one function of the tick columns per format."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoteflow.functions import strict_json, times
from quoteflow.functions.numbers import decimal_to_text

Encoder = Callable[[Column, Column, Column, Column, Column], Column]


def encode_a(ticker: Column, price: Column, volume: Column, ts: Column, ts_sub_us: Column) -> Column:
    return F.concat(
        F.lit('{"symbol":'), strict_json.quote(ticker),
        F.lit(',"price":'), decimal_to_text(price),
        F.lit(',"size":'), decimal_to_text(volume),
        F.lit(',"ts":'), F.unix_millis(ts).cast("string"),
        F.lit("}"),
    )


def encode_b(ticker: Column, price: Column, volume: Column, ts: Column, ts_sub_us: Column) -> Column:
    return F.concat(
        F.lit('{"s":'), strict_json.quote(ticker),
        F.lit(',"p":"'), decimal_to_text(price),
        F.lit('","v":"'), decimal_to_text(volume),
        F.lit('","t":"'), times.to_iso(ts, ts_sub_us),
        F.lit('"}'),
    )


def encode_c(ticker: Column, price: Column, volume: Column, ts: Column, ts_sub_us: Column) -> Column:
    return F.concat_ws(
        "|", ticker, decimal_to_text(price), decimal_to_text(volume), F.unix_seconds(ts).cast("string")
    )


ENCODERS: dict[str, Encoder] = {"A": encode_a, "B": encode_b, "C": encode_c}


def encode(fmt: Column, *tick: Column) -> Column:
    """Wire text in the format named by ``fmt``; null for a format without an encoder."""
    text = None
    for name, encoder in ENCODERS.items():
        wire = encoder(*tick)
        text = F.when(fmt == name, wire) if text is None else text.when(fmt == name, wire)
    return text
