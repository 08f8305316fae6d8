"""Small tables for the tests."""

from datetime import UTC, datetime, timedelta
from decimal import Decimal

from quoteflow.schemas import FRAMES, TICKS

# On the grid of every window the tests use.
T0 = datetime(2026, 8, 1, 12, 0, 0, tzinfo=UTC)


def at(seconds=0.0):
    return T0 + timedelta(seconds=seconds)


def tick(seconds=0.0, seq=0, source="exchange-a", ticker="KIWI/NZD", price=100, volume=1, ts=None, sub=0):
    return (source, ticker, Decimal(price), Decimal(volume), ts or T0, sub, at(seconds), seq)


def ticks(spark, rows):
    return spark.createDataFrame(rows, TICKS)


def frames(spark, rows):
    """Rows of (format, raw); the rest is filled in."""
    return spark.createDataFrame([(f"exchange-{f.lower()}", f, raw, at(i), i) for i, (f, raw) in enumerate(rows)], FRAMES)
