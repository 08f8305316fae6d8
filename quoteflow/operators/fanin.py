"""Merging the feeds of many sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def fan_in(feeds: Sequence[DataFrame]) -> DataFrame:
    """All rows of all feeds, batch or streaming. No order between them, and none waits for another."""
    if not feeds:
        raise ValueError("fan_in needs at least one feed")
    return reduce(DataFrame.unionByName, feeds)
