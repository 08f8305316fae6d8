"""Naming an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is evaluated once however often ``body`` uses it.

    Long chains of projections would do the same, but they are fused into one generated method that
    grows past what the JVM is willing to compile. A lambda stays out of the generated code.
    """
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))
