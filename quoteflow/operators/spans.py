"""Values carried along an order, without one task that sees all of it.

The order is cut into spans. Windows run inside a span; what goes over its edge comes from a second pass
with one row for each span. Both passes read what is carried from a table that is written once: it is a small
summary of a large input, and the input must not be read for each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.session import settled

_RUNNING = {"sum": F.sum, "max": F.max}


def carry(
    df: DataFrame,
    keys: list[str],
    span: Column,
    order: list[str],
    lagged: dict[str, str] | None = None,
    running: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Add columns that look back along ``order`` within ``keys``.

    ``lagged`` names new columns for the value of a column in the row before, ``running`` for the sum or
    max of a column up to and with the row. ``span`` must not fall along the order.
    """
    lagged, running = lagged or {}, running or {}
    df = settled(df.withColumn("_span", span), "carry")
    place = F.struct(*order)
    edges = df.groupBy(*keys, "_span").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.max_by(c, place).alias(f"_last_{name}") for name, c in lagged.items()],
        *[_RUNNING[f](c).alias(f"_all_{name}") for name, (f, c) in running.items()],
    )
    outer = Window.partitionBy(*(keys or [F.lit("all")])).orderBy("_span")  # a row for each span
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_span").alias("_k__span"),
        *[F.lag(f"_last_{name}").over(outer).alias(f"_in_{name}") for name in lagged],
        *[_RUNNING[f](f"_all_{name}").over(before).alias(f"_in_{name}") for name, (f, _) in running.items()],
    )
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*keys, "_span"]]
    joined = df.join(edges, on, "left")
    inner = Window.partitionBy(*keys, "_span").orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.row_number().over(inner) == 1
    added = {name: F.when(first, F.col(f"_in_{name}")).otherwise(F.lag(c).over(inner)) for name, c in lagged.items()}
    for name, (f, c) in running.items():
        here, past = _RUNNING[f](c).over(upto), F.col(f"_in_{name}")
        added[name] = F.coalesce(here, F.lit(0)) + F.coalesce(past, F.lit(0)) if f == "sum" else F.greatest(here, past)
    return joined.withColumns(added).select(*[c for c in df.columns if c != "_span" and c not in added], *added)
