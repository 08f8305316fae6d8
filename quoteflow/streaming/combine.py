"""Folding re-sends together before the shuffle of a streaming query.

Batch aggregates do this by themselves; stateful streaming operators do not, and a key that holds a
large share of a micro-batch would arrive at one task row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteflow.operators import dedup
from quoteflow.schemas import KEY, TICKS

# Ticks of one key and generation: when the first and the last arrived, and how many there are.
COMBINED = T.StructType(
    [TICKS[c] for c in KEY]
    + [
        T.StructField("gen", T.LongType()),
        T.StructField("first_ts", T.TimestampType()),
        T.StructField("frame_seq", T.LongType()),
        T.StructField("arrival_ts", T.TimestampType()),
        T.StructField("copies", T.LongType()),
    ]
)

_GROUP = [*KEY, "gen"]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = COMBINED.fieldNames()
    for batch in batches:
        table = pa.Table.from_batches([batch])
        # Ordered grouping, so that "first" is the first arrival.
        grouped = (
            table.sort_by([("first_ts", "ascending"), ("frame_seq", "ascending")])
            .group_by(_GROUP, use_threads=False)
            .aggregate(
                [("first_ts", "first"), ("frame_seq", "first"), ("arrival_ts", "max"), ("copies", "sum")]
            )
            .rename_columns([*_GROUP, "first_ts", "frame_seq", "arrival_ts", "copies"])
            .select(names)
        )
        if grouped.num_rows < table.num_rows:
            yield from grouped.cast(table.schema).to_batches()
        else:
            yield batch


def combine(ticks: DataFrame, window: timedelta = dedup.DEFAULT_WINDOW, fold: bool = True) -> DataFrame:
    """One row per key, generation and Arrow batch. Stateless, so it works inside a stream.

    ``arrival_ts`` is the last arrival of the folded copies: they count as late only together.
    """
    rows = ticks.select(
        *KEY,
        dedup.generation(F.col("arrival_ts"), window).alias("gen"),
        F.col("arrival_ts").alias("first_ts"),
        "frame_seq",
        "arrival_ts",
        F.lit(1).cast("bigint").alias("copies"),
    )
    return rows.mapInArrow(_fold, COMBINED) if fold else rows
