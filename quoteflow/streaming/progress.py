"""Progress of running queries as rows."""

from __future__ import annotations

from collections import deque
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from quoteflow.sources.store import path_exists

PROGRESS = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("ts", T.StringType()),
        T.StructField("input_rows", T.LongType()),
        T.StructField("input_rows_per_second", T.DoubleType()),
        T.StructField("processed_rows_per_second", T.DoubleType()),
        T.StructField("state_rows", T.LongType()),
        T.StructField("late_dropped", T.LongType()),
        T.StructField("deduplicated", T.LongType()),
    ]
)


def progress_row(progress: Any) -> tuple:
    """One micro-batch of one query.

    ``state_rows`` are rows of state, which for ``exact`` are buckets; remembered keys are in
    ``jobs.tracked_keys``.
    """
    state = progress.stateOperators
    return (
        progress.name,
        progress.batchId,
        progress.timestamp,
        progress.numInputRows,
        _finite(progress.inputRowsPerSecond),
        _finite(progress.processedRowsPerSecond),
        sum(s.numRowsTotal for s in state),
        sum(s.numRowsDroppedByWatermark for s in state),
        sum(int((s.customMetrics or {}).get("numDroppedDuplicateRows", 0)) for s in state),
    )


def _finite(x: float | None) -> float:
    return x if x is not None and x == x and abs(x) != float("inf") else 0.0


class ProgressRecorder(StreamingQueryListener):
    """The progress of all queries; add it with ``spark.streams.addListener``.

    With a ``path``, rows go to a table there, ``every`` so many at a time, and none is lost but those a
    crash takes from memory. Without one, only the latest ``keep`` rows are there to look at. Nothing is
    accounted from either: counters, store, dead letter and landed table are for that.
    """

    def __init__(self, path: str | None = None, every: int = 60, keep: int = 3600) -> None:
        self.path, self.every = path, every
        self.rows: deque[tuple] = deque(maxlen=None if path else keep)
        self.running: set[str] = set()

    def onQueryStarted(self, event: Any) -> None:
        self.running.add(str(event.id))

    def onQueryProgress(self, event: Any) -> None:
        self.rows.append(progress_row(event.progress))
        if self.path and len(self.rows) >= self.every:
            self.flush(SparkSession.active())

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        self.running.discard(str(event.id))

    def flush(self, spark: SparkSession) -> None:
        """Add what is in memory to the table."""
        if self.path and self.rows:
            rows = [self.rows.popleft() for _ in range(len(self.rows))]
            spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(self.path)

    def table(self, spark: SparkSession) -> DataFrame:
        """Progress rows with ``fill``: how much of what it can process the query is asked to."""
        df = spark.createDataFrame(list(self.rows), PROGRESS)
        if self.path and path_exists(spark, self.path):
            df = df.unionByName(spark.read.schema(PROGRESS).parquet(self.path))
        df = df.withColumn("ts", F.to_timestamp("ts"))
        busy = F.col("input_rows_per_second") / F.col("processed_rows_per_second")
        return df.withColumn("fill", F.when(F.col("processed_rows_per_second") > 0, busy).otherwise(F.lit(0.0)))
