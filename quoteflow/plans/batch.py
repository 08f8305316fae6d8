"""The flow over frames that are all there: one batch through the tables the streams use."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteflow.config import SinkOptions
from quoteflow.operators import dedup, normalize
from quoteflow.schemas import CLASSIFIED, KEY, STATUS_TICK, TICKS
from quoteflow.session import settled
from quoteflow.sources.store import Sink, path_exists
from quoteflow.streaming.jobs import Folders
from quoteflow.streaming.sink import batch_writer

# Batch runs count from here, far beyond the ids of micro-batches in the same folders.
FIRST_RUN = 1 << 40


def run_batch(
    frames: DataFrame, folders: Folders, *, run: int = 0, sink: Sink | None = None,
    options: SinkOptions | None = None, window: timedelta = dedup.DEFAULT_WINDOW, remember: bool = False,
) -> None:
    """Normalize, deduplicate and store. Frames are parsed once; all later steps read the result.

    ``run`` tells runs into the same folders apart. Runs add up; one that is repeated replaces itself. Each run
    deduplicates its own frames; with ``remember`` also against the last two generations of the run before, so that
    frames cut at any arrival times into runs in order leave what one run over all of them would. A run that is
    repeated reads the same memory as the first time.
    """
    spark, batch_id = frames.sparkSession, FIRST_RUN + run
    (
        normalize.classify(frames).withColumn("run", F.lit(run).cast("bigint"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("run", "status").parquet(folders.normalized_runs)
    )
    mine = spark.read.schema(CLASSIFIED).parquet(f"{folders.normalized_runs}/run={run}")
    ticks = normalize.ticks(mine.filter(F.col("status") == STATUS_TICK))
    write = batch_writer(
        sink or folders.store.sink(), folders.dead_letter, folders.counters, options or SinkOptions(), folders.store.ledger
    )
    if not remember:
        write(dedup.decisions(ticks, window), batch_id)
        return
    before = _memory_before(spark, folders, run)
    decided = settled(dedup.decisions(ticks, window, remembered=before), "decided")
    write(decided, batch_id)
    dedup.memory(decided, before).write.mode("overwrite").parquet(f"{folders.memory}/run={run}")


def _memory_before(spark: SparkSession, folders: Folders, run: int) -> DataFrame | None:
    """What the latest run before this one left to be remembered."""
    if not path_exists(spark, folders.memory):
        return None
    schema = T.StructType([*[TICKS[c] for c in KEY], T.StructField("gen", T.LongType()), T.StructField("run", T.LongType())])
    kept = spark.read.schema(schema).parquet(folders.memory).filter(F.col("run") < run)
    last = kept.agg(F.max("run")).first()[0]
    return None if last is None else kept.filter(F.col("run") == last).drop("run")
