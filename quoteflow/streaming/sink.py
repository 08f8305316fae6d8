"""Writing micro-batches to a store that may fail.

A failed write is tried again with growing, randomized pauses. When the attempts are used up the
batch either goes to the dead-letter table and is counted as dropped, or the query fails and replays
it from the checkpoint. The ledger has the last word on where a batch's ticks are: a batch that is given
up after the store took it, or stored after it was given up, is in one place only. Counters are written
per batch id and replaced on replay, so a batch that runs twice counts once.
"""

from __future__ import annotations

import logging
import random
import time
from collections.abc import Callable
from datetime import timedelta

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteflow.config import SinkOptions
from quoteflow.schemas import DECIMAL, STORE_COLUMNS, TICKS
from quoteflow.sources.store import DROPPED, Ledger, Sink, TickStore, new_attempt, path_exists

log = logging.getLogger(__name__)

COUNTERS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("gen", T.LongType()),
        T.StructField("received", T.LongType()),
        T.StructField("deduplicated", T.LongType()),
        T.StructField("written", T.LongType()),
        T.StructField("dropped", T.LongType()),
        T.StructField("batch_id", T.LongType()),
    ]
)

DEAD_LETTER = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("price", DECIMAL),
        T.StructField("volume", DECIMAL),
        T.StructField("ts", T.TimestampType()),
        T.StructField("arrival_ts", T.TimestampType()),
        T.StructField("frame_seq", T.LongType()),
        T.StructField("error", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("attempt", T.StringType()),
        T.StructField("gen", T.LongType()),
    ]
)

# When a batch was taken off what waits, and how many ticks it had.
COMMITS = T.StructType(
    [
        T.StructField("taken", T.LongType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("batch_id", T.LongType()),
    ]
)

LATE = T.StructType([*TICKS.fields, T.StructField("gen", T.LongType()), T.StructField("batch_id", T.LongType())])


def write_with_retry(
    write: Callable[[], None],
    options: SinkOptions,
    sleep: Callable[[float], None] = time.sleep,
    jitter: Callable[[], float] = random.random,
) -> Exception | None:
    """Run ``write`` until it succeeds or the attempts are used up; the last error, or None."""
    for attempt in range(1, options.max_attempts + 1):
        try:
            write()
            return None
        except Exception as error:  # noqa: BLE001 - whatever the store raises is a failed write
            if attempt == options.max_attempts:
                log.error("batch write failed after %d attempts: %s", attempt, error)
                return error
            pause: timedelta = options.delay_ceiling(attempt) * jitter()
            log.warning("batch write failed (attempt %d of %d): %s", attempt, options.max_attempts, error)
            sleep(pause.total_seconds())
    return None


def batch_writer(
    store: Sink,
    dead_letter_path: str,
    counters_path: str,
    options: SinkOptions,
    ledger: Ledger,
    sleep: Callable[[float], None] = time.sleep,
    late_path: str | None = None,
    commits_path: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over dedup decisions.

    ``ledger`` is that of the tick store; with another sink it only says what became of each batch. Ticks that a
    policy calls late go to the table at ``late_path``, and when each batch was done to the one at ``commits_path``.
    """
    first = True

    def write(decided: DataFrame, batch_id: int) -> None:
        nonlocal first
        spark = decided.sparkSession
        # Several writes read the batch; it is as large as one trigger allows, and spills to disk.
        decided.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if decided.isEmpty():
                return
            accepted = decided.filter("accepted")
            if first and ledger.replaced(spark, batch_id):
                return  # given up, replayed by hand, and now replayed from the checkpoint as well
            first = False
            if late_path is not None and "late" in decided.columns:
                late = decided.filter("late").select(*TICKS.fieldNames(), "gen")
                if not late.isEmpty():
                    _replace(late, late_path, batch_id)
            error = write_with_retry(lambda: store(accepted, batch_id), options, sleep)
            if error is not None:
                if options.on_exhausted == "fail":
                    raise error
                attempt = new_attempt()
                _add(_dead_rows(accepted, str(error), attempt), dead_letter_path, batch_id, "attempt")
                ledger.settle(spark, batch_id, attempt, DROPPED)
            _replace(_counters(decided, stored=error is None), counters_path, batch_id)
            if commits_path is not None:
                _replace(decided.agg(F.sum("copies").alias("taken"), F.current_timestamp().alias("at")), commits_path, batch_id)
        finally:
            decided.unpersist()

    return write


def _counters(decided: DataFrame, stored: bool) -> DataFrame:
    accepted, none = F.count_if("accepted"), F.lit(0).cast("bigint")
    late = F.count_if("late") if "late" in decided.columns else none
    return decided.groupBy("source", "gen").agg(
        F.sum("copies").alias("received"),
        (F.sum("copies") - accepted - late).alias("deduplicated"),
        (accepted if stored else none).alias("written"),
        (none if stored else accepted).alias("dropped"),
    )


def _dead_rows(accepted: DataFrame, error: str, attempt: str) -> DataFrame:
    return accepted.select(
        *STORE_COLUMNS, "arrival_ts", "frame_seq", F.lit(error).alias("error"), F.lit(attempt).alias("attempt"), "gen"
    )


def _with_batch(df: DataFrame, batch_id: int) -> DataFrame:
    return df.withColumn("batch_id", F.lit(batch_id).cast("bigint"))


def _replace(df: DataFrame, path: str, batch_id: int) -> None:
    (
        _with_batch(df, batch_id)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def _add(df: DataFrame, path: str, batch_id: int, *below: str) -> None:
    _with_batch(df, batch_id).write.mode("append").partitionBy("batch_id", *below).parquet(path)


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """Received, deduplicated, written and dropped per batch, source and generation.

    Of the ticks received, those that are not counted further are late.
    """
    return _read_or_empty(spark, path, COUNTERS)


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """When each batch was done, and how many ticks it took."""
    return _read_or_empty(spark, path, COMMITS)


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """The ticks that came too late for the policy, with their generation and batch."""
    return _read_or_empty(spark, path, LATE)


def read_dead_letter(spark: SparkSession, path: str, ledger: Ledger) -> DataFrame:
    """The ticks of batches that are given up as things stand."""
    return ledger.visible(_read_or_empty(spark, path, DEAD_LETTER), DROPPED)


def replay_dead_letter(spark: SparkSession, path: str, store: TickStore, counters_path: str, batch_id: int) -> None:
    """Move everything in the dead-letter table into the store, as one batch.

    Choose an id that no stream uses. The ledger row that makes the ticks visible in the store is the
    one that takes them out of the dead letter. Counters get what was written and is no longer dropped, in the
    generations it arrived in.
    """
    dead = read_dead_letter(spark, path, store.ledger)
    ids = [r[0] for r in dead.select("batch_id").distinct().collect()]  # one for each batch given up
    if not ids:
        return
    moved = dead.groupBy("source", "gen").agg(F.count(F.lit(1)).alias("n"))
    zero, n = F.lit(0).cast("bigint"), F.col("n")
    counted = moved.select(
        "source", "gen", zero.alias("received"), zero.alias("deduplicated"),
        n.alias("written"), (-n).alias("dropped"),
    )
    _replace(counted, counters_path, batch_id)
    store.write(dead, batch_id, replaces=ids)


def _read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    if not path_exists(spark, path):  # nothing was ever written there
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
