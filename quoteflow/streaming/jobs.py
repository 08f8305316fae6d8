"""The streaming flow as two queries over durable tables.

    frames -> classify -> normalized/batch_id=n/status=tick|parse_error|ignored      (land)
    normalized/*/status=tick -> dedup -> store, dead letter, late, counters          (store)

Landing keeps going while the store is down, and what it is ahead by is the backlog. Every counter
can be recomputed from the tables the queries leave behind.
"""

from __future__ import annotations

import contextlib
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import timedelta
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from quoteflow.config import JobConfig, SinkOptions
from quoteflow.operators import audit, dedup, monitor, normalize
from quoteflow.schemas import CLASSIFIED, STATUS_IGNORED, STATUS_PARSE_ERROR, STATUS_TICK
from quoteflow.sources.registry import bind_formats
from quoteflow.sources.store import Sink, StoreMissing, TickStore, path_exists
from quoteflow.streaming import dedup as stream_dedup
from quoteflow.streaming.landing import Lander, read_journal, read_landed, stream_landed
from quoteflow.streaming.sink import batch_writer, read_commits, read_counters, read_dead_letter, read_late

Dedup = Callable[[DataFrame], DataFrame]  # ticks -> decisions


@dataclass(frozen=True)
class Folders:
    """Where a flow keeps its tables, below one base folder that all executors can reach."""

    base: str

    @property
    def normalized(self) -> str:
        return f"{self.base}/normalized"

    @property
    def normalized_runs(self) -> str:
        """What batch runs have normalized; apart from the stream's batches."""
        return f"{self.base}/normalized_runs"

    @property
    def landings(self) -> str:
        """What was observed of every batch that landed."""
        return f"{self.base}/landings"

    @property
    def memory(self) -> str:
        """Keys that batch runs remember for the next."""
        return f"{self.base}/memory"

    @property
    def archive(self) -> str:
        """Where files that the store query has taken may be moved to."""
        return f"{self.base}/archive"

    @property
    def store(self) -> TickStore:
        return TickStore(f"{self.base}/ticks")

    @property
    def dead_letter(self) -> str:
        return f"{self.base}/dead_letter"

    @property
    def late(self) -> str:
        return f"{self.base}/late"

    @property
    def commits(self) -> str:
        return f"{self.base}/commits"

    @property
    def counters(self) -> str:
        return f"{self.base}/counters"

    def checkpoint(self, query: str) -> str:
        return f"{self.base}/checkpoints/{query}"


def _start(writer: DataStreamWriter, every: timedelta | None) -> StreamingQuery:
    if every is None:  # take what is there, then end
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{int(every.total_seconds() * 1000)} milliseconds").start()


def start_land(
    frames: DataFrame, folders: Folders, every: timedelta | None = None, rows_per_file: int | None = None
) -> StreamingQuery:
    """Normalize frames and keep every one of them, by what became of it."""
    writer = (
        normalize.classify(frames)
        .writeStream.queryName("land")
        .option("checkpointLocation", folders.checkpoint("land"))
        .foreachBatch(Lander(folders.normalized, folders.landings, rows_per_file))
    )
    return _start(writer, every)


def landed(spark: SparkSession, folders: Folders) -> DataFrame:
    """Everything normalized so far, by the stream and by batch runs."""
    out = read_landed(spark, folders.normalized).select(CLASSIFIED.fieldNames())
    archived = f"{folders.archive}{urlsplit(folders.normalized).path}"  # the archive repeats the path
    for path in (archived, folders.normalized_runs):
        if path_exists(spark, path):
            out = out.unionByName(spark.read.schema(CLASSIFIED).parquet(path).select(CLASSIFIED.fieldNames()))
    return out


def landed_ticks(
    spark: SparkSession, folders: Folders, max_files_per_trigger: int | None = None, archive: bool = False
) -> DataFrame:
    """Normalized ticks as a stream; only their own files are read.

    With ``archive`` Spark moves files that a batch has taken out of the way, so that they are not listed any more.
    """
    options = {"cleanSource": "archive", "sourceArchiveDir": folders.archive} if archive else {}
    return stream_landed(spark, folders.normalized, max_files_per_trigger, **options)


def start_store(
    ticks: DataFrame,
    folders: Folders,
    *,
    sink: Sink | None = None,
    options: SinkOptions | None = None,
    deduplicate: Dedup | None = None,
    window: timedelta = dedup.DEFAULT_WINDOW,
    buckets: int = stream_dedup.BUCKETS,
    every: timedelta | None = None,
) -> StreamingQuery:
    """Deduplicate ticks and store them batch by batch.

    ``buckets`` is part of the checkpoint: choose it for the cluster when a flow is first started.
    """
    decide = deduplicate or (lambda df: stream_dedup.exact(df, window, buckets=buckets))
    write = batch_writer(
        sink or folders.store.sink(), folders.dead_letter, folders.counters, options or SinkOptions(), folders.store.ledger,
        late_path=folders.late, commits_path=folders.commits,
    )
    writer = (
        decide(ticks)
        .writeStream.queryName("store")
        .outputMode("append")
        .option("checkpointLocation", folders.checkpoint("store"))
        .foreachBatch(write)
    )
    return _start(writer, every)


def run_available(
    frames: DataFrame, folders: Folders, *, sink: Sink | None = None, options: SinkOptions | None = None,
    window: timedelta = dedup.DEFAULT_WINDOW, deduplicate: Dedup | None = None,
    max_files_per_trigger: int | None = None,
) -> None:
    """Take every frame that is there through both queries, then end."""
    spark, options = frames.sparkSession, options or SinkOptions()
    start_land(frames, folders, rows_per_file=options.rows_per_file).awaitTermination()
    ticks = landed_ticks(spark, folders, max_files_per_trigger or options.files_per_batch)
    start_store(ticks, folders, sink=sink, options=options, window=window, deduplicate=deduplicate).awaitTermination()


def start_flow(
    frames: DataFrame, config: JobConfig, sink: Sink | None = None, *, deduplicate: Dedup | None = None,
    buckets: int = stream_dedup.BUCKETS,
) -> list[StreamingQuery]:
    """Run both queries until they are stopped. The store must exist.

    What is already there is landed first, so that the store query finds the landed table.
    ``config.sink`` says how often the store query takes a batch, and how many files or ticks at most.
    """
    spark, folders, every = frames.sparkSession, Folders(config.store), config.sink.max_latency
    if not folders.store.exists(spark):
        raise StoreMissing(f"no tick table at {folders.store.path}; create it first")
    bound = bind_formats(frames, config.sources)
    rows = config.sink.rows_per_file
    start_land(bound, folders, rows_per_file=rows).awaitTermination()
    ticks = landed_ticks(spark, folders, config.sink.files_per_batch)
    store = start_store(
        ticks, folders, sink=sink, options=config.sink, deduplicate=deduplicate, window=config.dedup_window,
        buckets=buckets, every=every,
    )
    return [start_land(bound, folders, every, rows), store]


def stop_gracefully(queries: list[StreamingQuery], deadline: timedelta = timedelta(seconds=10)) -> bool:
    """Stop the queries in order, each after it has taken what the one before it left.

    The first takes no more once its running micro-batch ends; the others drain first. False if the
    deadline cut one short. Nothing is lost either way: what was not taken is taken after a restart.
    """
    until = time.monotonic() + deadline.total_seconds()
    clean = True
    for nth, query in enumerate(queries):
        if nth and query.isActive:
            drain = threading.Thread(target=_drained, args=(query,), daemon=True)
            drain.start()
            drain.join(max(0.0, until - time.monotonic()))
            clean &= not drain.is_alive()
        while query.isActive and query.status["isTriggerActive"] and time.monotonic() < until:
            time.sleep(0.05)
        clean &= not (query.isActive and query.status["isTriggerActive"])
        query.stop()
    return clean


def _drained(query: StreamingQuery) -> None:
    with contextlib.suppress(Exception):  # stopped or failed meanwhile: the query itself says so
        query.processAllAvailable()


def backlog(spark: SparkSession, folders: Folders) -> DataFrame:
    """Per source, ticks that have landed and were not yet taken by the store query."""
    arrived = landed(spark, folders).filter(F.col("status") == STATUS_TICK).groupBy("source").count()
    taken = read_counters(spark, folders.counters).groupBy("source").agg(F.sum("received").alias("taken"))
    return arrived.join(taken, "source", "left").select(
        "source", (F.col("count") - F.coalesce("taken", F.lit(0))).alias("backlog")
    )


def backlog_over_time(spark: SparkSession, folders: Folders) -> DataFrame:
    """How many ticks waited for the store after each landing and each commit, and the most that ever did.

    From the times recorded when it happened; ``batch_id`` is that of the landing, or null for a commit.
    """
    landings = read_journal(spark, folders.landings).select("batch_id", "at", F.col("ticks").alias("change"))
    commits = read_commits(spark, folders.commits).select(
        F.lit(None).cast("bigint").alias("batch_id"), "at", (-F.col("taken")).alias("change")
    )
    return monitor.waiting(landings.unionByName(commits))


def tracked_keys(spark: SparkSession, folders: Folders) -> DataFrame:
    """Keys the deduplication remembers, per generation, from the counters of all batches."""
    accepted = F.sum(F.col("written") + F.col("dropped")).alias("accepted")
    return dedup.tracked_keys(read_counters(spark, folders.counters).groupBy("gen").agg(accepted))


def flow(spark: SparkSession, folders: Folders, window: timedelta = dedup.DEFAULT_WINDOW) -> DataFrame:
    """Per source and generation: what landed, and what the store query counted of it.

    ``monitor.metrics`` turns it into snapshots of the flow as it is.
    """
    names = ["deduplicated", "written", "dropped", "late_dropped", "taken"]
    seen = landed(spark, folders).groupBy("source", dedup.generation(F.col("arrival_ts"), window).alias("gen")).agg(
        F.count_if(F.col("status") == STATUS_TICK).alias("received"),
        F.count_if(F.col("status") == STATUS_PARSE_ERROR).alias("parse_errors"),
        F.count_if(F.col("status") == STATUS_IGNORED).alias("ignored"),
    )
    counted = read_counters(spark, folders.counters).groupBy("source", "gen").agg(
        F.sum("received").alias("taken"), *[F.sum(n).alias(n) for n in names[:3]]
    )
    late = read_late(spark, folders.late).groupBy("source", "gen").agg(F.count(F.lit(1)).alias("late_dropped"))
    joined = seen.join(counted, ["source", "gen"], "left").join(late, ["source", "gen"], "left").fillna(0, names)
    return joined.withColumn("accepted", F.col("written") + F.col("dropped"))


def reconciliation(spark: SparkSession, folders: Folders) -> DataFrame:
    """The accounting of a finished flow: landed ticks against re-sends, stored, dropped and late ones.

    Re-sends and late ticks are as the store query counted them, batch by batch. A policy of one's own balances if
    its rows say in ``copies`` what it was offered.
    """
    dead = read_dead_letter(spark, folders.dead_letter, folders.store.ledger)
    zero = F.lit(0).cast("bigint")
    names = ["received", "deduplicated", "late_dropped"]

    def side(df: DataFrame, name: str, count: Column) -> DataFrame:
        counted = df.groupBy("source").agg(count.alias(name))
        return counted.select("source", *[F.col(n) if n == name else zero.alias(n) for n in names])

    arrived = landed(spark, folders).filter(F.col("status") == STATUS_TICK)
    counters = (
        side(arrived, "received", F.count(F.lit(1)))
        .unionByName(side(read_counters(spark, folders.counters), "deduplicated", F.sum("deduplicated")))
        .unionByName(side(read_late(spark, folders.late), "late_dropped", F.count(F.lit(1))))
        .groupBy("source")
        .agg(*[F.sum(n).alias(n) for n in names])
    )
    return audit.reconcile(counters, folders.store.rows(spark), dead)


def written_equals_stored(spark: SparkSession, folders: Folders) -> DataFrame:
    """Per source, what the writer counted as written against the rows that are in the store."""
    return audit.written_equals_stored(read_counters(spark, folders.counters), folders.store.rows(spark))
