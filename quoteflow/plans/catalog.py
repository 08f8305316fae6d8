"""The registered queries, each over the whole ``events`` table of a data folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteflow.config import SinkOptions, Source
from quoteflow.functions.formats import FORMATS
from quoteflow.operators import audit, dedup, fanin, monitor, normalize
from quoteflow.plans import batch, event_feed
from quoteflow.schemas import KEY, TICKS
from quoteflow.session import configure, dealt, scratch_dir, settled
from quoteflow.sources.frames import land_text, read_frames, stream_frames, text_frames
from quoteflow.sources.registry import bind_formats, registry_table
from quoteflow.sources.store import path_exists
from quoteflow.streaming import dedup as stream_dedup
from quoteflow.streaming import jobs, silence, sink, state

Query = Callable[[SparkSession, str], DataFrame]

SOURCES = tuple(Source(*row) for row in event_feed.EXCHANGES)
STREAM_BUCKETS = 32
SILENCE = timedelta(minutes=30)  # the events are sparse; the default of seconds is for live feeds

QUERIES: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_feed.frames(event_feed.read_events(configure(spark), sf_dir))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_feed.frames(event_feed.stream_events(configure(spark), sf_dir))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.classify(_frames(spark, sf_dir))


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.ticks(_classified(spark, sf_dir))


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.decisions(_ticks(spark, sf_dir))


IMPATIENT = SinkOptions(
    max_attempts=2, backoff_initial=timedelta(milliseconds=1), backoff_max=timedelta(milliseconds=2)
)


def _down(batch_df: DataFrame, batch_id: int) -> None:
    raise ConnectionError("store unavailable")


def _batch_flow(spark: SparkSession, sf_dir: str, lost: str | None = None) -> jobs.Folders:
    """A store filled from all frames, one run for each source into the same folders.

    The store cannot be reached during the run of the source named ``lost``.
    """
    folders = jobs.Folders(scratch_dir(spark, "batch-flow"))
    folders.store.create(spark)
    frames = _frames(spark, sf_dir)
    for run, source in enumerate(SOURCES):
        down = {"sink": _down, "options": IMPATIENT} if source.name == lost else {}
        batch.run_batch(frames.filter(F.col("source") == source.name), folders, run=run, **down)
    return folders


def _live_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots from the counters of a flow that could not store one of its sources."""
    folders = _batch_flow(spark, sf_dir, lost=SOURCES[1].name)
    return monitor.metrics(jobs.flow(spark, folders), len(SOURCES))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch_flow(spark, sf_dir).store.rows(spark)


def _stretches(frames: DataFrame, count: int) -> list[DataFrame]:
    """The frames, written once, cut into consecutive stretches of arrival time."""
    frames = settled(frames, "frames")
    at = F.unix_micros("arrival_ts")
    low, high = frames.agg(F.min(at), F.max(at)).first()
    if low is None:
        return [frames]
    width = (high - low) // count + 1
    nth = F.floor((at - low) / width)
    return [frames.filter(nth == i) for i in range(count)]


def _landing(spark: SparkSession, sf_dir: str, base: str, count: int = 4) -> Iterator[str]:
    """Land the frames stretch by stretch in one folder, which is given after each."""
    for stretch in _stretches(_frames(spark, sf_dir), count):
        stretch.write.mode("append").parquet(f"{base}/frames")
        yield f"{base}/frames"


def _late_landing(spark: SparkSession, sf_dir: str, base: str, count: int = 4) -> Iterator[str]:
    """As ``_landing``, but all frames of every seventeenth event come with the last stretch."""
    slow = F.floor(F.col("frame_seq") / 10) % 17 == 0
    parts = _stretches(_frames(spark, sf_dir), count)
    late = reduce(DataFrame.unionByName, [part.filter(slow) for part in parts])
    for nth, part in enumerate(parts):
        part = part.filter(~slow)
        part = part.unionByName(late) if nth == len(parts) - 1 else part
        part.write.mode("append").parquet(f"{base}/frames")
        yield f"{base}/frames"


def _watermark_flow(spark: SparkSession, sf_dir: str) -> jobs.Folders:
    """A flow under the JVM's own policy, with frames that come long after their time."""
    folders = jobs.Folders(scratch_dir(spark, "watermark-flow"))
    folders.store.create(spark)
    policy = lambda ticks: stream_dedup.within_watermark(ticks, timedelta(minutes=10))
    for landing in _late_landing(spark, sf_dir, folders.base):
        jobs.run_available(stream_frames(spark, landing), folders, deduplicate=policy)
    return folders


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.metrics(monitor.flow_by_generation(_classified(spark, sf_dir)), len(SOURCES))


def _plain(df: DataFrame) -> DataFrame:
    """Types that compare the same everywhere: instants as microseconds, decimals as doubles."""
    columns = []
    for name, kind in df.dtypes:
        if kind == "timestamp":
            columns.append(F.unix_micros(name).alias(f"{name}_us" if not name.endswith("_ts") else f"{name[:-3]}_us"))
        elif kind.startswith("decimal"):
            columns.append(F.col(name).cast("double").alias(name))
        elif kind == "tinyint":
            columns.append(F.col(name).cast("int").alias(name))
        else:
            columns.append(F.col(name))
    return df.select(columns)


# ---- frames and formats -----------------------------------------------------------------------


@_query
def encode_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = event_feed.quotes(event_feed.read_events(configure(spark), sf_dir))
    return normalize.encode_ticks(quotes).select("event_id", "source", "format", "raw")


def _normalize_format(fmt: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = _frames(spark, sf_dir).filter(F.col("format") == fmt)
        return _plain(normalize.ticks(normalize.classify(frames, {fmt: FORMATS[fmt]})))

    return query


for _fmt in ("A", "B", "C"):
    QUERIES[f"normalize_format_{_fmt.lower()}"] = _normalize_format(_fmt)


@_query
def classify_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("source", "frame_seq", "status")


@_query
def quarantine_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(normalize.quarantine(_classified(spark, sf_dir)))


@_query
def ignored_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(normalize.ignored(_classified(spark, sf_dir)))


@_query
def format_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: quotes sent, quotes read back, and quotes that differ after the round trip."""
    sent = event_feed.quotes(event_feed.read_events(configure(spark), sf_dir))
    wire = normalize.encode_ticks(sent).select(
        "source", "format", "raw", "arrival_ts", F.col("event_id").alias("frame_seq")
    )
    read = normalize.ticks(normalize.classify(wire))
    both = sent.select(*KEY, F.lit(1).alias("s"), F.lit(0).alias("r")).unionByName(
        read.select(*KEY, F.lit(0).alias("s"), F.lit(1).alias("r"))
    )
    return (
        both.groupBy(*KEY).agg(F.sum("s").alias("s"), F.sum("r").alias("r"))
        .groupBy("source")
        .agg(
            F.sum("s").alias("sent"),
            F.sum("r").alias("read_back"),
            F.sum(F.abs(F.col("s") - F.col("r"))).alias("different"),
        )
    )


@_query
def fan_in_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir)
    feeds = [
        normalize.classify(frames.filter(F.col("source") == s.name), {s.format: FORMATS[s.format]})
        for s in SOURCES
    ]
    return _plain(normalize.ticks(fanin.fan_in(feeds)).select("source", "ticker", "price", "volume", "ts", "frame_seq"))


@_query
def source_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that arrive without a format get their source's; ticks read that way."""
    bound = bind_formats(_frames(spark, sf_dir).drop("format"), SOURCES)
    return normalize.classify(bound).groupBy("source", "format").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(F.col("status") == "tick").alias("ticks")
    )


@_query
def frame_batch_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames landed as files and read back as a table."""
    path = f"{scratch_dir(spark, 'landed-frames')}/frames"
    _frames(spark, sf_dir).write.parquet(path)
    return _plain(
        read_frames(spark, path).groupBy("source", "format").agg(
            F.count(F.lit(1)).alias("frames"), F.min("arrival_ts").alias("first"), F.max("arrival_ts").alias("last")
        )
    )


# ---- deduplication ----------------------------------------------------------------------------


@_query
def dedup_two_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(dedup.deduplicate(_ticks(spark, sf_dir)))


@_query
def dedup_decisions_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.decision_counts(_decided(spark, sf_dir))


@_query
def tracked_keys_by_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.tracked_keys(dedup.accepted_per_generation(_decided(spark, sf_dir)))


def _run_to_table(stream: DataFrame, base: str) -> DataFrame:
    """Drain a streaming table into files, after those of earlier drains, and read all of them."""
    (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


@_query
def stream_dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four micro-batches, each a restart from the checkpoint; what they remember is carried and forgotten."""
    base, decided = scratch_dir(spark, "stream-dedup"), None
    for landing in _landing(spark, sf_dir, base):
        ticks = normalize.ticks(normalize.classify(stream_frames(spark, landing)))
        decided = _run_to_table(stream_dedup.exact(ticks, buckets=STREAM_BUCKETS), base)
    return _plain(decided.filter("accepted").select(TICKS.fieldNames()))


@_query
def stream_tracked_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After each of four micro-batches, the keys in the state that the newest ticks can meet."""
    base, rows = scratch_dir(spark, "stream-state"), []
    for nth, landing in enumerate(_landing(spark, sf_dir, base)):
        ticks = normalize.ticks(normalize.classify(stream_frames(spark, landing)))
        newest = _run_to_table(stream_dedup.exact(ticks, buckets=STREAM_BUCKETS), base).agg(F.max("gen")).first()[0]
        if newest is not None:
            rows.append((nth, newest, state.tracked(state.exact_keys(spark, f"{base}/checkpoint"), newest)))
    return spark.createDataFrame(rows, "nth int, gen long, tracked_keys long")


@_query
def stream_dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention beyond the last re-send, so every key survives exactly once."""
    ticks = normalize.ticks(normalize.classify(_stream(spark, sf_dir)))
    survivors = stream_dedup.within_watermark(ticks, timedelta(minutes=10))
    return _plain(_run_to_table(survivors.select(KEY), scratch_dir(spark, "stream-watermark")))


@_query
def stream_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals per source and minute, counted as they stream in."""
    arrivals = normalize.classify(_stream(spark, sf_dir)).withWatermark("arrival_ts", "10 minutes")
    minutes = monitor.throughput(arrivals, "1 minute")
    base = scratch_dir(spark, "stream-throughput")

    def keep(df: DataFrame, batch_id: int) -> None:
        # Update mode: a later batch replaces the counts it has seen more arrivals for.
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_id").parquet(f"{base}/out")

    (
        minutes.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
        .start().awaitTermination()
    )
    latest = (
        spark.read.parquet(f"{base}/out").groupBy("interval_start", "source")
        .agg(F.max_by(F.struct("received", "parse_errors", "ignored"), "batch_id").alias("c"))
    )
    return _plain(latest.select("interval_start", "source", "c.*"))


# ---- storing ----------------------------------------------------------------------------------


@_query
def stream_ticks_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames to stored ticks through both streaming queries."""
    folders = jobs.Folders(scratch_dir(spark, "stream-flow"))
    folders.store.create(spark)
    jobs.run_available(_stream(spark, sf_dir), folders)
    return _plain(folders.store.rows(spark))


@_query
def stream_ticks_landed_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the JVM's own operator as the policy, over several micro-batches."""
    folders = jobs.Folders(scratch_dir(spark, "stream-flow-watermark"))
    folders.store.create(spark)
    policy = lambda ticks: stream_dedup.within_watermark(ticks, timedelta(minutes=10))
    for landing in _landing(spark, sf_dir, folders.base, 3):
        jobs.run_available(stream_frames(spark, landing), folders, deduplicate=policy)
    return _plain(folders.store.rows(spark))


@_query
def dedup_across_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five batch runs store, cut anywhere in time, each with the memory of the one before."""
    folders = jobs.Folders(scratch_dir(spark, "runs"))
    folders.store.create(spark)
    for run, part in enumerate(_stretches(_frames(spark, sf_dir), 5)):
        batch.run_batch(part, folders, run=run, remember=True)
    return _plain(folders.store.rows(spark))


@_query
def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty small batches merged into one, and what they were removed."""
    store = jobs.Folders(scratch_dir(spark, "compacted")).store.create(spark)
    batches = dealt(dedup.deduplicate(_ticks(spark, sf_dir)), F.pmod(F.xxhash64(*KEY, "frame_seq"), F.lit(50)), 50, "accepted")
    for i, accepted in enumerate(batches):
        store.write(accepted, i, files_per_batch=1)
    store.compact(spark, before=date.max)
    store.vacuum(spark, timedelta(0))
    return _plain(store.rows(spark))


@_query
def stream_late_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks that came too late for the policy, kept aside as the flow met them."""
    folders = _watermark_flow(spark, sf_dir)
    return _plain(sink.read_late(spark, folders.late).select("source", "ticker", "price", "volume", "ts", "arrival_ts", "frame_seq"))


@_query
def reconcile_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tick of a flow with late ones is a re-send, stored, or late."""
    return jobs.reconciliation(spark, _watermark_flow(spark, sf_dir))


@_query
def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches of at most a quarter of the events' number: what they took together, and whether all kept to it."""
    folders = jobs.Folders(scratch_dir(spark, "batch-sizes"))
    folders.store.create(spark)
    bound = event_feed.read_events(configure(spark), sf_dir).count() // 4 + 1
    jobs.run_available(_stream(spark, sf_dir), folders, options=SinkOptions(max_rows=bound))
    batches = sink.read_counters(spark, folders.counters).groupBy("batch_id").agg(F.sum("received").alias("n"))
    return batches.agg(
        F.sum("n").alias("ticks"), (F.max("n") <= bound).alias("within_bound"), (F.count(F.lit(1)) >= 4).alias("several")
    )


@_query
def reconcile_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.reconciliation(spark, _batch_flow(spark, sf_dir))


@_query
def written_equals_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the writer counted against what the store holds."""
    return jobs.written_equals_stored(spark, _batch_flow(spark, sf_dir))


@_query
def sink_outage_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store is down for the middle one of three stretches of arrivals; each is one run.

    The flow restarts from its checkpoint every time, so deduplication carries across the runs.
    """
    frames = settled(_frames(spark, sf_dir), "frames")
    folders = jobs.Folders(scratch_dir(spark, "outage"))
    store = folders.store.create(spark)
    landing = f"{folders.base}/frames"
    bounds = [None, "2024-01-11", "2024-01-21", None]
    healthy = store.sink()

    for i, write in enumerate((healthy, _down, healthy)):
        begin, end = bounds[i], bounds[i + 1]
        stretch = frames
        if begin:
            stretch = stretch.filter(F.col("arrival_ts") >= F.lit(begin).cast("timestamp"))
        if end:
            stretch = stretch.filter(F.col("arrival_ts") < F.lit(end).cast("timestamp"))
        stretch.write.mode("append").parquet(landing)
        ticks = normalize.ticks(normalize.classify(stream_frames(spark, landing)))
        jobs.start_store(ticks, folders, sink=write, options=IMPATIENT).awaitTermination()

    counted = sink.read_counters(spark, folders.counters).groupBy("source").agg(
        F.sum("deduplicated").alias("deduplicated")
    )
    received = monitor.source_counters(normalize.classify(read_frames(spark, landing)))
    counters = received.join(counted, "source").select("source", "received", "deduplicated")
    dead = sink.read_dead_letter(spark, folders.dead_letter, store.ledger)
    return audit.reconcile(counters, store.rows(spark), dead)


# ---- monitoring -------------------------------------------------------------------------------


@_query
def source_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.source_counters(_classified(spark, sf_dir))


@_query
def flow_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, what became of every frame."""
    flow = monitor.flow_by_generation(_classified(spark, sf_dir))
    return _plain(monitor.flow_by_source(flow))


@_query
def flow_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(monitor.snapshot(_live_metrics(spark, sf_dir)))


SNAPSHOT = ["ts", "received", "parse_errors", "ignored", "late_dropped", "deduplicated", "written", "dropped", "outbound_count"]


@_query
def flow_snapshot_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a flow with late ticks, under the policy that drops them."""
    flow = jobs.flow(spark, _watermark_flow(spark, sf_dir))
    return _plain(monitor.snapshot(monitor.metrics(flow, len(SOURCES))).select(SNAPSHOT))


@_query
def flow_snapshot_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after what could not be stored was taken from the dead letter."""
    folders = _batch_flow(spark, sf_dir, lost=SOURCES[1].name)
    sink.replay_dead_letter(spark, folders.dead_letter, folders.store, folders.counters, batch_id=batch.FIRST_RUN - 1)
    flow = jobs.flow(spark, folders)
    return _plain(monitor.snapshot(monitor.metrics(flow, len(SOURCES))).select(SNAPSHOT))


@_query
def throughput_per_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(monitor.throughput(_classified(spark, sf_dir)))


@_query
def received_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = monitor.received_rate(_metrics(spark, sf_dir))
    return _plain(rated.select("ts", "received", "received_per_second"))


@_query
def stats_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(monitor.stats_line(monitor.received_rate(_live_metrics(spark, sf_dir))))


@_query
def backlog_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = monitor.high_water(_metrics(spark, sf_dir))
    return _plain(marked.select("ts", "outbound_count", monitor.fill().alias("outbound_fill"), "high_water"))


@_query
def stream_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What waited for the store when each of four batches had landed, and the most that had, by recorded times."""
    folders = jobs.Folders(scratch_dir(spark, "stream-backlog"))
    folders.store.create(spark)
    policy = lambda ticks: stream_dedup.within_watermark(ticks, timedelta(minutes=10))
    for landing in _landing(spark, sf_dir, folders.base):
        jobs.run_available(stream_frames(spark, landing), folders, deduplicate=policy)
    return jobs.backlog_over_time(spark, folders).filter("batch_id is not null").select("batch_id", "waiting", "high_water")


@_query
def stream_silent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources fall silent after the last event; the clock says so, as no frame does."""
    base = scratch_dir(spark, "stream-silence")
    _frames(spark, sf_dir).write.parquet(f"{base}/frames")
    events = silence.silence_events(stream_frames(spark, f"{base}/frames"), timedelta(seconds=3))
    query = (
        events.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
        .trigger(processingTime="500 milliseconds").start()
    )
    try:
        for _ in range(240):
            query.awaitTermination(0.5)
            table = spark.read.schema(silence.EVENTS).parquet(f"{base}/out") if path_exists(spark, f"{base}/out/_spark_metadata") else None
            if table is not None and table.select("source").distinct().count() == len(SOURCES):
                break
    finally:
        query.stop()
    return _plain(spark.read.schema(silence.EVENTS).parquet(f"{base}/out").withColumnRenamed("at", "last"))


@_query
def idle_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(monitor.idle_gaps(_frames(spark, sf_dir), SILENCE))


@_query
def source_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(monitor.sessions(_frames(spark, sf_dir), SILENCE))


@_query
def stream_idle_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that fell silent while frames streamed in, in three micro-batches."""
    base, alarms = scratch_dir(spark, "stream-idle"), None
    for landing in _landing(spark, sf_dir, base, 3):
        stream = monitor.idle_alarms(stream_frames(spark, landing), SILENCE, timedelta(minutes=10))
        alarms = _run_to_table(stream, base)
    return _plain(alarms)


@_query
def live_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(monitor.live_sources(_frames(spark, sf_dir), SILENCE))


# ---- audits -----------------------------------------------------------------------------------


@_query
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.store_counts(_stored(spark, sf_dir))


@_query
def store_distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.distinct_key_count(_stored(spark, sf_dir))


@_query
def store_distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(audit.distinct_rows(_stored(spark, sf_dir)))


@_query
def store_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.stored_sources(_stored(spark, sf_dir))


@_query
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One more source is expected than the events ever mention."""
    expected = registry_table(configure(spark), [*SOURCES, Source("exchange-d", "feed://exchange-d", "A")])
    return audit.source_coverage(_stored(spark, sf_dir), expected)


@_query
def store_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by day and source in the last week; only those days are read."""
    last = event_feed.read_events(configure(spark), sf_dir).agg(F.to_date(F.max("ts"))).first()[0]
    scan = _batch_flow(spark, sf_dir).store.scan(spark)
    week = scan.filter(F.col("event_date") >= F.lit(last - timedelta(days=6)))
    return week.groupBy("source", "event_date").agg(F.count(F.lit(1)).alias("row_count"))


@_query
def duplicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-sends from beyond the dedup window are stored again and show up here."""
    return _plain(audit.duplicate_audit(_stored(spark, sf_dir)))


@_query
def adjacent_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.adjacent_duplicates(_ticks(spark, sf_dir))


@_query
def adjacent_duplicates_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for feeds that landed as lines: files are in the order of their numbers, lines in that of their places."""
    frames = settled(_frames(spark, sf_dir), "frames")
    number = F.regexp_extract("path", "part-([0-9]+)", 1).cast("long")
    feeds = []
    for source in SOURCES:
        path = f"{scratch_dir(spark, 'lines')}/{source.name}"
        feed = frames.filter(F.col("source") == source.name).repartitionByRange("arrival_ts", "frame_seq")
        land_text(feed.sortWithinPartitions("arrival_ts", "frame_seq"), path)
        feeds.append(text_frames(spark, path, source.name, source.format, arrival=F.timestamp_seconds(number)))
    return audit.adjacent_duplicates(normalize.ticks(normalize.classify(fanin.fan_in(feeds))))


@_query
def store_scan_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(audit.first_rows(_stored(spark, sf_dir), 100))
