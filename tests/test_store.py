"""The tick table and writing to it through faults."""

import glob
from datetime import date, datetime, timedelta
from decimal import Decimal

import pyarrow.parquet as pq
import pytest
from helpers import tick, ticks
from pyspark.sql import functions as F

from quoteflow.config import SinkOptions
from quoteflow.operators import dedup
from quoteflow.schemas import STORE
from quoteflow.session import dealt, spread
from quoteflow.sources.store import StoreMissing, TickStore, jdbc_sink
from quoteflow.streaming.sink import (
    batch_writer,
    read_counters,
    read_dead_letter,
    replay_dead_letter,
    write_with_retry,
)

QUICK = dict(backoff_initial=timedelta(milliseconds=1), backoff_max=timedelta(milliseconds=5))


def rows(spark, n, first=0):
    return dedup.decisions(ticks(spark, [tick(0, i, price=100 + i) for i in range(first, first + n)]))


class Faulty:
    """A sink that fails a number of calls before it lets them through."""

    def __init__(self, sink, failures):
        self.sink, self.failures, self.calls = sink, failures, 0

    def __call__(self, batch, batch_id):
        self.calls += 1
        if self.calls <= self.failures:
            raise ConnectionError("store down")
        self.sink(batch, batch_id)


@pytest.fixture
def store(spark, folder):
    return TickStore(f"{folder}/ticks").create(spark)


def writer(folder, sink, **options):
    options = SinkOptions(**{**QUICK, **options})
    ledger = TickStore(f"{folder}/ticks").ledger
    return batch_writer(sink, f"{folder}/dead", f"{folder}/counters", options, ledger, sleep=lambda s: None)


def dead_letter(spark, folder):
    return read_dead_letter(spark, f"{folder}/dead", TickStore(f"{folder}/ticks").ledger)


def totals(spark, folder):
    row = read_counters(spark, f"{folder}/counters").agg(F.sum("written"), F.sum("dropped")).first()
    return tuple(row)


def test_round_trip_keeps_decimals_exact(spark, store):
    when = datetime(2025, 2, 3, 4, 5, 6, 789)
    widest = Decimal("12345678901234567890.123456789012345678")
    df = spark.createDataFrame(
        [("exchange-c", "KIWI/NZD", widest, Decimal("0.000000000000000001"), when), ("exchange-b", "", -widest, Decimal(0), when)],
        STORE,
    )
    store.sink()(df, 0)
    assert store.rows(spark).exceptAll(df).isEmpty() and df.exceptAll(store.rows(spark)).isEmpty()


def test_the_store_is_not_created_by_a_write(spark, folder):
    missing = TickStore(f"{folder}/nothing")
    with pytest.raises(StoreMissing):
        missing.sink()(rows(spark, 1), 0)
    with pytest.raises(StoreMissing):
        missing.scan(spark)


def test_create_keeps_rows_and_truncate_removes_them(spark, store):
    store.sink()(rows(spark, 3), 0)
    store.create(spark)
    assert store.rows(spark).count() == 3
    store.truncate(spark)
    assert store.rows(spark).count() == 0
    store.sink()(rows(spark, 2), 0)
    assert store.rows(spark).count() == 2


def test_writing_a_batch_again_replaces_it(spark, store):
    write = store.sink()
    write(rows(spark, 3), 0)
    write(rows(spark, 4, first=10), 1)
    write(rows(spark, 3), 0)
    assert store.rows(spark).count() == 7


def test_a_batch_is_cut_into_files_of_the_given_size(spark, store):
    store.sink(files_per_batch=1, max_records_per_file=10)(rows(spark, 25), 0)
    files = glob.glob(f"{store.path}/event_date=*/batch_id=0/attempt=*/*.parquet")
    assert sorted(pq.read_metadata(f).num_rows for f in files) == [5, 10, 10]


def test_reads_by_day_skip_other_days(spark, store):
    store.sink()(rows(spark, 3), 0)
    scan = store.scan(spark).filter("event_date = DATE'2026-08-02'")
    assert "PartitionFilters: [isnotnull(event_date" in scan._jdf.queryExecution().executedPlan().toString()
    assert scan.count() == 0


def test_the_store_as_a_catalog_table(spark, store):
    store.sink()(rows(spark, 3), 0)
    ddl = store.ddl("stored_ticks")
    assert "price decimal(38,18) NOT NULL" in ddl and "PARTITIONED BY (event_date, batch_id, attempt)" in ddl
    spark.sql(ddl)
    try:
        spark.catalog.recoverPartitions("stored_ticks")
        assert spark.sql("SELECT count(*), count(DISTINCT source) FROM stored_ticks").first() == (3, 1)
    finally:
        spark.sql("DROP TABLE stored_ticks")


@pytest.mark.parametrize(
    "attempts, failures, written, dropped, calls",
    [(5, 0, 5, 0, 1), (5, 2, 5, 0, 3), (3, 99, 0, 5, 3)],
    ids=["healthy", "transient", "outage"],
)
def test_retries_then_a_counted_drop(spark, store, folder, attempts, failures, written, dropped, calls):
    sink = Faulty(store.sink(), failures)
    writer(folder, sink, max_attempts=attempts)(rows(spark, 5), 0)
    assert totals(spark, folder) == (written, dropped)
    assert sink.calls == calls
    assert store.rows(spark).count() == written
    dead = dead_letter(spark, folder)
    assert dead.count() == dropped
    if dropped:
        assert dead.first().error == "store down"


def test_the_next_batch_is_written_after_a_drop_and_the_drop_can_be_replayed(spark, store, folder):
    sink = Faulty(store.sink(), 3)
    write = writer(folder, sink, max_attempts=3)
    write(rows(spark, 5), 0)
    write(rows(spark, 5, first=5), 1)
    assert totals(spark, folder) == (5, 5)
    assert sink.calls == 4
    for _ in range(2):  # a second replay finds nothing
        replay_dead_letter(spark, f"{folder}/dead", store, f"{folder}/counters", batch_id=-1)
        assert store.rows(spark).count() == store.rows(spark).select("price").distinct().count() == 10
        assert dead_letter(spark, folder).isEmpty() and totals(spark, folder) == (10, 0)
    # the stream comes back to the batch that was replayed by hand
    writer(folder, store.sink())(rows(spark, 5), 0)
    assert store.rows(spark).count() == 10


def test_a_batch_that_was_given_up_and_then_stored_is_in_the_store_only(spark, store, folder):
    writer(folder, Faulty(store.sink(), 9), max_attempts=2)(rows(spark, 5), 0)
    assert dead_letter(spark, folder).count() == 5
    writer(folder, store.sink())(rows(spark, 5), 0)
    assert store.rows(spark).count() == 5 and dead_letter(spark, folder).isEmpty()
    assert totals(spark, folder) == (5, 0)


def test_a_batch_that_was_stored_and_then_given_up_is_in_the_dead_letter_only(spark, store, folder):
    sink = store.sink()

    def commits_then_fails(batch, batch_id):
        sink(batch, batch_id)
        raise TimeoutError("no answer " + "x" * 2000)

    writer(folder, commits_then_fails, max_attempts=2)(rows(spark, 5), 0)
    assert store.rows(spark).isEmpty() and totals(spark, folder) == (0, 5)
    assert {len(r.error) for r in dead_letter(spark, folder).collect()} == {2010}


def test_a_batch_of_several_days_is_there_as_a_whole_or_not_at_all(spark, store):
    long = dedup.decisions(ticks(spark, [tick(0, i, ts=datetime(2025, 1, 1 + i)) for i in range(3)]))
    store.sink()(long, 0)
    short = dedup.decisions(ticks(spark, [tick(0, 9, ts=datetime(2025, 1, 2))]))
    store.sink()(short, 0)  # no day of the first attempt survives
    assert [r.ts.day for r in store.rows(spark).collect()] == [2]
    # files without a ledger row, as an attempt that was cut off leaves them
    stray = store.scan(spark).drop("batch_id").selectExpr("*", "5L AS batch_id").select(*store.scan(spark).columns)
    stray.write.mode("append").partitionBy("event_date", "batch_id", "attempt").parquet(store.path)
    assert store.rows(spark).count() == 1


def test_a_write_lists_nothing_but_the_ledger(spark, store, monkeypatch):
    store.sink()(rows(spark, 3), 0)
    read = []
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *paths: read.extend(paths))
    store.sink()(rows(spark, 3), 1)
    assert not [p for p in read if not p.endswith("_ledger")]


def test_failing_mode_raises_and_counts_nothing(spark, store, folder):
    write = writer(folder, Faulty(store.sink(), 2), max_attempts=2, on_exhausted="fail")
    with pytest.raises(ConnectionError):
        write(rows(spark, 5), 0)
    assert read_counters(spark, f"{folder}/counters").count() == 0
    write(rows(spark, 5), 0)
    assert totals(spark, folder) == (5, 0)


def test_counters_of_a_replayed_batch_are_replaced(spark, store, folder):
    df = dedup.decisions(ticks(spark, [tick(0, 0), tick(1, 1), tick(2, 2, price=5)]))
    write = writer(folder, store.sink())
    write(df, 7)
    write(df, 7)
    counted = read_counters(spark, f"{folder}/counters").collect()
    assert [tuple(r)[2:] for r in counted] == [(3, 1, 2, 0, 7)]


def test_an_empty_batch_writes_nothing(spark, store, folder):
    sink = Faulty(store.sink(), 0)
    writer(folder, sink)(rows(spark, 0), 0)
    assert sink.calls == 0


def test_pauses_are_jittered_below_their_ceiling():
    pauses = []

    def fail():
        raise OSError("x")

    options = SinkOptions(max_attempts=5)
    for jitter in (0.0, 1.0):
        write_with_retry(fail, options, sleep=pauses.append, jitter=lambda j=jitter: j)
    assert pauses == [0, 0, 0, 0, 0.2, 0.4, 0.8, 1.6]


def test_jdbc_sink_sends_five_columns_in_batches(spark, monkeypatch):
    """No database here: what the writer is asked to do is all that is checked."""
    from pyspark.sql import DataFrameWriter

    seen = {}

    def jdbc(self, url, table, mode=None, properties=None):
        seen.update(url=url, table=table, properties=properties)

    monkeypatch.setattr(DataFrameWriter, "jdbc", jdbc)
    jdbc_sink("jdbc:postgresql://h/db", batch_size=200, user="u")(rows(spark, 1), 0)
    assert seen == {"url": "jdbc:postgresql://h/db", "table": "ticks", "properties": {"user": "u"}}


def stored_files(store):
    return glob.glob(f"{store.path}/event_date=*/batch_id=*/attempt=*/*.parquet")


def test_compaction_leaves_few_files_in_order_of_time_and_readers_undisturbed(spark, store):
    day = lambda i: datetime(2026, 3, 1 + i % 3, i % 24, i)
    for i in range(50):
        df = dedup.decisions(ticks(spark, [tick(0, 2 * i + k, price=1 + 2 * i + k, ts=day(i + k)) for k in range(2)]))
        store.write(df, i, files_per_batch=1)
    assert len(stored_files(store)) == 100
    reader, before = store.rows(spark), sorted(map(tuple, store.rows(spark).collect()))
    late = dedup.decisions(ticks(spark, [tick(0, 999, price=999, ts=datetime(2026, 3, 9))]))
    store.write(late, 50)
    assert store.compact(spark, date(2026, 3, 9), rows_per_file=20) == 50
    assert store.vacuum(spark, timedelta(hours=1)) == 0  # too young to be removed
    assert sorted(map(tuple, reader.collect())) == before
    assert store.rows(spark).count() == 101
    assert store.vacuum(spark, timedelta(0)) == 100
    assert sorted(map(tuple, store.rows(spark).filter("price < 999").collect())) == before
    files = [f for f in stored_files(store) if "batch_id=50/" not in f]
    assert len(files) <= 3 * 3  # of 33 or 34 rows a day, in files of 20 that may begin inside a day
    spans = []
    for f in files:
        ts = pq.read_table(f, columns=["ts"], partitioning=None).column("ts").to_pylist()
        spans.append((min(ts), max(ts)))
    spans.sort()
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    # a batch that comes back from a checkpoint is known to be there
    assert store.ledger.replaced(spark, 7) and not store.ledger.replaced(spark, 50)


def test_compacted_batches_are_compacted_again(spark, store):
    for i in range(6):
        store.write(rows(spark, 3, first=3 * i), i)
        if i % 2:
            assert store.compact(spark, date.max) == (2 if i == 1 else 3)
            store.vacuum(spark, timedelta(0))
    assert store.rows(spark).select("price").distinct().count() == store.rows(spark).count() == 18
    assert all(store.ledger.replaced(spark, i) for i in range(6))
    assert store.compact(spark, date.max) == 0
    assert store.ledger.rows(spark).count() <= 10 and len(store.ledger.rows(spark).inputFiles()) == 1


def test_a_clock_that_goes_back_does_not_bring_an_old_attempt_back(spark, store, monkeypatch):
    store.write(rows(spark, 3), 0)
    monkeypatch.setattr("time.time_ns", lambda: 5)
    store.write(rows(spark, 1, first=50), 0)
    monkeypatch.setattr("quoteflow.sources.store._numbers", {})  # a new process
    store.write(rows(spark, 2, first=70), 0)
    assert sorted(int(r.price) for r in store.rows(spark).collect()) == [170, 171]


def test_files_of_a_write_under_way_outlive_a_vacuum(spark, store):
    store.write(rows(spark, 2), 0)
    stray = store.scan(spark).withColumn("batch_id", F.lit(9).cast("long")).select("source", "ticker", "price", "volume", "ts", "event_date", "batch_id", "attempt")
    stray.write.mode("append").partitionBy("event_date", "batch_id", "attempt").parquet(store.path)
    assert store.vacuum(spark, timedelta(minutes=5)) == 0 and len(stored_files(store)) >= 2
    assert store.vacuum(spark, timedelta(0)) == 1 and store.rows(spark).count() == 2


def test_shares_are_written_once_and_read_apart(spark, tmp_path):
    rows = spark.range(1000).withColumn("n", F.when(F.col("id") % 7 != 0, F.col("id")))
    shares = dealt(rows, F.pmod(F.col("id"), F.lit(5)), 6, "shares")
    assert [sorted(r.id for r in s.collect()) for s in shares] == [*[list(range(i, 1000, 5)) for i in range(5)], []]
    read = [{r[0] for r in s.select(F.input_file_name()).distinct().collect()} for s in shares]
    assert all(s.dtypes == rows.dtypes for s in shares) and sum(map(len, read)) == len(set().union(*read)) == 5


def test_a_file_with_one_group_of_rows_is_shared_among_all_cores(spark, tmp_path):
    spark.range(20000).coalesce(1).write.parquet(str(tmp_path / "one"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        table = spark.read.parquet(str(tmp_path / "one"))
        cores = spark.sparkContext.defaultParallelism
        assert table.rdd.getNumPartitions() >= cores
        held = spread(table).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(held) == cores and max(r["count"] for r in held) < 20000 / cores * 1.5
