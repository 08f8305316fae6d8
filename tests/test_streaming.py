"""Streams against the batch operators, across restarts and faults."""

import glob
import os
import random
import time
from datetime import UTC, datetime, timedelta

import pandas as pd
import pytest
from helpers import at, tick, ticks
from pyspark.errors import StreamingQueryException
from pyspark.sql import Row
from pyspark.sql import functions as F

from quoteflow.config import JobConfig, SinkOptions
from quoteflow.operators import dedup, normalize
from quoteflow.plans import event_feed
from quoteflow.plans.batch import run_batch
from quoteflow.schemas import FRAMES, KEY, TICKS
from quoteflow.sources.frames import stream_frames, text_frames
from quoteflow.sources.store import StoreMissing
from quoteflow.streaming import dedup as stream_dedup
from quoteflow.streaming import jobs, state
from quoteflow.streaming.combine import combine
from quoteflow.streaming.landing import Lander, read_journal, read_landed
from quoteflow.streaming.progress import ProgressRecorder, progress_row
from quoteflow.streaming.silence import EVENTS, silence_events
from quoteflow.streaming.sink import read_counters, read_late, replay_dead_letter

DECISION = [*KEY, "gen", "arrival_ts", "frame_seq", "copies", "accepted"]


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def drain(stream, folder):
    query = (
        stream.writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def tick_rows(n, seconds, keys, seed=11):
    rng = random.Random(seed)
    hot = [tick(rng.random() * seconds, i, ticker="HOT") for i in range(n // 3)]
    rest = [tick(rng.random() * seconds, i, ticker=f"SYM-{rng.randrange(keys)}") for i in range(n // 3, n)]
    return sorted(hot + rest, key=lambda r: (r[6], r[7]))


@pytest.mark.parametrize("fold", [True, False])
def test_exact_dedup_across_restarts_equals_the_batch_result(spark, folder, fold):
    rows = tick_rows(1500, 1440, 40)
    cuts = [0, 480, 960, 1440]
    landing = f"{folder}/ticks"
    for begin, end in zip(cuts, cuts[1:], strict=False):
        part = [r for r in rows if at(begin) <= r[6] < at(end)]
        ticks(spark, part).coalesce(2).write.mode("append").parquet(landing)
        drain(stream_dedup.exact(spark.readStream.schema(TICKS).parquet(landing), fold=fold), folder)
    got = spark.read.schema(stream_dedup.DECISIONS).parquet(f"{folder}/out").select(DECISION)
    assert same(got, dedup.decisions(ticks(spark, rows)).select(DECISION))


class Value:
    def __init__(self):
        self.x = None

    def get(self):
        return self.x

    def update(self, x):
        self.x = x


class Map:
    """A map state that counts what is asked of it."""

    def __init__(self):
        self.x, self.calls = {}, 0

    def containsKey(self, key):
        self.calls += 1
        return key in self.x

    def updateValue(self, key, value):
        self.calls += 1
        self.x[key] = value

    def clear(self):
        self.calls += 1
        self.x.clear()


def bucket(keep=3):
    rule = stream_dedup.GenerationRule(keep=keep)
    rule.held, rule.places = Value(), [Map() for _ in range(keep)]
    return rule


def offer(rule, pairs):
    row = lambda key, gen: Row(**{c: c for c in KEY}, identity=key, gen=gen, first_ts=gen, frame_seq=0, copies=1)
    return {(r.gen, r.frame_seq): r.accepted for r in rule.handleInputRows((0,), iter([row(k, g) for k, g in pairs]), None)}


def test_state_is_forgotten_when_it_cannot_matter_any_more():
    rule = bucket()
    for gen in range(0, 50, 2):
        offer(rule, [(f"{gen}-{i}", gen) for i in range(100)])
        assert sum(len(m.x) for m in rule.places) <= 200
    assert sorted(g for g in rule.held.get()[0] if g is not None) == [46, 48]


def test_a_micro_batch_touches_only_the_keys_that_arrive():
    rule = bucket()
    offer(rule, [(f"old-{i}", 7) for i in range(5000)])
    before = sum(m.calls for m in rule.places)
    offer(rule, [("new", 8), ("old-3", 8)])
    assert sum(m.calls for m in rule.places) - before <= 5


def test_state_written_follows_the_arrivals(spark, folder):
    landing, written = f"{folder}/ticks", []
    for n in (4000, 4):
        ticks(spark, [tick(len(written), i, price=1 + i) for i in range(n)]).coalesce(1).write.mode("append").parquet(landing)
        drain(stream_dedup.exact(spark.readStream.schema(TICKS).parquet(landing), buckets=4), folder)
        files = glob.glob(f"{folder}/checkpoint/state/0/*/**/*.changelog", recursive=True)
        written.append(sum(os.path.getsize(f) for f in files) - sum(written))
    assert 0 < written[1] < written[0] / 10
    assert spark.read.parquet(f"{folder}/out").filter("accepted").count() == 4000


@pytest.mark.parametrize("seed", range(5))
def test_generations_in_maps_agree_with_a_plain_memory(seed):
    """In any order, against sets that forget what lies more than three generations back."""
    rng = random.Random(seed)
    rule, sets, newest = bucket(), {}, -99
    for _ in range(60):
        pairs = sorted({(f"k{rng.randrange(6)}", max(0, rng.randrange(3) + len(sets) // 3 + rng.choice([0, 0, 1, 4, -3]))) for _ in range(5)}, key=lambda p: (p[1], p[0]))
        top, want = max([newest, *(g for _, g in pairs)]), {}
        known = {g: set(v) for g, v in sets.items() if g > newest - 3}
        for k, g in pairs:
            want[g, k] = not any(k in known.get(x, ()) for x in (g - 1, g, g + 1))
            if want[g, k]:
                known.setdefault(g, set()).add(k)
                sets.setdefault(g, set()).add(k)
        newest = top
        rows = [Row(**{c: c for c in KEY}, identity=k, gen=g, first_ts=g, frame_seq=i, copies=1) for i, (k, g) in enumerate(pairs)]
        got = {(r.gen, pairs[r.frame_seq][0]): r.accepted for r in rule.handleInputRows((0,), iter(rows), None)}
        assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_frames_are_decided_as_rows_are(seed):
    """The rule takes a bucket's ticks as frames, in any number and order, with copies of one tick in several."""
    rng = random.Random(seed)
    by_row, by_frame = bucket(), stream_dedup.GenerationRuleInFrames(keep=3)
    by_frame.held, by_frame.places = Value(), [Map() for _ in range(3)]
    for nth in range(20):
        offered = []
        for i in range(200):
            key, gen = f"k{rng.randrange(15)}", max(0, nth * 2 + rng.randrange(-4, 5))
            offered.append(Row(**{c: key for c in KEY}, identity=key, gen=gen, first_ts=rng.randrange(3), frame_seq=i, copies=rng.randrange(1, 4)))
        rows = sorted(tuple(r) for r in by_row.handleInputRows((0,), iter(offered), None))
        frame = pd.DataFrame([r.asDict() for r in offered]).sample(frac=1, random_state=seed)
        frames = list(by_frame.handleInputRows((0,), iter([frame[:90], frame[90:]]), None))
        assert sorted(tuple(r) for f in frames for r in f.itertuples(index=False)) == rows
        assert sum(r[-2] for r in rows) == sum(r.copies for r in offered)
        assert by_row.held.get() == by_frame.held.get() and [m.x for m in by_row.places] == [m.x for m in by_frame.places]


def test_exact_gives_decimals_and_times_back_as_they_were(spark, folder):
    old = datetime(1, 1, 1, 0, 0, 0, 1, tzinfo=UTC)
    rows = [tick(i, i, price=p, volume=v, ts=old if i else None, sub=9 - i) for i, (p, v) in enumerate([("1E-18", "-99999999999999999999.999999999999999999"), ("0", "100"), ("-0.5", "3")])]
    ticks(spark, rows).write.parquet(f"{folder}/ticks")
    drain(stream_dedup.exact(spark.readStream.schema(TICKS).parquet(f"{folder}/ticks"), buckets=4), folder)
    got = spark.read.schema(stream_dedup.DECISIONS).parquet(f"{folder}/out").select(DECISION)
    assert same(got, dedup.decisions(ticks(spark, rows)).select(DECISION)) and got.filter("accepted").count() == 3


def test_a_tick_out_of_order_meets_its_neighbours_and_none_is_lost(spark, folder):
    landing = f"{folder}/ticks"
    # generations 10, then 9 (a re-send of what is stored), 30, then 12 (long past: taken)
    for k, gen in enumerate((10, 9, 30, 12)):
        ticks(spark, [tick(gen * 120, k), tick(gen * 120 + 1, 10 + k, price=500 + k)]).coalesce(1).write.mode("append").parquet(landing)
        query = drain(stream_dedup.exact(spark.readStream.schema(TICKS).parquet(landing)), folder)
    got = spark.read.schema(stream_dedup.DECISIONS).parquet(f"{folder}/out")
    first = {(r.arrival_ts - at(0).replace(tzinfo=None)).total_seconds() // 120: r.accepted for r in got.filter("price = 100").collect()}
    assert first == {10: True, 9: False, 30: True, 12: True}
    assert got.count() == 8 and not any(progress_row(p)[7] for p in query.recentProgress)


def test_late_ticks_of_the_watermark_policy_are_accounted_for(spark, folder):
    folders = jobs.Folders(folder)
    folders.store.create(spark)
    policy = lambda df: stream_dedup.within_watermark(df, timedelta(minutes=4))
    for seconds in ([0, 1, 5000], [5001], [2, 3, 5002]):
        rows = [("exchange-c", "C", f"SYM|{s}|1|{s}", at(s), s) for s in seconds]
        jobs.run_available(land(spark, folder, rows), folders, deduplicate=policy)
    row = balanced(spark, folders)
    assert (row.received, row.written, row.late_dropped) == (7, 5, 2)


def test_batch_runs_add_up_and_a_repeated_run_replaces_itself(spark, folder):
    folders = jobs.Folders(folder)
    folders.store.create(spark)
    for run, first in ((0, 0), (1, 20), (1, 20)):
        run_batch(spark.createDataFrame(frame_rows(first, 20, 0), FRAMES), folders, run=run)
    jobs.run_available(land(spark, folder, frame_rows(40, 20, 0)), folders)
    row = balanced(spark, folders)
    assert (row.received, row.deduplicated, row.written, row.late_dropped) == (96, 48, 48, 0)
    assert jobs.landed(spark, folders).count() == 120
    assert [tuple(r) for r in jobs.written_equals_stored(spark, folders).collect()] == [("exchange-c", 48, 48, True)]


@pytest.mark.parametrize("many", [False, True])
def test_events_stream_from_one_file_or_many(spark, folder, many):
    whole = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    whole.repartition(3 if many else 1).write.parquet(f"{folder}/events.parquet")
    if not many:
        part = glob.glob(f"{folder}/events.parquet/part-*.parquet")[0]
        folder = f"{folder}/single"
        os.makedirs(folder)
        os.link(part, f"{folder}/events.parquet")
    stream = event_feed.stream_events(spark, folder).select("event_id")
    drain(stream, f"{folder}/drained")
    assert spark.read.parquet(f"{folder}/drained/out").distinct().count() == whole.count() == 1000


def test_text_lines_stream_and_read_alike(spark, folder):
    os.makedirs(f"{folder}/lines")
    with open(f"{folder}/lines/a.txt", "w") as f:
        f.write("KIWI|1|1|5\nKIWI|2|1|5\n")
    drain(text_frames(spark, f"{folder}/lines", "exchange-c", "C", stream=True), folder)
    streamed = spark.read.schema(FRAMES).parquet(f"{folder}/out")
    assert same(streamed, text_frames(spark, f"{folder}/lines", "exchange-c", "C"))
    assert normalize.ticks(normalize.classify(streamed)).count() == 2


def test_watermark_dedup_keeps_one_of_every_key(spark, folder):
    landing = f"{folder}/ticks"
    rows = tick_rows(900, 500, 30)
    ticks(spark, rows).write.parquet(landing)
    stream = spark.readStream.schema(TICKS).parquet(landing)
    query = drain(stream_dedup.within_watermark(stream, timedelta(minutes=10)), folder)
    got = spark.read.parquet(f"{folder}/out").select(KEY)
    assert same(got, ticks(spark, rows).select(KEY).distinct())
    assert sum(progress_row(p)[8] for p in query.recentProgress) == 900 - got.count()


def test_folding_leaves_the_hot_key_a_row_per_generation_and_arrow_batch(spark):
    rows = tick_rows(3000, 240, 10)
    folded = combine(ticks(spark, rows).coalesce(1)).filter("ticker = 'HOT'")
    assert folded.count() == 2
    assert folded.agg(F.sum("copies")).first()[0] == 1000
    assert folded.agg(F.min("first_ts")).first()[0] == ticks(spark, rows).filter("ticker = 'HOT'").agg(
        F.min("arrival_ts")
    ).first()[0]


def frame_rows(first, n, seconds):
    """Format C frames: a quote each second, each sent twice, some broken or blank."""
    rows = []
    for i in range(first, first + n):
        text = f"SYM|{i}|1|{1785585600 + i}"
        if i % 10 == 3:
            text = "broken"
        if i % 10 == 7:
            text = "  "
        rows.append(("exchange-c", "C", text, at(seconds + i), i * 2))
        rows.append(("exchange-c", "C", text, at(seconds + i + 0.5), i * 2 + 1))
    return rows


def land(spark, folder, rows):
    spark.createDataFrame(rows, FRAMES).coalesce(1).write.mode("append").parquet(f"{folder}/frames")
    return stream_frames(spark, f"{folder}/frames")


def balanced(spark, folders):
    row = jobs.reconciliation(spark, folders).first()
    assert row.balanced, row
    return row


def test_flow_from_frames_to_store(spark, folder):
    folders = jobs.Folders(folder)
    folders.store.create(spark)
    frames = land(spark, folder, frame_rows(0, 100, 0))
    jobs.run_available(frames, folders)
    row = balanced(spark, folders)
    assert (row.received, row.deduplicated, row.written, row.dropped) == (160, 80, 80, 0)
    assert folders.store.rows(spark).count() == 80
    landed = jobs.landed(spark, folders)
    assert normalize.quarantine(landed).count() == 20 and normalize.ignored(landed).count() == 20
    assert jobs.backlog(spark, folders).first().backlog == 0
    assert [r.tracked_keys for r in jobs.tracked_keys(spark, folders).collect()] == [80]
    # nothing new: nothing happens
    jobs.run_available(frames, folders)
    assert folders.store.rows(spark).count() == 80


def test_batch_and_stream_leave_the_same_store(spark, folder):
    rows = frame_rows(0, 200, 0)
    streamed, batched = jobs.Folders(f"{folder}/s"), jobs.Folders(f"{folder}/b")
    for f in (streamed, batched):
        f.store.create(spark)
    jobs.run_available(land(spark, folder, rows), streamed)
    run_batch(spark.createDataFrame(rows, FRAMES), batched)
    assert same(streamed.store.rows(spark), batched.store.rows(spark))
    balanced(spark, batched)


class Switch:
    def __init__(self, sink):
        self.sink, self.down = sink, False

    def __call__(self, batch, batch_id):
        if self.down:
            raise ConnectionError("store down")
        self.sink(batch, batch_id)


def test_outage_counts_what_it_drops_and_recovers(spark, folder):
    folders = jobs.Folders(folder)
    switch = Switch(folders.store.create(spark).sink())
    options = SinkOptions(max_attempts=2, backoff_initial=timedelta(milliseconds=1))
    for n, down in enumerate([False, True, False]):
        switch.down = down
        frames = land(spark, folder, frame_rows(n * 100, 100, n * 600))
        jobs.run_available(frames, folders, sink=switch, options=options)
    row = balanced(spark, folders)
    assert (row.received, row.deduplicated, row.written, row.dropped) == (480, 240, 160, 80)


def test_failing_mode_loses_nothing_over_a_restart(spark, folder):
    folders = jobs.Folders(folder)
    switch = Switch(folders.store.create(spark).sink())
    options = SinkOptions(max_attempts=1, on_exhausted="fail")
    frames = land(spark, folder, frame_rows(0, 50, 0))
    switch.down = True
    with pytest.raises(StreamingQueryException, match="store down"):
        jobs.run_available(frames, folders, sink=switch, options=options)
    assert folders.store.rows(spark).count() == 0
    assert jobs.backlog(spark, folders).first().backlog == 80
    switch.down = False
    jobs.run_available(frames, folders, sink=switch, options=options)
    row = balanced(spark, folders)
    assert (row.received, row.deduplicated, row.written, row.dropped) == (80, 40, 40, 0)


def test_a_crash_between_store_and_checkpoint_leaves_one_copy(spark, folder):
    folders = jobs.Folders(folder)
    sink = folders.store.create(spark).sink()
    crashed = []

    def write_then_crash(batch, batch_id):
        sink(batch, batch_id)
        if not crashed:
            crashed.append(batch_id)
            raise RuntimeError("killed after the write")

    options = SinkOptions(max_attempts=1, on_exhausted="fail")
    frames = land(spark, folder, frame_rows(0, 50, 0))
    with pytest.raises(StreamingQueryException):
        jobs.run_available(frames, folders, sink=write_then_crash, options=options)
    jobs.run_available(frames, folders, sink=write_then_crash)
    assert folders.store.rows(spark).count() == 40
    balanced(spark, folders)


def test_a_running_flow_stores_on_its_own_and_stops_gracefully(spark, folder):
    config = JobConfig.load(
        {
            "store": folder,
            "sources": [{"name": "exchange-c", "uri": "feed://c", "format": "c"}],
            "sink": {"max_latency": timedelta(milliseconds=200)},
        },
        {},
    )
    folders = jobs.Folders(folder)
    frames = land(spark, folder, frame_rows(0, 20, 0))
    with pytest.raises(StoreMissing):
        jobs.start_flow(frames, config)
    folders.store.create(spark)
    recorder = ProgressRecorder(f"{folder}/progress", every=2)
    spark.streams.addListener(recorder)
    queries = jobs.start_flow(frames, config)
    try:
        land(spark, folder, frame_rows(20, 20, 0))
        until = time.monotonic() + 60
        while folders.store.rows(spark).count() < 32 and time.monotonic() < until:
            time.sleep(0.2)
    finally:
        clean = jobs.stop_gracefully(queries, timedelta(seconds=60))
        spark.streams.removeListener(recorder)
    assert clean and not any(q.isActive for q in queries)
    row = balanced(spark, folders)
    assert (row.received, row.written) == (64, 32)
    recorder.flush(spark)
    assert not recorder.rows
    seen = recorder.table(spark)
    assert {r.query for r in seen.select("query").distinct().collect()} >= {"land", "store"}
    assert seen.filter("fill < 0 OR ts IS NULL").count() == 0


def test_under_the_watermark_policy_the_gauges_add_up_and_late_ticks_are_kept(spark, folder):
    folders = jobs.Folders(folder)
    folders.store.create(spark)
    policy = lambda df: stream_dedup.within_watermark(df, timedelta(minutes=4))
    for seconds in ([0, 1, 1, 5000], [5001, 5001, 4900], [2, 3, 5002, 4761, 4760]):
        rows = [("exchange-c", "C", f"SYM|{s}|1|{s}", at(s), i) for i, s in enumerate(seconds)]
        jobs.run_available(land(spark, folder, rows), folders, deduplicate=policy)
        assert [r.backlog for r in jobs.backlog(spark, folders).collect()] == [0]
    late = read_late(spark, folders.late)
    # the watermark was at 5001 - 240 seconds: what lies on it is late, as the operator has it
    assert sorted(int(r.price) for r in late.collect()) == [2, 3, 4760, 4761]
    row = balanced(spark, folders)
    assert (row.received, row.deduplicated, row.written, row.late_dropped) == (12, 2, 6, 4)
    flow = jobs.flow(spark, folders).agg(F.sum("taken"), F.sum("written"), F.sum("late_dropped"), F.sum("deduplicated")).first()
    assert tuple(flow) == (12, 6, 4, 2)


def test_a_replayed_batch_lands_once(spark, folder):
    lander = Lander(f"{folder}/n", f"{folder}/journal")
    first = normalize.classify(spark.createDataFrame(frame_rows(0, 10, 0), FRAMES))
    lander(first, 0)
    # a new process that was told of the batch again, after the folder was there and before
    Lander(f"{folder}/n", f"{folder}/journal")(first, 0)
    assert read_landed(spark, f"{folder}/n").count() == 20
    first.write.parquet(f"{folder}/n/_aside/batch_id=1")  # cut off while it was written aside
    Lander(f"{folder}/n", f"{folder}/journal", rows_per_file=3)(normalize.classify(spark.createDataFrame(frame_rows(10, 10, 600), FRAMES)), 1)
    landed = read_landed(spark, f"{folder}/n")
    assert landed.count() == 40
    heard = {r.heard for r in landed.filter("frame_seq >= 20").select("heard").distinct().collect()}
    assert heard == {landed.filter("frame_seq < 20").agg(F.max("arrival_ts")).first()[0]}
    assert [tuple(r)[2:5] for r in read_journal(spark, f"{folder}/journal").orderBy("batch_id").collect()] == [(16, 2, 2), (16, 2, 2)]
    files = glob.glob(f"{folder}/n/batch_id=1/status=*/*.parquet")
    assert max(spark.read.parquet(f).count() for f in files) <= 3


def test_taken_files_are_archived_and_still_accounted_for(spark, folder):
    folders = jobs.Folders(folder)
    folders.store.create(spark)
    for n in range(3):
        frames = land(spark, folder, frame_rows(n * 20, 20, n * 100))
        jobs.start_land(frames, folders).awaitTermination()
        jobs.start_store(jobs.landed_ticks(spark, folders, archive=True), folders).awaitTermination()
    assert glob.glob(f"{folders.archive}/**/*.parquet", recursive=True)
    assert jobs.landed(spark, folders).count() == 120
    row = balanced(spark, folders)
    assert (row.received, row.deduplicated, row.written) == (96, 48, 48)


def test_a_replay_of_the_dead_letter_shows_in_the_gauges(spark, folder):
    folders = jobs.Folders(folder)
    switch = Switch(folders.store.create(spark).sink())
    switch.down = True
    options = SinkOptions(max_attempts=1)
    jobs.run_available(land(spark, folder, frame_rows(0, 50, 0)), folders, sink=switch, options=options)
    sums = lambda: tuple(jobs.flow(spark, folders).agg(F.sum("written"), F.sum("dropped"), F.sum("accepted")).first())
    assert sums() == (0, 40, 40)
    replay_dead_letter(spark, folders.dead_letter, folders.store, folders.counters, batch_id=-1)
    assert sums() == (40, 0, 40) and balanced(spark, folders).written == 40


def test_no_micro_batch_is_above_the_bound_and_a_lone_tick_is_stored(spark, folder):
    folders = jobs.Folders(folder)
    folders.store.create(spark)
    for rows in (frame_rows(0, 60, 0), frame_rows(60, 1, 600)):
        jobs.run_available(land(spark, folder, rows), folders, options=SinkOptions(max_rows=10))
    sizes = [r.n for r in read_counters(spark, folders.counters).groupBy("batch_id").agg(F.sum("received").alias("n")).collect()]
    assert max(sizes) <= 10 and sum(sizes) == 98 and folders.store.rows(spark).count() == 49


def test_the_backlog_follows_landings_and_commits(spark, folder):
    folders = jobs.Folders(folder)
    folders.store.create(spark)
    for n in (10, 40, 20):
        frames = land(spark, folder, [("exchange-c", "C", f"S|{i}|1|1", at(n * 100 + i), i) for i in range(n)])
        jobs.start_land(frames, folders).awaitTermination()
        if n != 10:  # the first batch waits for the second
            jobs.start_store(jobs.landed_ticks(spark, folders), folders).awaitTermination()
    seen = jobs.backlog_over_time(spark, folders).orderBy("at").collect()
    assert [(r.batch_id, r.waiting, r.high_water) for r in seen] == [(0, 10, 10), (1, 50, 50), (None, 0, 50), (2, 20, 50), (None, 0, 50)]


def test_the_state_says_what_is_remembered(spark, folder):
    landing = f"{folder}/ticks"
    for gen in range(4):
        ticks(spark, [tick(gen * 120, 10 * gen + i, ticker=f"G{gen}", price=1 + i) for i in range(5 + gen)]).coalesce(1).write.mode("append").parquet(landing)
        drain(stream_dedup.exact(spark.readStream.schema(TICKS).parquet(landing), buckets=1), folder)
    first = dedup.generation(F.lit(at(0)), dedup.DEFAULT_WINDOW)
    base = spark.range(1).select(first.alias("g")).first().g
    keys = state.exact_keys(spark, f"{folder}/checkpoint")
    assert {r.gen - base: r["keys"] for r in keys.collect()} == {1: 6, 2: 7, 3: 8}
    assert state.tracked(keys, base + 3) == 15
    other = f"{folder}/w"
    retention = timedelta(minutes=10)
    drain(stream_dedup.within_watermark(spark.readStream.schema(TICKS).parquet(landing), retention), other)
    kept = state.watermark_keys(spark, f"{other}/checkpoint", retention)
    assert {r.gen - base: r["keys"] for r in kept.collect()} == {0: 5, 1: 6, 2: 7, 3: 8}


def test_silence_is_found_by_the_clock_and_its_end_is_told(spark, folder):
    def send(source, seconds):
        land(spark, folder, [(source, "C", "x", at(seconds), 1), (source, "C", "x", at(seconds + 1), 2)])

    def told(n):
        until = time.monotonic() + 90
        while time.monotonic() < until:
            if os.path.isdir(f"{folder}/out/_spark_metadata"):
                rows = spark.read.schema(EVENTS).parquet(f"{folder}/out").orderBy("at", "event").collect()
                if len(rows) >= n:
                    return [(r.source[-1], r.event, (r.at - at(0).replace(tzinfo=None)).total_seconds(), r.frames) for r in rows]
            time.sleep(0.3)
        raise AssertionError("nothing was said")

    send("exchange-a", 0)
    send("exchange-b", 10)
    query = (
        silence_events(stream_frames(spark, f"{folder}/frames"), timedelta(seconds=1)).writeStream.format("parquet")
        .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="200 milliseconds").start()
    )
    try:
        assert told(2) == [("a", "silent", 1, 2), ("b", "silent", 11, 2)]  # although nobody is heard from
        send("exchange-a", 20)
        assert told(4)[2:] == [("a", "heard", 20, 0), ("a", "silent", 21, 2)]
    finally:
        query.stop()
